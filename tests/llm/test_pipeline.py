"""The pipeline's stages: their decisions against brute force, awkward rows, clashing columns, empty tables."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_operators import jaccard_truth, template_truth

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    shared = [line(20) for _ in range(3)]
    questions = [(k, f"If {rng.choice(['Anna', 'Boris'])} carries {k + 3} boxes of {rng.choice(words)} from {rng.choice(['Rome', 'Oslo'])} to the {rng.choice(words)} {rng.choice(words)}, how many boxes does the keeper of the {rng.choice(words)} count?") for k in range(6)]
    rows, toxic, leaked = [], set(), set()
    for i in range(240):
        body = [line(rng.randint(8, 20)) for _ in range(rng.randint(2, 8))]
        if i % 8 == 0:
            body[1:1] = shared
        if i % 12 == 1:
            toxic.add(i)
            body[0] += " You idiot, you are scum and a moron."
        if i % 30 == 2:
            leaked.add(i)
            body.append(rng.choice(questions)[1])
        rows.append((i, "\n".join(body)))
    for k, i in enumerate((3, 3, 4, 5, 6)):
        rows.append((240 + k, rows[i][1]))
    rows += [rows[7], (8, line(60)), (None, line(50)), (None, rows[9][1]), (300, None), (301, ""), (302, " "), (303, "one"), (304, "word " * 30_000)]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, "en", "src", len(r[1] or "")) for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(240) if i % 4 < 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {"dir": str(folder), "docs": spark.read.parquet(f"{folder}/documents.parquet"), "toxic": toxic, "leaked": leaked, "questions": questions}


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_toxicity_stage(spark, corpus):
    kept = cp.toxicity(spark, corpus["docs"], corpus["dir"])
    gone = set(range(240)) - set(ids(kept))
    assert gone == corpus["toxic"] and kept.columns == corpus["docs"].columns
    assert kept.where("doc_id IS NULL").count() == 2 and kept.where("text IS NULL").count() == 1


def test_line_dedup_stage(spark, corpus):
    docs = corpus["docs"]
    kept = cp.line_dedup(spark, docs, corpus["dir"])
    assert kept.count() == docs.count() and kept.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in df.where("doc_id < 240 AND doc_id NOT IN (7, 8)").collect()} for df in (docs, kept))
    first = before[0].split("\n")[1:4]
    assert after[0] == before[0]
    for i in range(16, 240, 8):
        lines = before[i].split("\n")
        assert after[i].split("\n") == [x for x in lines if x not in first]
    copy = kept.where("doc_id = 240").first()
    assert copy.text == "" and copy.n_chars == 0  # a copy of document 3: its lines stay there
    assert kept.where("text IS NOT NULL AND n_chars != length(text)").count() == 0


def test_near_duplicates_stage(spark, corpus):
    docs = corpus["docs"]
    kept = cp.near_duplicates(spark, docs, corpus["dir"])
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL AND doc_id != 8").dropDuplicates(["doc_id", "text"]).collect()]
    want = sorted(d for d, c, _ in jaccard_truth(rows) if c == d)
    got = sorted(d for d in ids(kept) if d is not None and d != 8)
    assert got == want and kept.columns == docs.columns
    assert ids(kept).count(8) == 2 and ids(kept).count(None) == 1  # another text under a used id stays; a copy without an id goes


def test_near_copies_are_judged_by_untouched_texts(spark, tmp_path):
    """Copies that line dedup cuts to their changed lines, or to nothing, go; what becomes equal by the cut goes too; others stay."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)) + "."
    base = {i: [line(15) for _ in range(12)] for i in range(12)}
    rows = [(i, "\n".join(x)) for i, x in base.items()]
    for i in range(6):  # a near copy: one word in two of twelve lines is another
        x = list(base[i])
        for k in (2, 8):
            x[k] = " ".join(["other", *x[k].split(" ")[1:]])
        rows.append((100 + i, "\n".join(x)))
    rows += [(200, rows[7][1]), (201, rows[7][1]), (201, rows[8][1])]  # copies; the last two share an id
    passages = ["\n".join(line(15) for _ in range(4)) for _ in range(3)]
    alone = line(40)
    rows += [(300 + k, p) for k, p in enumerate(passages)]
    rows += [(310, "\n".join([passages[0], alone, passages[1]])), (311, "\n".join([passages[1], "\n", alone + " ", passages[2]]))]  # equal only once their passages go
    docs = spark.createDataFrame([(*r, "en", "src", len(r[1])) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = cp.materialise(cp.line_dedup(spark, docs, str(tmp_path)))
    assert max(len(r.text) for r in cut.where("doc_id BETWEEN 100 AND 199").collect()) < 300
    kept = cp.near_duplicates(spark, cut, str(tmp_path))
    assert sorted(ids(kept)) == [*range(12), 201, 300, 301, 302, 310]  # whose source 201 is can't be told from its id: it stays, once, without text
    assert sorted(ids(cp.near_duplicates(spark, docs, str(tmp_path)))) == [*range(12), 300, 301, 302, 310, 311]


def test_decontamination_stage(spark, corpus):
    docs = corpus["docs"]
    kept = cp.decontamination(spark, docs, corpus["dir"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((d for (d, _), found in zip(rows, template_truth([t for _, t in rows], corpus["questions"]), strict=True) if not found), key=str)
    assert sorted(ids(kept), key=str) == want and not set(ids(kept)) & corpus["leaked"] and kept.columns == docs.columns


def test_mixing_stage_and_run(spark, corpus):
    mixed = cp.mixing(spark, corpus["docs"], corpus["dir"])
    assert mixed.count() == corpus["docs"].count() and mixed.columns[:5] == corpus["docs"].columns
    assert mixed.where("rate < 0 OR rate IS NULL").count() == 0
    out = cp.run(spark, corpus["dir"])
    left = set(ids(out))
    assert not left & corpus["toxic"] and not left & corpus["leaked"] and not left & {240, 241, 242} and {0, 3, 8, 300, 304} <= left
    assert "text" in out.columns and 150 < out.count() < 240
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]


def test_stages_pass_clashing_columns_and_empty_tables(spark, corpus):
    clash = [c for c in ("__vertex", "__k", "__k1", "__score", "__items", "vertex", "k", "h", "rate", "n_tokens", "key", "class", "items")]
    few = corpus["docs"].where("doc_id < 30")
    for c in clash:
        if not c.startswith("__"):
            few = few.withColumn(c, few["doc_id"] * 0 + 1)
    for name, stage in cp.STAGES:
        out = stage(spark, few, corpus["dir"])
        if name != "mixing":
            assert out.columns == few.columns, name
        assert out.count() > 20, name
        assert stage(spark, few.where("false"), corpus["dir"]).count() == 0, name
