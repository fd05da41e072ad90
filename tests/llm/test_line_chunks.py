"""Line dedup of the pipeline: chunks by rolling hashes, and passages beside them."""

from pyspark.sql import functions as F

from voltlake.llm.op2_lines import dedupe_lines, with_chunks, with_chunks_and_passages


def test_pipeline_cuts_chunks_by_rolling_hashes(spark):
    lines = [f"line number {k} of this text" for k in range(40)]
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    units = docs.select(with_chunks_and_passages(F.col("text"), 3, 4, lambda _, u: u).alias("u"), with_chunks(F.col("text"), 3, 4, lambda _, c: c).alias("c")).first()
    spans = [(u.first, u.n) for u in units.u]
    assert [u.no for u in units.u] == list(range(len(spans))) and len(set(spans)) == len(spans)
    assert {(c.first, c.n) for c in units.c if c.n > 2} == {s for s in spans if s[1] > 2} != set()
    assert {s for s in spans if s[1] == 2} == {(k, 2) for k in range(1, 40)}


def test_first_place_stays_whole_and_copies_go(spark):
    block = [f"a repeated line {k}" for k in range(30)]
    docs = spark.createDataFrame([(1, "\n".join(["one", *block, "two"])), (2, "\n".join(["three", *block, "four"])), (3, "x\n\ny"), (4, "alone")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in dedupe_lines(docs, passages=True).collect()}
    assert found == {1: "\n".join(["one", *block, "two"]), 2: "three\nfour", 3: "x\n\ny", 4: "alone"}
