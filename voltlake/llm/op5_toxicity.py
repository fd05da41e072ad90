"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``max_fit_rows`` per class, chosen by a
   hash of the id) proposes lexicon keys: words, word beginnings and word endings
   that set the classes apart. Counts over all labelled documents outside the
   held-out fold decide which stay. Keys that come together (an insult, its
   beginning, its ending) form a cluster, and clusters are dealt to lexicon voters, so
   that voters share no word.
2. Lexicon and pattern voters vote toxic (+1) or abstain (0) on every document outside
   the held-out fold, labelled or not; where there is a label it votes as well, which
   tells the model which class is which. Votes are counted by pattern, with the keys of ``examples`` documents of each (lowest hash): a bounded number of
   rows, whatever the input.
3. A generative model with a latent class is fitted to the pattern counts by EM.
   Two first rounds take voters as independent; the conditional mutual
   information that is left gives their correlations, and the fit goes on along
   the maximum spanning tree of those (one parent a voter). Accuracies are read
   from its posteriors.
4. A linear classifier over the keys is trained on the model's posterior labels of
   the examples, which take their votes alone, not their labels, each pattern with the
   weight of all its documents. It scores every document.

Held out are ids with crc32(id as text) mod 5 = 0; neither their labels nor
their texts take part in fitting. Labels, language, source and id are no inputs
of a score.

Edge cases: null and empty texts score as a text without words; a null id counts
as held out with a null result id; without usable labels of both classes the
seed lexicon alone decides; repeated rows get equal scores; a label row without
both an id and a 0/1 value is ignored, of contradictory labels for an id the
larger counts, and of several texts of a labelled id the one of the least list of
words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import materialise

WORD = re.compile(r"[^\W_]+")
#: Common English insults, the seed lexicon.
SEEDS = ("idiot", "moron", "stupid", "loser", "trash", "scum", "clown", "pathetic", "disgusting", "worthless")
FOLDS = 5
#: Lexicon voters for clusters that are sure and for those that are not, then the pattern voters.
SURE, UNSURE = 8, 2
PATTERN_VOTERS = ("shout", "stretched", "capitals", "masked")
STRETCHED = re.compile(r"([a-z])\1{3}")
MASKED = re.compile(r"\b[a-z]+[*@$#]+[a-z]+\b")
MEMO_WORDS = 200_000
#: Share of a key's sample rows that must be toxic.
PURE = 0.97


def shapes(word: str) -> tuple[str, ...]:
    """Lexicon keys of a word: itself, its beginnings and its endings."""
    out = ["=" + word]
    n = len(word)
    out += ["<" + word[:k] for k in (4, 5, 6) if n > k]
    out += [">" + word[-k:] for k in (4, 5) if n > k]
    return tuple(out)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


class Lexicon:
    """Selected keys; looks words up through a bounded memo."""

    def __init__(self, keys: list[str]):
        self.index = {k: i for i, k in enumerate(keys)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def found(self, text: str) -> tuple[set[int], int]:
        """Indices of the keys present, and the number of distinct words."""
        words = set(WORD.findall(text.lower()))
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, index, out = self.memo, self.index, set()
        for w in words:
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple(index[s] for s in shapes(w) if s in index)
            if got:
                out.update(got)
        return out, len(words)



def patterns_of(text: str, words: int) -> list[int]:
    """Votes of the pattern voters."""
    loud = sum(text.count(c) for c in "!?")
    capitals = sum(map(str.isupper, text))
    return [int(x) for x in (loud >= 5 and loud * 40 > words, STRETCHED.search(text) is not None, capitals > 20 and 2 * capitals > sum(map(str.islower, text)), MASKED.search(text) is not None)]


def gain_of(toxic: int, clean: int, size: tuple[int, int]) -> float:
    """Log likelihood that a key's presence gains by telling the classes (sizes clean, toxic) apart."""
    rate, low, high = (toxic + clean) / sum(size), toxic / size[1], clean / size[0]
    inside = sum(x * math.log(p / rate) for x, p in ((toxic, low), (clean, high)) if x)
    return inside + sum((n - x) * math.log((1 - p) / (1 - rate)) for x, n, p in ((toxic, size[1], low), (clean, size[0], high)) if n > x)


def mine(rows: list[tuple[list[str], int]], max_keys: int) -> tuple[list[str], float]:
    """Keys by the gain of their presence in toxic and clean rows, at most ``max_keys`` and the seeds, and the gain that about one key has by chance."""
    size = tuple(sum(toxic == y for _, toxic in rows) for y in (0, 1))
    least, scored = 3, []
    counts = (Counter(), Counter())
    for words, toxic in rows:
        if toxic:
            counts[1].update({s for w in words for s in shapes(w)})
    for key in [k for k, t in counts[1].items() if t < least]:
        del counts[1][key]
    wanted = counts[1]
    for words, toxic in rows:  # keys that no toxic rows share can't be chosen
        if not toxic:
            counts[0].update({s for w in words for s in shapes(w) if s in wanted})
    needed = 0.75 * math.log(max(2, len(wanted)))
    for key, t in counts[1].items():
        c = counts[0].get(key, 0)
        if t >= PURE * (t + c) and (gain := gain_of(t, c, size)) > needed:
            scored.append((gain, key))
    scored.sort(key=lambda x: (-x[0], x[1]))
    return list(dict.fromkeys([key for _, key in scored[:max_keys]] + ["=" + s for s in SEEDS])), needed


def clusters(single: dict[int, int], both: dict[tuple[int, int], int]) -> dict[int, int]:
    """For each key the first of those it comes together with: in at least 80 % of the documents that hold one of the two."""
    first = {i: i for i in single}

    def root(i: int) -> int:
        while first[i] != i:
            i = first[i]
        return i

    for (i, j), n in sorted(both.items()):
        if n >= 0.8 * (single[i] + single[j] - n):
            a, b = root(i), root(j)
            first[max(a, b)] = min(a, b)
    return {i: root(i) for i in first}


def dealt(gains: dict[int, float], first: dict[int, int], sure_from: float) -> list[list[int]]:
    """Keys of each lexicon voter: whole clusters in turn, the surest first."""
    groups: dict[int, list[int]] = {}
    for i, k in first.items():
        groups.setdefault(k, []).append(i)
    out: list[list[int]] = [[] for _ in range(SURE + UNSURE)]
    turn = [0, 0]
    for group in sorted(groups.values(), key=lambda g: (-max(gains[i] for i in g), g)):
        doubtful = max(gains[i] for i in group) < sure_from
        out[SURE + turn[1] % UNSURE if doubtful else turn[0] % SURE] += group
        turn[doubtful] += 1
    return out


def label_posterior(model: dict, patterns: np.ndarray) -> np.ndarray:
    """Probability of class 1 for vote patterns (rows of -1, 0, 1)."""
    votes, parent, t = np.asarray(patterns) + 1, model["parent"], model["tables"]
    log = np.log(np.array([[1 - model["prior"]], [model["prior"]]]))
    log = log + sum(np.log(t[j][:, votes[:, parent[j]] if parent[j] >= 0 else 0, votes[:, j]]) for j in range(votes.shape[1]))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.1, rounds: int = 60, smooth: float = 0.5, free: int = 0) -> dict:
    """EM over vote patterns (rows of -1, 0, 1). Class 1 is the one for which +1 votes are likelier. The last ``free`` voters follow the class alone, without correlations."""
    votes, weight = patterns + 1, counts.astype(float)
    k = votes.shape[1]
    lean = (patterns * np.where(patterns > 0, 1.0, 0.6)).sum(1)
    post = 1 / (1 + np.exp(-(3.0 * lean - 2.0)))
    parent = np.full(k, -1)

    def tables(post: np.ndarray) -> tuple[float, list[np.ndarray]]:
        both = np.stack([(1 - post) * weight, post * weight])
        out = []
        for j in range(k):
            above = votes[:, parent[j]] if parent[j] >= 0 else np.zeros(len(votes), int)
            t = np.full((2, 3, 3), smooth)
            for y in (0, 1):
                np.add.at(t[y], (above, votes[:, j]), both[y])
            out.append(t / t.sum(2, keepdims=True))
        return float((both[1].sum() + prior) / (both.sum() + 1)), out

    def em(post: np.ndarray, rounds: int) -> tuple[float, list[np.ndarray], np.ndarray]:
        for _ in range(rounds):
            p, t = tables(post)
            new = label_posterior({"prior": p, "tables": t, "parent": parent}, patterns)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return p, t, post

    p, t, post = em(post, 2)  # few rounds: run to the end, an independent model would take a correlated pair for the class
    shared = np.zeros((k, k))
    for i in range(k):
        for j in range(i):
            for y, w in ((0, (1 - post) * weight), (1, post * weight)):
                joint = np.full((3, 3), 1e-9)
                np.add.at(joint, (votes[:, i], votes[:, j]), w)
                q = joint / joint.sum()
                shared[i, j] += w.sum() / weight.sum() * float((q * np.log(q / (q.sum(1, keepdims=True) * q.sum(0, keepdims=True)))).sum())
            shared[j, i] = shared[i, j]
    inside, out = {0}, set(range(1, k - free))
    while out:
        i, j = max(((i, j) for i in inside for j in out), key=lambda x: (shared[x], -x[0], -x[1]))
        parent[j] = i if shared[i, j] > 2e-3 else -1
        inside.add(j)
        out.remove(j)
    p, t, post = em(post, rounds)
    right = (votes == 2) * post[:, None] + (votes == 0) * (1 - post)[:, None]
    accuracy = ((weight @ right) / np.maximum(weight @ (votes != 1), 1e-9)).tolist()
    return {"prior": p, "tables": t, "parent": parent, "accuracy": accuracy, "correlation": shared, "posterior": {tuple(int(x) for x in row): float(v) for row, v in zip(patterns, post, strict=True)}}


def fit_linear(rows: list[set[int]], target: np.ndarray, weight: np.ndarray, n: int, l2: float = 1e-4, rounds: int = 1_000) -> tuple[np.ndarray, float]:
    """Logistic regression on key presence with soft targets: accelerated gradient steps of a length that the longest row allows."""
    cols = np.concatenate([np.fromiter(r, np.int64, len(r)) for r in rows] or [np.zeros(0, np.int64)])
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    step = 4.0 / (1 + max(map(len, rows), default=0))
    share = weight / weight.sum()
    now = ahead = np.append(np.zeros(n), -1.0)
    for k in range(rounds):
        z = ahead[n] + np.bincount(at, ahead[cols], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * share
        new = ahead - step * np.append(np.bincount(cols, g[at], n) + l2 * ahead[:n], g.sum())
        now, ahead = new, new + k / (k + 3) * (new - now)
    return now[:n], float(now[n])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 2_048, max_keys: int = 1_024, examples: int = 32) -> dict:
    """The scorer's parameters: a lexicon of at most ``max_keys`` keys and the seeds, weights and an intercept.

    At most 2 x ``max_fit_rows`` labelled rows' distinct words reach the driver, and
    counts by key, pairs of keys and vote pattern, with the keys of ``examples``
    documents of each pattern. All counts cover all documents outside the held-out fold.
    """
    seeds_only = {"keys": ["=" + s for s in SEEDS], "weights": [4.0] * len(SEEDS), "intercept": -2.0, "label_model": None}
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows).unionByName(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows))
    chosen = {r.doc_id: r.toxic for r in sample.collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, d in enumerate(batch.column("doc_id").to_pylist()) if d in chosen]
            picked = batch.take(pa.array(keep, pa.int64()))
            distinct = [sorted(set(WORD.findall((text or "").lower()))) for text in picked.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([picked.column("doc_id"), pa.array(distinct, pa.list_(pa.string()))], names=["doc_id", "words"])

    labelled: list[tuple[list[str], int]] = []
    if chosen:
        table = texts.mapInArrow(words, "doc_id long, words array<string>").groupBy("doc_id").agg(F.min("words").alias("words")).toArrow()
        one: dict[str, str] = {}  # equal words share a string
        labelled = [(w, chosen[d]) for d, w in sorted((d, [one.setdefault(x, x) for x in w.as_py()]) for d, w in zip(table.column("doc_id").to_pylist(), table.column("words"), strict=True))]
        labelled = [(list(w), y) for w, y in dict.fromkeys((tuple(w), y) for w, y in labelled)]  # copies count once
        del table, one
    if len({y for _, y in labelled}) < 2:
        return seeds_only
    keys, needed = mine(labelled, max_keys)
    del labelled

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(keys)
        kind = pa.list_(pa.int32())
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found, n = lexicon.found(text)
                rows.append((sorted(found), patterns_of(text, n)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], names=["doc_id", "copy", "found", "patterns"])

    seen = materialise(texts.where(~held_out()).mapInArrow(look, "doc_id long, copy long, found array<int>, patterns array<int>"))
    told = materialise(seen.select("doc_id", "copy", "found").join(known, "doc_id").groupBy("toxic", "copy").agg(F.first("found").alias("found")))  # of copies one
    size = {r.toxic: r.n for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    by_key = told.select("toxic", F.explode("found").alias("key")).groupBy("key", "toxic").agg(F.count("*").alias("n"))
    counts = {(r.key, r.toxic): r.n for r in by_key.collect()}
    gains = {}
    for i, key in enumerate(keys):
        t, c = counts.get((i, 1), 0), counts.get((i, 0), 0)
        gain = gain_of(t, c, (max(size.get(0, 0), c + 1), max(size.get(1, 0), t + 1)))
        if key[1:] in SEEDS or (t >= 3 and t >= PURE * (t + c) and gain > needed / 0.75 + 1):  # far fewer than one key by chance
            gains[i] = gain
    kept = F.filter("found", lambda k: F.array_contains(F.array(*map(F.lit, gains)), k))
    seen = seen.withColumn("found", kept)
    flat = seen.select("found", F.explode("found").alias("i"))
    pairs = flat.select("i", F.explode(F.filter("found", lambda j: j >= F.col("i"))).alias("j")).groupBy("i", "j").agg(F.count("*").alias("n")).collect()
    both = {(r.i, r.j): r.n for r in pairs}
    voters = dealt(gains, clusters({i: both.get((i, i), 0) for i in gains}, {ij: n for ij, n in both.items() if ij[0] < ij[1]}), 2 * needed)

    said = [F.arrays_overlap("found", F.array(*map(F.lit, group))).cast("int") if group else F.lit(0) for group in voters]
    voted = seen.join(known, "doc_id", "left").select(F.concat(F.array(*said), "patterns").alias("votes"), F.coalesce(2 * F.col("toxic") - 1, F.lit(0)).alias("label"), F.xxhash64("doc_id").alias("h"), "found")
    counted = {(*r.votes, r.label): r.n for r in voted.groupBy("votes", "label").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return seeds_only
    nth = F.row_number().over(Window.partitionBy("votes").orderBy("h", "found"))
    rows = sorted((tuple(r.votes), r.h, r.found) for r in voted.withColumn("nth", nth).where(F.col("nth") <= examples).collect())
    patterns = sorted(counted)
    model = fit_label_model(np.array(patterns), np.array([counted[p] for p in patterns]), free=1)

    share, whole = Counter(votes for votes, _, _ in rows), Counter()
    for (*votes, _), n in counted.items():
        whole[tuple(votes)] += n
    target = label_posterior(model, np.array([(*votes, 0) for votes, _, _ in rows]))
    weight = np.array([whole[votes] / share[votes] for votes, _, _ in rows])
    rare = max(1.0, (weight * (1 - target)).sum() / max(1e-9, (weight * target).sum()))
    place = {i: k for k, i in enumerate(gains)}
    w, b = fit_linear([{place[i] for i in found} for _, _, found in rows], target, weight * (1 + (rare - 1) * target), len(gains))
    return {"keys": [keys[i] for i in gains], "weights": w.tolist(), "intercept": float(b), "label_model": model, "voters": voters}


def score_toxicity(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns (but for one of the score's name) and the score, for every row. The model is bounded by ``max_keys``."""
    keep = tuple(c for c in keep if c != name)
    keys, weights, intercept = (model[k] for k in ("keys", "weights", "intercept"))
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(keys)
        for batch in batches:
            scores = []
            for text in batch.column("__text"):
                z = intercept + sum(weights[i] for i in sorted(lex.found(text.as_py() or "")[0]))
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, name])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{ddl}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score_toxicity(docs.withColumn("doc_id", F.col("doc_id").cast("long")), fit_toxicity(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
