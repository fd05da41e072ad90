"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Documents of equal n-gram sets are collapsed first; a set is represented by its
least doc_id and keeps its number of copies. Band and row counts come from the
threshold and the target recall. Band hashes are shuffled; sets that meet in a
bucket form candidate components, built from one edge a set and bucket. Each
candidate's text travels once to its component, where all pairs are compared on
their full sets by matrix products. Components beyond ``block`` sets are cut
into blocks; a unit of work is a pair of blocks, so no task holds more than two
blocks, and no row is made for a pair: a unit returns link counts and a spanning
forest.

N-grams are ``n`` lower-cased words, split at white space, held as 64-bit
hashes. Edge cases: a text with fewer words than ``n`` has one n-gram of all its
words; null, empty and blank texts have none, link to nothing, and each is a
class of its own; rows that share an id are documents of their own, in one class
only if their texts are linked; the class of rows without an id only is named by a
number of at least 2^62; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import NULL_ID, join_key, materialise, text_of
from voltlake.llm.components import connected_components

MEMO_WORDS = 200_000
STEP = 1 << 15


def bands_and_rows(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """The most rows a band (fewest chance candidates) for which some number of bands within ``max_hashes`` reaches the recall at the threshold."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("max_hashes is too small for this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted arrays of distinct n-gram hashes; word hashes are kept in a bounded memo."""

    def __init__(self, n: int):
        import xxhash

        self.n, self.hash, self.memo = n, xxhash.xxh64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        try:
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = self.hash(w)
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each non-empty set."""
    rng = np.random.default_rng(20_240_501)
    a = rng.integers(1, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= STEP):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        at = np.cumsum([0] + [len(s) for s in sets[start : end - 1]])
        for j in range(bands):
            band = np.full(end - start, j + 1, np.uint64)
            for k in range(j * rows, (j + 1) * rows):
                least = np.minimum.reduceat(((a[k] * x + b[k]) >> np.uint64(32)).astype(np.uint32), at)
                band = band * np.uint64(0x9E3779B97F4A7C15) + least
            out[start:end, j] = _mix(band)
        start = end
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """128 bits of an n-gram set, as two signed numbers."""
    import xxhash

    raw = s.tobytes()
    return _signed(xxhash.xxh3_64_intdigest(raw)), _signed(xxhash.xxh64_intdigest(raw))


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingle(t) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                found = signatures([sets[i] for i in full], bands, rows).view(np.int64)
                ids, first, second, size, band = [], [], [], [], []
                for d, s in zip(part.column("vertex").to_pylist(), sets, strict=True):
                    ids.append(d)
                    a, b = set_hashes(s) if len(s) else (d, d)
                    first.append(a)
                    second.append(b)
                    size.append(len(s))
                    band.append(None)
                for i, row in zip(full, found, strict=True):
                    band[i] = row
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(size, pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=["vertex", "s1", "s2", "size", "bands"])

    return run


def links_within(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a matrix; with ``right`` None, of left with itself."""
    all_ = left + (right or [])
    sizes = np.array([len(s) for s in all_], float)
    if right is None and len(left) == 2:
        both = len(np.intersect1d(left[0], left[1], assume_unique=True))
        ok = both * (1 + threshold) >= threshold * sizes.sum() - 1e-9
        return np.array([[False, ok], [ok, False]])
    keys, col, times = np.unique(np.concatenate(all_), return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)
    col, row = number[col], np.repeat(np.arange(len(all_)), sizes.astype(int))
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n, m = len(left), len(right) if right is not None else len(left)
    common = np.zeros((n, m), np.float32)
    wide = max(64, 4_000_000 // max(1, len(all_)))
    for start in range(0, int(number.max(initial=-1)) + 1, wide):
        a, b = np.searchsorted(col, [start, start + wide])
        dense = np.zeros((len(all_), wide), np.float32)
        dense[row[a:b], col[a:b] - start] = 1
        common += dense[:n] @ (dense[n:] if right is not None else dense).T
    other = sizes[n:] if right is not None else sizes
    ok = common * (1 + threshold) >= threshold * (sizes[:n, None] + other[None, :]) - 1e-6
    if right is None:
        np.fill_diagonal(ok, False)
    return ok


def forest(n: int, pairs: Iterator[tuple[int, int]], names: np.ndarray) -> list[int]:
    """Each item's root: the least name of its component."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        if i != j:
            if names[i] > names[j]:
                i, j = j, i
            parent[j] = i
    return [find(i) for i in range(n)]


def _verify(n: int, threshold: float):
    """Rows sorted by (comp, i, j): one unit at a time. side is 0 for block i, 1 for block j of a unit with i < j."""

    def unit(rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: (r[1], r[0], r[4]))
        shingle = Shingler(n)
        sides: list[list[tuple]] = [[], []]
        sets: list[list[np.ndarray]] = [[], []]
        seen = set()
        for row in rows:  # rows that repeat a document bring its text again
            if row[0] not in seen:
                seen.add(row[0])
                sides[row[1]].append(row)
                sets[row[1]].append(shingle(row[3]))
        names = np.array([r[0] for side in sides for r in side], np.int64)
        own = [r[4] for side in sides for r in side]
        copies = np.array([r[2] for side in sides for r in side], np.int64)
        cut = len(sets[0])
        if not sets[1] and cut < 2:
            return
        if sets[1] and not cut:
            return
        ok = links_within(sets[0], sets[1] or None, threshold)
        if sets[1]:
            links = np.concatenate([ok @ copies[cut:], ok.T @ copies[:cut]])
            texts = np.concatenate([ok.sum(1), ok.sum(0)])
        else:
            links, texts = ok @ copies, ok.sum(1)
        a, b = np.nonzero(ok)
        roots = forest(len(names), zip(a.tolist(), (b + (cut if sets[1] else 0)).tolist(), strict=True), names)
        for k in np.flatnonzero(texts):
            yield int(names[k]), own[k], int(links[k]), int(texts[k]), int(names[roots[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["rep", "s1", "links", "texts", "root"])
            out.clear()
            return got

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["comp"], row["i"], row["j"])
                if now != key:
                    out.extend(unit(rows))
                    key, rows = now, []
                    if len(out) > 10_000:
                        yield flush()
                rows.append((row["rep"], row["side"], row["copies"], row["text"], row["s1"]))
        out.extend(unit(rows))
        yield flush()

    return run


def with_vertices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__vertex``, and doc_id, vertex of the rows whose vertex isn't their id.

    A vertex is the row's id, so that the least one of a class is its least id. Rows
    without an id, and those that share one with another text, have a number of at
    least 2^62 made of id and text instead; the ids that repeat are found by a partial
    aggregate of id and hash, and are broadcast only if the planner finds them small.
    """
    text_hash = F.xxhash64(text_of())
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), text_of()), 2).bitwiseOR(F.lit(1 << 62))
    several = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__shared")).agg(F.min(text_hash).alias("a"), F.max(text_hash).alias("b")).where("a != b").select("__shared")
    several = materialise(several)
    marked = docs.join(several.withColumn("__found", F.lit(True)), F.col("doc_id").cast("long") == F.col("__shared"), "left")
    own = F.col("__found").isNull() & F.col("doc_id").isNotNull()
    out = marked.withColumn("__vertex", F.when(own, F.col("doc_id").cast("long")).otherwise(made)).drop("__shared", "__found")
    return out, out.where(F.col("__vertex") >= 1 << 62).where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("__vertex"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__vertex").alias("vertex")).distinct()


def jaccard_classes(texts: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, max_hashes: int = 160, block: int = 256) -> DataFrame:
    """vertex, class (its least vertex), n_links, n_linked_texts for every row of ``texts`` (vertex, text)."""
    bands, rows = bands_and_rows(threshold, recall, max_hashes)
    signed = materialise(texts.mapInArrow(_sign(n, bands, rows), "vertex long, s1 long, s2 long, size long, bands array<long>"))
    sets = signed.groupBy("s1", "s2").agg(F.min("vertex").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))

    spread = sets.where("bands IS NOT NULL").select("rep", F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("band", "h").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", join_key("h").alias("j"), "low")
    met = materialise(spread.withColumn("j", join_key("h")).join(buckets, ["band", "j"]).select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct())
    candidates = materialise(connected_components(met))

    sizes = candidates.groupBy("component").agg(F.ceil(F.least(F.count("*") / block, F.sqrt(F.count("*").cast("double")))).cast("int").alias("blocks"))
    members = candidates.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    reps = signed.groupBy("s1", "s2").agg(F.min("vertex").alias("rep"), F.count("*").alias("copies"))
    chosen = members.join(reps, members["vertex"] == reps["rep"]).select("rep", "copies", "blocks", "b", "component", "s1")
    carried = texts.join(chosen, texts["vertex"] == chosen["rep"]).select("rep", "copies", "blocks", "b", "component", "s1", "text")
    unit = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.when(F.col("b") > o, 1).otherwise(0).alias("side")))
    units = carried.select("rep", "copies", "s1", "text", F.col("component").alias("comp"), F.explode(unit).alias("unit")).select("rep", "copies", "s1", "text", "comp", "unit.i", "unit.j", "unit.side")
    ordered = units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    verified = materialise(ordered.mapInArrow(_verify(n, threshold), "rep long, s1 long, links long, texts long, root long"))

    groups = connected_components(verified.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counted = verified.groupBy("rep", "s1").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = groups.withColumnRenamed("vertex", "rep")
    known = reps.join(counted, ["rep", "s1"], "left").join(classes, "rep", "left").select("s1", "s2", "copies", "links", "texts", F.coalesce("component", "rep").alias("class"))
    empty = F.col("size") == 0
    return (
        signed.select("vertex", "s1", "s2", "size")
        .join(known, ["s1", "s2"], "left")
        .select(
            "vertex",
            F.when(empty, F.col("vertex")).otherwise(F.col("class")).alias("class"),
            F.when(empty, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        )
    )


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (least id of its linked group), n_links (other documents at or above the threshold), n_linked_texts (other n-gram sets), for every row."""
    marked, others = with_vertices(docs)
    found = jaccard_classes(marked.select(F.col("__vertex").alias("vertex"), text_of().alias("text")), **options)
    mine, theirs = others.select("vertex", F.col("doc_id").alias("__id"), F.lit(True).alias("__made")), others.select(F.col("vertex").alias("class"), F.col("doc_id").alias("__class_id"))
    named = found.join(mine, "vertex", "left").join(theirs, "class", "left")
    return named.select(F.when(F.col("__made"), F.col("__id")).otherwise(F.col("vertex")).alias("doc_id"), F.coalesce("__class_id", "class").alias("class_id"), "n_links", "n_linked_texts")
