"""Vector codes: product quantisation in exact integers, distances by limb-split GEMM.

Components become integers, vectors are cut into equal parts, and each part position
has a codebook of at most 16 entries, improved by rounds of assignment and floored means.
Dot products of parts and entries run through float64 BLAS without rounding: integers
are split into limbs of so many bits that a sum of limb products over a part stays
below 2**53; the limb products are recombined in int64 by shifts, and the nearest entry is
the first argmin of |c|**2 - 2 x.c. Where squared distances could leave int64, the same
runs on Python's integers.

Plan: a round is one pass over the vectors that emits one row of sums for each entry and
component of a task, added up by Spark and brought to the driver: their number is the
codebooks' size, whatever the table's. Nothing is shuffled by vector. The first
codebooks come from at most 16 ids a task. The last pass is written once, and its errors
are summed by label before they are joined back.

Edge cases: vectors that are null or hold null, NaN or infinite components are dropped;
a vector that doesn't have the number of components of the kept vector of least id, or one
that the parts don't divide, keeps its row with null code and errors and takes no part in sums; repeated
ids are one seed, the one of the least vector in array order; null ids come last;
fewer than 16 ids make smaller codebooks; null labels are one group; an error beyond a
long is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from voltlake.llm.common import materialise

#: Components times SCALE, floored, are the integers.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST = 2**63 - 1


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed int64 as float64 limbs, the least first: all but the last are from 0 to 2**bits - 1."""
    out = []
    while np.abs(values).max(initial=0) >= 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a (rows x d) times b (entries x d) transposed, exact while the results fit int64."""
    bits = (53 - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = [x.T for x in limbs(b, bits)]
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry and squared distance of each row of x, int64 or Python integers."""
    if x.dtype != object:
        most = max(int(np.abs(x).max(initial=0)), max((abs(int(v)) for v in book.ravel()), default=0))
        if 4 * max(1, x.shape[1]) * most * most < 1 << 62:
            book = book.astype(np.int64)
            score = (book * book).sum(1) - 2 * exact_dot(x, book)
            code = score.argmin(1)
            return code, (x * x).sum(1) + score[np.arange(len(x)), code]
        x = x.astype(object)
    score = (book * book).sum(1) - 2 * (x @ book.T)
    code = np.array([min(range(len(book)), key=row.__getitem__) for row in score], np.int64)
    return code, (x * x).sum(1) + score[np.arange(len(x)), code]


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the vectors of ``dims`` components, and their integers."""
    fits = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False) == dims)
    values = np.floor(column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(values).max(initial=0) < 1 << 62:
        return fits, values.astype(np.int64).reshape(int(fits.sum()), dims)
    return fits, np.array([int(v) for v in values], object).reshape(int(fits.sum()), dims)


def kept(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """id, v (array of double), label of the vectors without null or non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")).where(F.col("v").isNotNull() & ~F.exists("v", odd))


def first_vectors(rows: DataFrame, k: int) -> list[list[float]]:
    """Vectors of the k least ids: each task keeps its k least, so that nothing is shuffled by id."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, list[float]] = {}
        rank = lambda i: (i is None, i or 0)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            worst = max(map(rank, best)) if len(best) >= k else None
            for at, i in enumerate(ids):
                if worst is None or rank(i) <= worst:
                    v = batch.column("v")[at].as_py()
                    best[i] = min(best.get(i, v), v)
            best = {i: best[i] for i in sorted(best, key=rank)[:k]}
        yield pa.RecordBatch.from_pydict({"id": pa.array(list(best), pa.int64()), "v": pa.array(list(best.values()), pa.list_(pa.float64()))})

    found = rows.select("id", "v").mapInArrow(least, "id long, v array<double>")
    return [r.v for r in found.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(k).collect()]


def sums(rows: DataFrame, books: list[np.ndarray], dims: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and component sums of the vector parts assigned to each entry, by (part, entry)."""
    parts, width = len(books), dims // len(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            _, x = integers(batch.column("v"), dims)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                code, _ = nearest(own, books[p])
                for e in np.unique(code):
                    mine = own[code == e]
                    if mine.dtype != object and np.abs(mine).max(initial=0) * len(mine) >= 1 << 62:
                        mine = mine.astype(object)
                    seen = [len(mine), *(int(v) for v in mine.sum(0))]
                    totals[p, int(e)] = [a + b for a, b in zip(totals.get((p, int(e)), [0] * (width + 1)), seen, strict=True)]
        flat = [(p, e, j, str(v)) for (p, e), row in totals.items() for j, v in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["p", "e", "j", "total"])

    summed = rows.select("v").mapInArrow(add, "p int, e int, j int, total string").groupBy("p", "e", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in summed.collect():
        found.setdefault((r.p, r.e), {})[r.j] = int(r.total)
    return {at: (row[0], [row[j + 1] for j in range(width)]) for at, row in found.items()}


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One array of integers a part, entries x components; empty if there is no vector or its parts aren't equal."""
    seeds = first_vectors(rows, entries)
    dims = len(seeds[0]) if seeds else 0
    if not seeds or dims % parts:
        return []
    width = dims // parts
    whole = np.array([[int(np.floor(x * SCALE)) for x in v] for v in seeds if len(v) == dims], object).reshape(-1, dims)
    books = [whole[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        found = sums(rows, books, dims)
        books = [np.array([[t // found[p, e][0] for t in found[p, e][1]] if (p, e) in found else list(entry) for e, entry in enumerate(book)], object).reshape(len(book), width) for p, book in enumerate(books)]
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``rows`` less their vector, with code and error."""
    parts = len(books)
    width = books[0].shape[1] if books else 0
    schema = rows.select("id", "label").schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if books:
                fits, x = integers(batch.column("v"), parts * width)
                at = np.flatnonzero(fits)
                found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
                text = np.stack([c for c, _ in found], 1).astype(np.uint8) if len(at) else np.zeros((0, parts), np.uint8)
                total = sum(e.astype(object) for _, e in found)
                for k, row in enumerate(at):
                    codes[row], errors[row] = text[k].tobytes().hex(), int(total[k]) if total[k] <= MOST else None
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return rows.mapInArrow(coded, StructType([*schema.fields, StructField("code", StringType()), StructField("error", LongType())]))


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for book in books for entry in book for v in entry)


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector kept. At most 256 entries a part."""
    rows = kept(vectors, vec_id, vector, label)
    books = fit_codebooks(rows, parts, entries, rounds)
    coded = materialise(encode(rows, books))
    key: list[Column] = [F.col("label").isNull().alias("none"), F.xxhash64("label").alias("h")]  # another key than the grouping's: a label of many vectors can be split
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(F.col("label").alias("own"), F.when(F.col("total") <= MOST, F.col("total").cast("long")).alias("label_error"), *key)
    joined = coded.select("*", *key).join(by_label, ["none", "h"]).where(F.col("label").eqNullSafe(F.col("own")))
    sha = hashlib.sha256(books_text(books).encode()).hexdigest()
    return joined.select(F.col("id").alias("vec_id"), "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(sha).alias("codebooks_sha256"))
