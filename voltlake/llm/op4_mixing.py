"""Mixing sources to target weights by soft membership.

1. A softmax classifier is fitted on at most ``max_fit_rows`` labelled rows a
   domain (lowest hash of the id) over hashed words and byte counts; it gives
   every document a posterior over domains.
2. Projected gradient steps fit document rates r >= 0 to
   e' M^-1 e + ridge * sum_d t_d / N * (r_d - 1)^2, e = (sum_d r_d t_d p_d - T) / N,
   where M = sum_d t_d p_d p_d' / N scales each direction by what documents can
   move in it. All rates move along the documents' posteriors, so after any number
   of steps they are the projection max(0, 1 - p_d' u) of one vector u of a number
   a domain, and a step is one distributed sum over documents' own posteriors. The
   step's scale is the Gram matrix of the documents whose rate is positive, halved
   while it doesn't shrink the gradient, so that about ten steps are enough. No
   state is kept on executors: a lost one costs a recomputation only.

Rates have no upper bound: what is left of a rare domain is repeated as often as its
target needs. Targets that are missed all the same are told by a warning.

Every document is kept; a rate of 0 leaves it out of the mix, 2 repeats it.
Edge cases: null and empty texts have no tokens, the posterior of an empty text
and its rate; a domain without labelled rows has no posterior, its target can't
be met and is left out of the fit; without any labels all posteriors are equal;
label rows without an id or with values other than 0 and 1 are ignored, and of
contradictory ones the larger values count; of several texts of a labelled id the
one with the least features is fitted; repeated rows get equal rates; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import materialise, text_of

DOMAINS = ("good", "junk", "toxic")
BUCKETS = 1 << 15
MEMO_WORDS = 200_000


class Features:
    """Square roots of byte and hashed word shares of a text, as indices and values of unit length."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        words = text.split()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        for w in set(words):
            if w not in memo:
                memo[w] = zlib.crc32(w.strip(".,;:!?").lower().encode()) % BUCKETS
        by_word = np.bincount(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
        by_byte = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        both = np.concatenate([by_word / max(1, by_word.sum()), by_byte / max(1, by_byte.sum())])
        at = np.flatnonzero(both)
        value = np.sqrt(both[at])
        return at, value / max(1e-12, np.linalg.norm(value)), len(words)


def fit_softmax(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, rounds: int = 300, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts, on features scaled by their inverse document frequency in the rows."""
    at = np.concatenate([r[0] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    n = BUCKETS + 256
    idf = np.log((len(rows) + 1) / (np.bincount(at, minlength=n) + 1)) + 0.2
    value = (np.concatenate([r[1] for r in rows]) * idf[at]).astype(np.float32)
    used, col = np.unique(at, return_inverse=True)  # only columns that occur have weights
    full = np.flatnonzero(size)
    row_starts = np.cumsum(np.append(0, size[full][:-1]))
    by_col = np.argsort(col, kind="stable")
    of, sorted_value = np.repeat(np.arange(len(rows)), size)[by_col], value[by_col]
    col_starts = np.searchsorted(col[by_col], np.arange(len(used)))
    one = np.eye(k)[:, y]
    w, b, vw, vb = np.zeros((k, len(used)), np.float32), np.zeros(k), 0.0, 0.0
    for _ in range(rounds):
        z = np.repeat(b[:, None], len(rows), 1)
        for c in range(k):
            z[c, full] += np.add.reduceat(value * w[c].take(col), row_starts)
        p = np.exp(z - z.max(0))
        g = ((p / p.sum(0) - one) / len(rows)).astype(np.float32)
        vw = 0.9 * vw - 8.0 * (np.stack([np.add.reduceat(sorted_value * g[c].take(of), col_starts) for c in range(k)]) + l2 * w)
        vb = 0.9 * vb - 2.0 * g.sum(1)
        w, b = w + vw, b + vb
    out = np.zeros((n, k))
    out[used] = w.T * idf[used, None]
    return out, b


def fit_domains(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 1_024) -> dict:
    """The classifier's weights, from the labelled table. At most ``max_fit_rows`` rows' features a domain reach the driver."""
    flags = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    known = flags.select("doc_id", F.when(F.col("t") == 1, 2).when(F.col("q") == 1, 0).otherwise(1).alias("domain"))
    chosen = {r.doc_id: r.domain for k in range(len(DOMAINS)) for r in known.where(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            keep = [i for i, d in enumerate(batch.column("doc_id").to_pylist()) if d in chosen]
            picked = batch.take(pa.array(keep, pa.int64()))
            got = [features(t or "") for t in picked.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([picked.column("doc_id"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["doc_id", "at", "value"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, at array<int>, value array<double>")
    first = found.groupBy("doc_id").agg(F.min(F.struct("at", "value")).alias("x")).select("doc_id", "x.at", "x.value")
    rows = first.toArrow() if chosen else None
    if rows is None or not rows.num_rows:
        return {"w": np.zeros((BUCKETS + 256, len(DOMAINS))), "b": np.zeros(len(DOMAINS))}
    rows = rows.sort_by("doc_id").combine_chunks()
    y = np.array([chosen[d] for d in rows.column("doc_id").to_pylist()])
    w, b = fit_softmax([(at.values.to_numpy().astype(np.int64), value.values.to_numpy()) for at, value in zip(rows.column("at"), rows.column("value"), strict=True)], y, len(DOMAINS))
    b[[k for k in range(len(DOMAINS)) if not (y == k).any()]] = -1e9
    return {"w": w, "b": b}


def posteriors(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens (words) and p_<domain>, adding up to 1."""
    w, b = model["w"].astype(np.float32), model["b"]
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found, tokens = [], []
            for text in batch.column("__text"):
                at, value, n = features(text.as_py())
                z = value @ w[at] + b
                p = np.exp(z - z.max())
                found.append(p / p.sum())
                tokens.append(n)
            p = np.array(found).reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(tokens, pa.int64()), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], names=[*keep, "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select(*keep, text_of().alias("__text")).mapInArrow(run, f"{ddl}, n_tokens long, {', '.join(f'p_{d} double' for d in DOMAINS)}")


def rate_of(u: np.ndarray, most: float = math.inf) -> Column:
    """A document's rate: 1 less its posterior's product with ``u``, projected onto 0 <= r <= most."""
    moved = F.lit(1.0) - sum((F.col(f"p_{d}") * F.lit(float(x)) for d, x in zip(DOMAINS, u, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), moved if math.isinf(most) else F.least(F.lit(float(most)), moved))


def fit_rates(scored: DataFrame, targets: dict[str, float], total: float | None = None, ridge: float = 1e-3, most: float = math.inf, rounds: int = 60, tolerance: float = 1e-6, slack: float = 1e-3) -> dict:
    """``u`` of the rates (see ``rate_of``) for ``scored`` (n_tokens, p_<domain>); shares of domains that can't be reached are left out.

    ``reached`` and ``wanted`` are tokens by domain; ``unmet`` names domains that miss
    their target by more than ``slack`` of all tokens, and a warning tells of them.
    Rates have no upper bound but for ``most``.
    """
    k = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    tokens_of = F.col("n_tokens").cast("double")

    def summed(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by domain at ``u``, and the Gram matrix of the documents that can move there."""
        rate = rate_of(u, most)
        free = F.when((rate > 0) & (rate < F.lit(float(most))), tokens_of).otherwise(0.0)
        got = scored.agg(*(F.sum(rate * tokens_of * x).alias(f"s{i}") for i, x in enumerate(p)), *(F.sum(free * p[i] * p[j]).alias(f"m{i}{j}") for i in range(k) for j in range(i + 1))).first()
        gram = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                gram[i, j] = gram[j, i] = got[f"m{i}{j}"] or 0.0
        return np.array([got[f"s{i}"] or 0.0 for i in range(k)]), gram

    u = np.zeros(k)
    present, whole = summed(u)
    tokens = present.sum()
    if not tokens:
        return {"u": u, "most": most, "steps": 0, "reached": present, "wanted": present, "unmet": []}
    total = total or tokens
    asked = np.array([targets.get(d, 0.0) for d in DOMAINS])
    live = present > 1e-6 * tokens
    want = np.where(live, asked, 0)
    want = want / max(1e-12, want.sum()) * total
    scale = (whole / tokens) * np.outer(live, live) + np.diag(np.where(live, 1e-12, 1.0))

    def gradient(reached: np.ndarray, u: np.ndarray) -> np.ndarray:
        return np.where(live, (reached - want) / tokens - ridge * scale @ u, 0.0)

    reached, gram = present, whole
    g = gradient(reached, u)
    steps = 0
    while steps < rounds and np.abs(g).max() > tolerance:
        move = np.linalg.solve(gram / tokens * np.outer(live, live) + ridge * scale + np.diag(np.where(live, 1e-12, 1.0)), g)
        size = 1.0
        while steps < rounds:
            steps += 1
            tried = u + size * move
            now, its = summed(tried)
            new = gradient(now, tried)
            if np.abs(new).max() < np.abs(g).max() or size < 1e-3:
                break
            size /= 2
        if np.abs(new).max() >= np.abs(g).max():
            break
        u, reached, gram, g = tried, now, its, new
    asked = asked / max(1e-12, asked.sum()) * total
    unmet = [d for d, x, y in zip(DOMAINS, reached, asked, strict=True) if abs(x - y) > slack * total]
    if unmet:
        told = ", ".join(f"{d} {x / total:.4f} of {y / total:.4f}" for d, x, y in zip(DOMAINS, reached, asked, strict=True) if d in unmet)
        warnings.warn(f"mixing targets not met, shares reached of wanted: {told}", stacklevel=2)
    return {"u": u, "most": most, "steps": steps, "reached": reached, "wanted": want, "unmet": unmet}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep`` columns (but for those named as an output), n_tokens, p_<domain> and rate for every row of ``docs``."""
    keep = tuple(c for c in keep if c not in ("n_tokens", "rate", *(f"p_{d}" for d in DOMAINS)))
    scored = materialise(posteriors(docs, fit_domains(docs, labels), keep))
    fitted = fit_rates(scored, targets, **options)
    return scored.withColumn("rate", rate_of(fitted["u"], fitted["most"]))
