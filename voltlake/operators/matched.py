"""Matched filters over blocks: templates found in recordings that no task holds.

The projection of a channel on a template is a correlation by FFT over blocks with a halo of
the template's width (overlap-save). A block hands on its peaks and the sums that
the threshold needs, not the projection. Greedy steps are folds over islands of candidates,
stitched over block edges (``topk.islands``); what they start from is written, as a fold's plan names it several times. Scores are taken at the candidates only, from
blocks of all channels.

Edge cases: a recording shorter than the template has no matches; a template without variance
scores 0 everywhere; ties go to the lower channel and the earlier start; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions import templates as kernels
from voltlake.functions.templates import unit
from voltlake.operators import topk
from voltlake.operators.blocks import halo_blocks, matrix_blocks
from voltlake.operators.keys import ids
from voltlake.operators.tables import written

SIZE = 16_384


def exemplar(samples: DataFrame, start: int, width: int) -> DataFrame:
    """Keys, channel_index, template: the window of every channel at ``start``."""
    keys = [*ids(samples), "channel_index"]
    inside = samples.where(F.col("sample_index").between(start, start + width - 1))
    packed = inside.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sample_index", F.col("value").cast("double").alias("value")))).alias("s"))
    return packed.where(F.size("s") == width).select(*keys, F.transform("s", lambda x: x["value"]).alias("template"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # without recordings, b is one row


def projection_peaks(samples: DataFrame, templates: DataFrame, width: int, size: int = SIZE) -> DataFrame:
    """Keys, n, total, squares, peaks (structs start, score) by block: local maxima of the absolute projection of each channel in ``templates`` on its template."""
    keys = [*ids(samples), "channel_index"]
    blocks = halo_blocks(samples.join(templates.select(*keys), keys), size, 1, width).join(templates, keys)  # a start more on each side tells whether an edge is a peak
    names = [*keys, "block"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values, t, first, block in zip(batch.column("values"), batch.column("template"), batch.column("first").to_pylist(), batch.column("block").to_pylist(), strict=True):
                x, t = (np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in (values, t))
                m = len(x) - width + 1
                if m < 1:
                    out.append((0, 0.0, 0.0, []))
                    continue
                n = 1 << (len(x) + width - 1).bit_length()
                p = np.abs(np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(unit(t), n)), n)[:m])
                skip = block * size - first
                own = p[skip : skip + size]
                at = np.arange(max(1, skip), min(m - 1, skip + size))
                at = at[(p[at] >= p[at - 1]) & (p[at] > p[at + 1])]
                out.append((len(own), float(own.sum()), float((own * own).sum()), [{"start": int(first + a), "score": float(p[a])} for a in at]))
            n, total, squares, peaks = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(squares, pa.float64()), pa.array(peaks, pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())])))], names=[*names, "n", "total", "squares", "peaks"])

    return blocks.select(*names, "first", "values", "template").mapInArrow(run, f"{ddl}, n long, total double, squares double, peaks array<struct<start:bigint,score:double>>")


def candidate_starts(samples: DataFrame, templates: DataFrame, width: int, size: int = SIZE) -> DataFrame:
    """Keys, start: peaks of the projection on the strongest template channel, at mean + 1.25 deviations or more and a third of a window apart; with fewer than 12, every quarter window."""
    keys = ids(samples)
    energy = F.aggregate("template", F.lit(0.0), lambda a, v: a + v * v)
    strongest = templates.groupBy(*keys).agg(F.max(F.struct(energy.alias("e"), (-F.col("channel_index")).alias("c"), F.col("template").alias("t"))).alias("x")).select(*keys, (-F.col("x.c")).cast(templates.schema["channel_index"].dataType).alias("channel_index"), F.col("x.t").alias("template"))
    found = written(projection_peaks(samples, strongest, width, size))
    mean = F.sum("total") / F.sum("n")
    level = found.groupBy(*keys).agg((mean + 1.25 * F.sqrt(F.greatest(F.sum("squares") / F.sum("n") - mean * mean, F.lit(0.0)))).alias("level"), F.sum("n").alias("places"))
    peaks = _joined(found.select(*keys, F.explode("peaks").alias("p")).select(*keys, "p.*"), level, keys).where(F.col("score") >= F.col("level")).select(*keys, "start", "score")
    kept = written(topk.strongest_non_overlapping(peaks, max(1, width // 3), *keys, size=size))
    counted = level.join(kept.groupBy(*keys).agg(F.count("*").alias("kept")), keys, "left") if keys else level.crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"))))  # one row
    grid = counted.where((F.coalesce("kept", F.lit(0)) < 12) & (F.col("places") > 0)).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1, F.lit(max(1, width // 4)).cast("long"))).alias("start"))
    enough = counted.where("kept >= 12").select(*keys)
    return (kept.join(enough, keys) if keys else kept.crossJoin(F.broadcast(enough))).select(*keys, "start").unionByName(grid)


def _scored(samples: DataFrame, templates: DataFrame, starts: DataFrame, width: int, score: Callable[[list[tuple[np.ndarray, np.ndarray]], np.ndarray], np.ndarray], size: int, halo: int = 0) -> DataFrame:
    """Keys, start, score: what ``score`` makes of a block's channels with their templates, and of the starts in it; ``halo`` samples on both sides of the windows. Channels without a template don't count."""
    keys = ids(samples)
    listed = starts.select(*keys, F.floor(F.col("start") / size).alias("block"), "start").groupBy(*keys, "block").agg(F.sort_array(F.collect_set("start")).alias("starts"))  # at most a block's samples
    models = templates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("channel_index", "template"))).alias("models"))
    blocks = _joined(matrix_blocks(samples, size, halo, width - 1 + halo).join(listed, [*keys, "block"]), models, keys)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in blocks.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                known = {m["channel_index"]: np.asarray(m["template"]) for m in row["models"]}
                pairs = [(np.asarray(x), known[c]) for c, x in zip(row["channels"], row["rows"], strict=True) if c in known]
                at = np.array(row["starts"], np.int64) - row["first"]
                if not pairs:
                    continue
                at = at[at + width <= min(len(x) for x, _ in pairs)]
                found = score(pairs, at) if len(at) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]] * len(at), batch.column(c).type) for c in keys), pa.array(at + row["first"]), pa.array(found)], names=[*keys, "start", "score"])

    return blocks.select(*keys, "first", "channels", "rows", "starts", "models").mapInArrow(run, f"{ddl}start long, score double")


def waveform_scores(samples: DataFrame, templates: DataFrame, starts: DataFrame, width: int, polarity: str = "same", size: int = SIZE) -> DataFrame:
    """Keys, start, score: correlation with the template by channel, weighted by the template's rms."""

    def score(pairs: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> np.ndarray:
        weight = np.sqrt([(t * t).mean() for _, t in pairs])
        weight = weight / max(1e-12, weight.sum())
        found = np.zeros(len(at))
        for (x, t), w in zip(pairs, weight, strict=True):
            found += w * (unit(np.lib.stride_tricks.sliding_window_view(x, width)[at]) @ unit(t))
        return np.abs(found) if polarity == "both" else -found if polarity == "opposite" else found

    return _scored(samples, templates, starts, width, score, size)


def wavelet_scores(samples: DataFrame, templates: DataFrame, starts: DataFrame, width: int, levels: int = 5, size: int = SIZE) -> DataFrame:
    """Keys, start, score as ``templates.wavelet_scores``. The halo is as wide as the widest detail reaches, so details are those of the whole trace, clamped at its ends only."""

    def score(pairs: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> np.ndarray:
        n = min(len(x) for x, _ in pairs)
        return kernels.wavelet_scores(np.stack([np.asarray(x[:n], float) for x, _ in pairs]), np.stack([t for _, t in pairs]).astype(float), at, levels)

    return _scored(samples, templates, starts, width, score, size, 2 * (2**levels - 1))


def waveform_matches(samples: DataFrame, start: int, width: int, threshold: float, polarity: str = "same", merge_share: float = 0.5, size: int = SIZE) -> DataFrame:
    """Keys, sample_index (centre), score of the matches of the window at ``start`` in its own recording."""
    keys = ids(samples)
    size = max(size, width)
    templates = exemplar(samples, start, width)
    ends = samples.groupBy(*keys).agg((F.max("sample_index") + 1 - width).alias("last"))
    near = _joined(candidate_starts(samples, templates, width, size), ends, keys)
    fine = near.select(*keys, F.explode(F.transform(F.sequence(F.lit(-(width // 8)), F.lit(width // 8)), lambda d: F.least(F.greatest(F.col("start") + d, F.lit(0)), F.col("last")))).alias("start")).distinct()
    hits = written(waveform_scores(samples, templates, fine, width, polarity, size).where(F.col("score") >= threshold))
    return topk.merge_nearby(hits, int(width * merge_share), *keys, size=size).select(*keys, (F.col("start") + width // 2).alias("sample_index"), "score")


def wavelet_matches(samples: DataFrame, start: int, width: int, threshold: float, levels: int = 5, size: int = SIZE) -> DataFrame:
    """Keys, sample_index (centre), score of the windows whose wavelet details match those of the window at ``start`` in its own recording."""
    keys = ids(samples)
    size = max(size, width)
    templates = exemplar(samples, start, width)
    near = candidate_starts(samples, templates, width, size)
    hits = written(wavelet_scores(samples, templates, near, width, levels, size).where(F.col("score") >= threshold))
    return topk.merge_nearby(hits, width // 2, *keys, size=size).select(*keys, (F.col("start") + width // 2).alias("sample_index"), "score")
