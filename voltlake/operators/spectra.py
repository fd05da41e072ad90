"""Spectral power and connectivity of kept segments, and their long result table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions import dsp
from voltlake.operators.kernels import by_recording, recorded
from voltlake.operators.keys import ids
from voltlake.schema import BANDS

FLOOR = 1e-12


Segments = list[tuple[int, int]] | dict[str, list[tuple[int, int]]] | DataFrame


def with_segments(traces: DataFrame, segments: Segments) -> tuple[DataFrame, int]:
    """Traces with __segments, their recording's segments [a, b) in order, and the longest segment's samples.

    Segments are one list for all recordings, a list by recording, or a table (recording_id where there are
    several, start_sample, end_sample inclusive), which is joined and never read by the driver.
    """
    spark = traces.sparkSession
    if isinstance(segments, dict):
        segments = spark.createDataFrame([(name, a, b - 1) for name, part in segments.items() for a, b in part], "recording_id string, start_sample long, end_sample long")
    elif isinstance(segments, list):
        segments = spark.createDataFrame([(a, b - 1) for a, b in segments], "start_sample long, end_sample long")
    named = ids(traces, segments)
    one = F.struct(F.col("start_sample").cast("long").alias("a"), (F.col("end_sample") + 1).cast("long").alias("b"))
    listed = segments.groupBy(*named).agg(F.sort_array(F.collect_list(one)).alias("__segments"))
    most = segments.agg(F.max(F.col("end_sample") + 1 - F.col("start_sample"))).first()[0]
    return (traces.join(listed, named, "left") if named else traces.crossJoin(F.broadcast(listed))), int(most or 16)  # without recordings, one row


def pooled_spectra(traces: DataFrame, segments: Segments, rate: float, whole: int = 0) -> DataFrame:
    """A row a recording, channel and bin: power pooled over the windows of the kept segments [start, end).

    With ``whole``, the samples of a segment that the recording's end doesn't cut, a shorter one has the windows of a whole one as far as its samples go.
    """
    joined, longest = with_segments(traces, segments)
    length, named = dsp.power_of_two_length(rate, max(longest, whole)), ids(traces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, c, v, mine in zip(batch.column("recording_id").to_pylist(), batch.column("channel_index").to_pylist(), batch.column("values"), batch.column("__segments").to_pylist(), strict=True):
                x = np.array(v.values.to_numpy(zero_copy_only=False), float)
                parts = [dsp.window_spectra(x[s["a"] : s["b"]], rate, length, whole=whole)[1] for s in mine or []]
                all_ = np.concatenate(parts) if parts else np.zeros((0, length // 2))
                power = (np.abs(all_) ** 2).mean(0) if len(all_) else np.zeros(length // 2)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(power), pa.string()), pa.array(np.full(len(power), c), pa.int32()), pa.array(np.arange(len(power)), pa.int32()), pa.array(np.arange(len(power)) * rate / length), pa.array(power), pa.array(np.full(len(power), len(all_)), pa.int64())], names=["recording_id", "channel_index", "bin", "hz", "power", "windows"])

    shipped = recorded(joined).where("values IS NOT NULL").select(F.col("recording_id").cast("string").alias("recording_id"), "channel_index", "values", "__segments")
    found = shipped.mapInArrow(run, "recording_id string, channel_index int, bin int, hz double, power double, windows long")
    return found if named else found.drop("recording_id")


def band_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(BANDS)], "band_no int, band string, low double, high double")


def band_powers(spectra: DataFrame) -> DataFrame:
    """Absolute power (sum of bins, both edges included), share of all bands, and log10, by channel and band."""
    bands = F.broadcast(band_table(spectra.sparkSession))  # five rows
    named = ids(spectra)
    each = spectra.crossJoin(bands).groupBy(*named, "channel_index", "band_no", "band").agg(F.sum(F.when(F.col("hz").between(F.col("low"), F.col("high")), F.col("power")).otherwise(0.0)).alias("absolute"))
    total = each.groupBy(*named, "channel_index").agg(F.sum("absolute").alias("total"))
    return each.join(total, [*named, "channel_index"]).select(*named, "channel_index", "band_no", "band", "absolute", F.when(F.col("total") > 0, F.col("absolute") / F.col("total")).otherwise(0.0).alias("relative"), F.log10(F.greatest("absolute", F.lit(FLOOR))).alias("log10_power"))


def band_summary(powers: DataFrame) -> DataFrame:
    return powers.groupBy(*ids(powers), "band").agg(F.avg("absolute").alias("absolute"), F.avg("relative").alias("relative"))


def spectral_outliers(spectra: DataFrame, high: float = 1.8935, low: float = -5.0) -> DataFrame:
    """z of log10 mean power from 1 to 100 Hz across a recording's channels (more than two), and whether it is out of bounds."""
    named = ids(spectra)
    each = spectra.where("hz BETWEEN 1 AND 100").groupBy(*named, "channel_index").agg(F.log10(F.greatest(F.avg("power"), F.lit(FLOOR))).alias("v"))
    w = Window.partitionBy(*named)  # a recording's channels
    each = each.select("*", F.avg("v").over(w).alias("m"), F.stddev_pop("v").over(w).alias("sd"), F.count("*").over(w).alias("n"))
    z = F.when((F.col("n") > 2) & (F.col("sd") > 1e-12), (F.col("v") - F.col("m")) / F.when(F.col("sd") > 1e-12, F.col("sd"))).otherwise(0.0)
    return each.select(*named, "channel_index", "v", z.alias("z")).withColumn("bad", (F.col("z") > high) | (F.col("z") < low))


def advanced_spectral(spectra: DataFrame, line: float = 60.0) -> DataFrame:
    """Aperiodic slope (2 to 40 Hz, near the line left out), muscle ratio (20-40 over 2-20 Hz), line SNR (peak within 1 bin over the median of bins 2 to 6 away)."""
    hz, p = F.col("hz"), F.greatest("power", F.lit(FLOOR))
    near = F.abs(hz / line - F.round(hz / line)) * line <= 2
    use = hz.between(2, 40) & ~(near & (hz > line / 2))
    step = F.max(F.when(F.col("bin") == 1, hz))
    named = ids(spectra)
    first = spectra.groupBy(*named, "channel_index").agg(
        F.regr_slope(F.when(use, F.log10(p)), F.when(use, F.log10(hz))).alias("slope"),
        F.count_if(use).alias("bins"),
        (F.sum(F.when((hz > 20) & (hz <= 40), p)) / F.greatest(F.sum(F.when(hz.between(2, 20), p)), F.lit(FLOOR))).alias("emg_ratio"),
        F.round(F.lit(line) / step).alias("line_bin"),
    )
    d = F.abs(F.col("bin") - F.col("line_bin"))
    snr = spectra.join(first.select(*named, "channel_index", "line_bin"), [*named, "channel_index"]).groupBy(*named, "channel_index").agg((F.max(F.when(d <= 1, F.col("power"))) / F.greatest(F.percentile(F.when(d.between(2, 6), F.col("power")), 0.5), F.lit(FLOOR))).alias("line_snr"))
    return first.join(snr, [*named, "channel_index"]).select(*named, "channel_index", F.when(F.col("bins") >= 8, F.col("slope")).alias("slope"), "emg_ratio", "line_snr")


def connectivity(traces: DataFrame, segments: Segments, rate: float, nodes: dict[str, list[int]] | None = None, whole: int = 0) -> DataFrame:
    """Coherence, imaginary coherence, PLV, wPLI and amplitude correlation of node pairs by band.

    Sums are pooled over bins and windows (``whole`` as in ``pooled_spectra``) before the ratio. Products of all pairs
    are made as matrix products within the recording's task, so they aren't
    shuffled.
    """
    joined, longest = with_segments(traces, segments)
    length = dsp.power_of_two_length(rate, max(longest, whole))

    def run(x: np.ndarray, channels: list[int], found: list[dict] | None) -> pd.DataFrame:
        mine = [(s["a"], s["b"]) for s in (found if found is not None else [])]
        at = {c: i for i, c in enumerate(channels)}
        named = nodes or {str(c): [c] for c in channels}
        keys = list(named)
        signals = np.stack([np.nan_to_num(np.nanmean(np.where(np.isfinite(x[[at[c] for c in named[k] if c in at]]), x[[at[c] for c in named[k] if c in at]], np.nan), 0)) for k in keys])
        spectra = np.stack([np.concatenate([dsp.window_spectra(s[a:b], rate, length, whole=whole)[1] for a, b in mine] or [np.zeros((0, length // 2), complex)]) for s in signals])
        hz = np.arange(length // 2) * rate / length
        left, right = np.triu_indices(len(keys), 1)
        rows = []
        for band, low, high in BANDS:
            part = spectra[:, :, (hz >= low) & (hz <= high)]
            flat = part.reshape(len(keys), -1)
            power = (np.abs(flat) ** 2).sum(1)
            cross = flat @ flat.conj().T
            phase = flat / np.maximum(np.abs(flat), 1e-300)
            locked = np.abs(phase @ phase.conj().T) / max(1, flat.shape[1])
            amplitude = np.abs(part).mean(2) if part.shape[2] else np.zeros(part.shape[:2])
            centred = amplitude - amplitude.mean(1, keepdims=True)
            size = np.linalg.norm(centred, axis=1)
            scale = np.sqrt(np.outer(power, power))
            ok = np.outer(size, size) > 1e-12
            aec = np.where(ok, centred @ centred.T / np.where(ok, np.outer(size, size), 1), 0)
            wpli = np.zeros((len(keys), len(keys)))
            for i in range(len(keys)):
                im = np.imag(flat[i] * flat.conj())
                below = np.abs(im).sum(1)
                wpli[i] = np.where(below > 1e-12, np.abs(im.sum(1)) / np.where(below > 1e-12, below, 1), 0)
            safe = np.where(scale > 1e-12, scale, 1)
            values = {"coherence": np.where(scale > 1e-12, np.abs(cross) ** 2 / safe**2, 0), "imaginary_coherence": np.where(scale > 1e-12, np.abs(cross.imag) / safe, 0), "plv": locked, "wpli": wpli, "aec": aec}
            for metric, m in values.items():
                rows.append(pd.DataFrame({"node_a": [keys[i] for i in left], "node_b": [keys[j] for j in right], "band": band, "metric": metric, "value": m[left, right]}))
        return pd.concat(rows)

    return by_recording(joined, run, "node_a string, node_b string, band string, metric string, value double", beside="__segments")


def result_rows(powers: DataFrame, pairs: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """The long table of nine columns, after the recording where there is one: row_type, scope, channel_index (from 1), channel_name, node_a, node_b, band, metric, value."""
    key = ids(powers) if pairs is None else ids(powers, pairs)
    named = powers.join(names, [*ids(powers, names), "channel_index"], "left") if names is not None else powers.withColumn("channel_name", F.concat(F.lit("Ch "), F.col("channel_index") + 1))
    none = F.lit(None).cast("string")
    channel = named.select(*key, F.lit("spectral").alias("row_type"), F.lit("channel").alias("scope"), (F.col("channel_index") + 1).alias("channel_index"), "channel_name", none.alias("node_a"), none.alias("node_b"), "band", F.expr("stack(3, 'absolute', absolute, 'relative', relative, 'log10', log10_power) AS (metric, value)"))
    summary = band_summary(powers).select(*key, F.lit("spectral").alias("row_type"), F.lit("summary").alias("scope"), F.lit(None).cast("int").alias("channel_index"), none.alias("channel_name"), none.alias("node_a"), none.alias("node_b"), "band", F.expr("stack(2, 'absolute', absolute, 'relative', relative) AS (metric, value)"))
    out = channel.unionByName(summary)
    if pairs is not None:
        out = out.unionByName(pairs.select(*key, F.lit("connectivity").alias("row_type"), F.lit("pair").alias("scope"), F.lit(None).cast("int").alias("channel_index"), none.alias("channel_name"), "node_a", "node_b", "band", "metric", "value"))
    return out
