"""Kernels on traces, planned by what they need: one trace, or all channels of one recording.

Traces are rows (recording_id, channel_index, values). A kernel on one trace runs
in map tasks without a shuffle. A kernel on a recording gets that recording's
channels as one matrix: it is the unit of work, as in any tool that holds a
recording; recordings are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recorded(traces: DataFrame) -> DataFrame:
    return traces if "recording_id" in traces.columns else traces.withColumn("recording_id", F.lit("0"))


def map_traces(traces: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each trace replaced by the kernel's result; 64 traces at a time, so a batch of arrays stays small. Null and empty traces (of files that couldn't be read) stay, with all columns."""
    keys = [c for c in traces.columns if c != "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for v in part.column("values"):
                    x = np.array(v.values.to_numpy(zero_copy_only=False), float) if v.is_valid else None
                    rows.append(np.asarray(kernel(x), float) if x is not None and len(x) else x)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(rows, pa.list_(pa.float64()))], names=[*keys, "values"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.select(*keys).schema.fields)
    return traces.select(*keys, F.transform("values", lambda v: v.cast("double")).alias("values")).mapInArrow(run, f"{ddl}, values array<double>")


def by_recording(traces: DataFrame, kernel: Callable[..., pd.DataFrame], schema: str, beside: str | None = None) -> DataFrame:
    """Rows the kernel makes of a recording's matrix (channels x samples, in channel order), channel indices and the recording's value of the column ``beside``.

    Channels that are null or empty don't count, a recording without others gives no rows; channels of several lengths
    are cut to the shortest.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[v is not None and len(v) > 0 for v in pdf["values"]]].sort_values("channel_index")
        if not len(pdf):
            return pd.DataFrame(columns=["recording_id", *names])
        n = min(map(len, pdf["values"]))
        out = kernel(np.stack([np.asarray(v[:n], float) for v in pdf["values"]]), pdf["channel_index"].tolist(), *([pdf[beside].iloc[0]] if beside else []))
        out.insert(0, "recording_id", key[0])
        return out[["recording_id", *names]]

    return recorded(traces).select("recording_id", "channel_index", "values", *([beside] if beside else [])).groupBy("recording_id").applyInPandas(run, f"recording_id string, {schema}")


def matrix_kernel(traces: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Traces of the kernel's matrix, with their other columns. A recording whose channels differ in length stays as it is, and so do null and empty channels."""
    traces = recorded(traces)
    keys = [c for c in traces.columns if c != "values"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.select(*keys).schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel_index").reset_index(drop=True)
        full = [k for k, v in enumerate(pdf["values"]) if v is not None and len(v) > 0]
        if not full or len({len(pdf["values"][k]) for k in full}) > 1:
            return pdf[[*keys, "values"]]
        y = kernel(np.stack([np.asarray(pdf["values"][k], float) for k in full]))
        values = list(pdf["values"])
        for k, row in zip(full, y, strict=False):
            values[k] = row
        gone = set(full[len(y) :])
        return pdf.assign(values=values).drop(index=list(gone))[[*keys, "values"]]

    return traces.select(*keys, F.transform("values", lambda v: v.cast("double")).alias("values")).groupBy("recording_id").applyInPandas(run, f"{ddl}, values array<double>")


def filtered(traces: DataFrame, rate: float, **options) -> DataFrame:
    from voltlake.functions.dsp import band_pass

    return map_traces(traces, lambda x: band_pass(x, rate, **options))


def filtered_by_precision(traces: DataFrame, rate: float, wanted: str = "auto", **options) -> DataFrame:
    """``filtered`` in single precision where cut-offs, poles and rate allow, with the column ``precision`` that was used for a trace (null for null and empty ones)."""
    from voltlake.functions.dsp import band_pass_by_precision

    keys = [c for c in traces.columns if c not in ("values", "precision")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, used = [], []
            for v in batch.column("values"):
                x = np.array(v.values.to_numpy(zero_copy_only=False), float) if v.is_valid else None
                y, kind = band_pass_by_precision(x, rate, wanted, **options) if x is not None and len(x) else (x, None)
                rows.append(y)
                used.append(kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(rows, pa.list_(pa.float64())), pa.array(used, pa.string())], names=[*keys, "values", "precision"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in traces.select(*keys).schema.fields)
    return traces.select(*keys, F.transform("values", lambda v: v.cast("double")).alias("values")).mapInArrow(run, f"{ddl}values array<double>, precision string")


def line_reduced(traces: DataFrame, rate: float, **options) -> DataFrame:
    from voltlake.functions.dsp import line_noise_reduced

    return map_traces(traces, lambda x: line_noise_reduced(x, rate, **options))


def wavelet_reduced(traces: DataFrame, part: str = "cleaned", **options) -> DataFrame:
    from voltlake.functions.wavelets import reduce

    return map_traces(traces, lambda x: reduce(x, **options)[0 if part == "cleaned" else 1])


def r_wave_events(traces: DataFrame, rate: float, algorithm: str = "pan_tompkins", **options) -> DataFrame:
    from voltlake.functions.cardiac import r_waves

    return by_recording(traces, lambda x, _: pd.DataFrame(r_waves(x, rate, algorithm, **options), columns=["sample_index", "score"]), "sample_index long, score double")


def bcg_events(traces: DataFrame, rate: float, method: str = "periodic") -> DataFrame:
    from voltlake.functions.cardiac import bcg_periodic, bcg_refined, bcg_spatial

    def run(x: np.ndarray, _: list[int]) -> pd.DataFrame:
        found = bcg_periodic(x, rate) if method == "periodic" else bcg_spatial(x, rate)
        if method == "refined":
            found, _t = bcg_refined(x, rate, found)
        return pd.DataFrame({"sample_index": np.array(found, int)})

    return by_recording(traces, run, "sample_index long")


def cardiac_trace(traces: DataFrame, rate: float, kind: str = "power") -> DataFrame:
    """One trace a recording that follows the heart: rms-weighted power of the cardiac band, or the first spatial component ('virtual')."""
    from voltlake.functions.cardiac import cardiac_power, virtual_ecg

    def run(x: np.ndarray, _: list[int]) -> pd.DataFrame:
        y = cardiac_power(x, rate) if kind == "power" else virtual_ecg(x)
        return pd.DataFrame({"sample_index": np.arange(len(y)), "value": y})

    return by_recording(traces, run, "sample_index long, value double")


def reduction_candidates(traces: DataFrame, half: int, top: int) -> DataFrame:
    """Where an artifact estimate is largest: channel, sample and rms around it, the strongest ``top`` of a recording."""
    from voltlake.functions.templates import reduction_candidates as find

    return by_recording(traces, lambda x, c: pd.DataFrame([(c[k], p, v) for k, p, v in find(x, half, top)], columns=["channel_index", "sample_index", "rms"]), "channel_index int, sample_index long, rms double")


def cleaning_preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """Variance retained, correlation, rms of what was removed and reduction of the peak, by recording; both recordings' traces meet by channel."""
    from voltlake.functions.templates import cleaning_preview as compare

    both = recorded(before).select("recording_id", "channel_index", F.col("values").alias("x")).join(recorded(after).select("recording_id", "channel_index", F.col("values").alias("y")), ["recording_id", "channel_index"])

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.stack([np.asarray(v, float) for v in pdf.sort_values("channel_index")[c]]) for c in ("x", "y"))
        found = compare(x, y)
        return pd.DataFrame([(key[0], *(found[k] for k in ("variance_retained", "r", "removed_rms", "peak_reduction")))], columns=["recording_id", "variance_retained", "r", "removed_rms", "peak_reduction"])

    return both.groupBy("recording_id").applyInPandas(run, "recording_id string, variance_retained double, r double, removed_rms double, peak_reduction double")


def template_events(traces: DataFrame, start: int, width: int, threshold: float, method: str = "waveform") -> DataFrame:
    """Matches of an exemplar window: waveform, trajectory or wavelet."""
    from voltlake.functions import templates as t

    if method == "wavelet":
        return _wavelet_events(traces, start, width, threshold)
    match = {"waveform": t.waveform_matches, "trajectory": t.trajectory_matches}[method]
    return by_recording(traces, lambda x, _: pd.DataFrame(match(x, x[:, start : start + width], threshold), columns=["sample_index", "score"]), "sample_index long, score double")


def _wavelet_events(traces: DataFrame, start: int, width: int, threshold: float) -> DataFrame:
    """``matched.wavelet_matches`` of traces cut to their recording's shortest; a null id, which joins would lose, is a recording. A recording that ends within the exemplar has no matches."""
    from voltlake.operators.layout import to_samples
    from voltlake.operators.matched import wavelet_matches
    from voltlake.operators.tables import written

    name = F.coalesce(F.concat(F.lit("="), F.col("recording_id").cast("string")), F.lit(""))
    full = recorded(traces).where(F.size("values") > 0).select(name.alias("recording_id"), "channel_index", F.transform("values", lambda v: v.cast("double")).alias("values"))
    shortest = full.groupBy("recording_id").agg(F.min(F.size("values")).alias("__n"))
    cut = full.join(shortest, "recording_id").select("recording_id", "channel_index", F.slice("values", F.lit(1), F.col("__n")).alias("values"))
    found = wavelet_matches(written(to_samples(cut, "recording_id", "channel_index")), start, width, threshold)
    return found.withColumn("recording_id", F.when(F.col("recording_id") != "", F.expr("substring(recording_id, 2)"))).select("recording_id", "sample_index", "score")


def wavelet_ranges(traces: DataFrame, rate: float, **options) -> DataFrame:
    from voltlake.functions.templates import wavelet_explore

    return by_recording(traces, lambda x, _: pd.DataFrame(wavelet_explore(x, rate, **options), columns=["start_sample", "end_sample", "peak"]), "start_sample long, end_sample long, peak double")


def wavelet_goodness(traces: DataFrame) -> DataFrame:
    from voltlake.functions.templates import channel_goodness

    return by_recording(traces, lambda x, c: pd.DataFrame({"channel_index": c, "score": channel_goodness(x)}), "channel_index int, score double")


def artifact_cleaned(traces: DataFrame, artifacts: list[dict], rate: float) -> DataFrame:
    """Artifacts in order, each on the result of the one before: method (template, obs, ssp), times, width, components, channels."""
    from voltlake.functions import cleaning as c

    def run(x: np.ndarray) -> np.ndarray:
        for a in artifacts:
            rows = a.get("channels") or list(range(len(x)))
            starts = c.event_starts(a["times"], rate, a["width"], x.shape[1])
            method = {"template": lambda y, s, w, _: c.template_removed(y, s, w), "obs": c.obs_removed, "ssp": c.ssp_removed}[a["method"]]
            x = x.copy()
            x[rows] = method(x[rows], starts, a["width"], a.get("components", 2))
        return x

    return matrix_kernel(traces, run)


def obs_variance(traces: DataFrame, times: list[float], rate: float, width: int) -> DataFrame:
    from voltlake.functions import cleaning as c

    def run(x: np.ndarray, _: list[int]) -> pd.DataFrame:
        return pd.DataFrame(c.obs_variance(x, c.event_starts(times, rate, width, x.shape[1]), width), columns=["component", "explained", "cumulative", "remaining"])

    return by_recording(traces, run, "component int, explained double, cumulative double, remaining double")


def gradient_corrected(traces: DataFrame, rate: float, starts: list[int], spacing: int, **options) -> DataFrame:
    from voltlake.functions.cleaning import fastr

    return matrix_kernel(traces, lambda x: fastr(x, rate, np.array(starts, int), spacing, **options))


def ica_cleaned(traces: DataFrame, rate: float, positions: np.ndarray, reject: tuple[str, ...] = ("Eye", "Heart", "Muscle", "Line Noise"), method: str = "picard") -> DataFrame:
    """Traces less the components of rejected labels; fit, labels and removal run over blocks of samples."""
    from voltlake.operators import components as c
    from voltlake.operators.layout import to_samples, to_traces
    from voltlake.operators.tables import written

    samples = written(to_samples(recorded(traces), "recording_id", "channel_index"))
    layout = traces.sparkSession.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(positions)], "channel_index int, x double, y double")
    models = c.fit_components(samples, method)
    chosen = written(c.label_components(samples, models, layout, rate).where(F.col("label").isin(*reject)).select("recording_id", "component"))  # removal reads it twice, labels take a pass over the samples
    return to_traces(c.without_components(samples, models, chosen), "recording_id", "channel_index")


def interpolated_channels(samples: DataFrame, geometry: list[tuple[int, float, float, float]], bad: list[int]) -> DataFrame:
    """Bad channels as spline-weighted sums of the good ones; the weights are a sensor table."""
    from voltlake.functions.dsp import spline_weights
    from voltlake.operators.joins import weighted_sources

    good = [g for g in geometry if g[0] not in bad]
    rows = []
    for target in (g for g in geometry if g[0] in bad):
        w = spline_weights(np.array([g[1:] for g in good]), np.array(target[1:]))
        rows += [(target[0], g[0], float(v)) for g, v in zip(good, w if w is not None else [], strict=False)]
    weights = samples.sparkSession.createDataFrame(rows, "target int, channel_index int, weight double")
    return weighted_sources(samples, weights).withColumnRenamed("target", "channel_index")
