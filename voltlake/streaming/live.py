"""Bounded computations as Structured Streaming queries over samples or events with an event time ``ts``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltlake.operators.keys import ids


def segment_statistics(samples: DataFrame, length: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Tumbling segments by channel: count, rms, peak."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", length), *ids(samples), "channel_index").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"), F.max(F.abs("value")).alias("peak")).select(F.col("window.start").alias("start"), *ids(samples), "channel_index", "n", "rms", "peak")


def sliding_statistics(samples: DataFrame, length: str = "2 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Half-overlapping windows, as spectra use them."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", length, step), *ids(samples), "channel_index").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), *ids(samples), "channel_index", "n", "mean")


def burst_sessions(samples: DataFrame, threshold: float, gap: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Samples over the threshold, merged while they are closer than the gap."""
    return samples.where(F.abs("value") >= threshold).withWatermark("ts", late).groupBy(F.session_window("ts", gap), *ids(samples), "channel_index").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *ids(samples), "channel_index", "n", "peak")


def adaptive_peaks(samples: DataFrame, refractory_s: float = 0.3, late: str = "10 seconds", idle_s: float = 60.0) -> DataFrame:
    """Peaks above a threshold a quarter of the way from a running noise level to a running signal level.

    State by channel: the two levels, the last pick's time, and the last two
    samples. Samples of a channel must arrive in time order, as from an amplifier. A
    channel that is silent for ``idle_s`` of event time is forgotten.
    """
    keys = [*ids(samples), "channel_index"]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        signal, noise, last, t1, v1, v0 = state.get if state.exists else (1.0, 0.1, -1e18, 0.0, float("nan"), float("nan"))
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, v in zip(rows["t"].tolist(), rows["value"].abs().tolist(), strict=True):
            if v1 >= v0 and v1 > v:
                if v1 > noise + 0.25 * (signal - noise) and t1 - last >= refractory_s:
                    out.append((*key, t1, v1))
                    last, signal = t1, 0.125 * v1 + 0.875 * signal
                else:
                    noise = 0.125 * v1 + 0.875 * noise
            v0, v1, t1 = v1, v, t
        state.update((signal, noise, last, t1, v1, v0))
        _expire(state, rows, idle_s)
        yield pd.DataFrame(out, columns=[*keys, "t", "score"])

    return _by_channel(samples, run, keys, late, "t double, score double", "signal double, noise double, last double, t1 double, v1 double, v0 double")


def _expire(state: GroupState, rows: pd.DataFrame, idle_s: float) -> None:
    after = int((rows["t"].max() + idle_s) * 1000)
    if after > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(after)


def _by_channel(samples: DataFrame, run, keys: list[str], late: str, columns: str, state: str) -> DataFrame:
    """A stateful function of each channel's samples (keys, t in seconds, its other columns) in time order."""
    rest = [c for c in samples.columns if c not in (*keys, "ts")]
    timed = samples.withWatermark("ts", late).select("ts", *(F.col(c).cast("string" if c == "recording_id" else "long").alias(c) for c in keys), F.col("ts").cast("double").alias("t"), *rest)
    named = ", ".join(f"{c} {'string' if c == 'recording_id' else 'long'}" for c in keys)
    return timed.groupBy(*keys).applyInPandasWithState(run, f"{named}, {columns}", state, "append", GroupStateTimeout.EventTimeTimeout)


def causal_filter(samples: DataFrame, sections: list[tuple[list[float], list[float]]], late: str = "10 seconds", idle_s: float = 60.0) -> DataFrame:
    """Second-order sections (b, a with a[0] = 1) run forward only: (channel, t, value).

    State by channel: two values a section, so a stream cut into any batches gives
    what one pass over all samples gives. Samples must arrive in time order.
    """
    keys = [*ids(samples), "channel_index"]
    plain = [([float(v) for v in b], [float(v) for v in a]) for b, a in sections]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else [0.0] * (2 * len(plain))
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for x in rows["value"].tolist():
            for k, (b, a) in enumerate(plain):
                y = b[0] * x + held[2 * k]
                held[2 * k] = b[1] * x - a[1] * y + held[2 * k + 1]
                held[2 * k + 1] = b[2] * x - a[2] * y
                x = y
            out.append(x)
        state.update((held,))
        _expire(state, rows, idle_s)
        yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "t": rows["t"].to_numpy(), "value": out})

    return _by_channel(samples, run, keys, late, "t double, value double", "held array<double>")


def adaptive_cancelling(samples: DataFrame, order: int, mu: float, late: str = "10 seconds", idle_s: float = 60.0) -> DataFrame:
    """LMS noise cancelling: samples carry ``value`` and ``reference``; (channel, t, value, estimate), value less the estimate.

    State by channel: order + 1 weights and the last ``order`` references. The first
    ``order`` samples have the estimate 0. Samples must arrive in time order.
    """
    keys = [*ids(samples), "channel_index"]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        weights, past = (np.array(v, float) for v in state.get) if state.exists else (np.zeros(order + 1), np.zeros(0))
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for x, u in zip(rows["value"].tolist(), rows["reference"].tolist(), strict=True):
            taps = np.append(u, past)
            estimate = 0.0
            if len(taps) > order:
                estimate = float(weights @ taps)
                weights = weights + 2 * mu * (x - estimate) * taps
            past = taps[:order]
            out.append(estimate)
        state.update((weights.tolist(), past.tolist()))
        _expire(state, rows, idle_s)
        yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "t": rows["t"].to_numpy(), "value": rows["value"].to_numpy() - np.array(out), "estimate": out})

    return _by_channel(samples, run, keys, late, "t double, value double, estimate double", "weights array<double>, past array<double>")
