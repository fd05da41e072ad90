"""Recursive computations on streams whose samples come late and out of order.

Samples wait in list state until the watermark has passed them, then run through the
recursion in time order; an event-time timer releases what is left when a channel falls silent. So any
batches, shuffled within the allowed lateness, give what one pass in order gives; a
sample is given out once, when nothing earlier can come. A sample later than that is dropped, as Spark's
watermark drops it.

A step takes the values held by channel and the released rows in order, and
returns both anew; the three steps here hold a filter's states, an adaptive filter's weights and past,
and a detector's levels. The session needs the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voltlake.operators.keys import ids

Step = Callable[[list[float], pd.DataFrame], tuple[list[float], pd.DataFrame]]


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds samples back until the watermark has passed them, then runs the step on them in order of time."""

    def __init__(self, step: Step, start: list[float], keys: list[str], columns: list[str], out: list[str]) -> None:
        self.step, self.start, self.keys, self.columns, self.out = step, start, keys, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} double" for c in self.columns))
        self.held = handle.getValueState("held", "held array<double>")

    def _release(self, key: tuple, new: pd.DataFrame | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=self.columns, dtype=float)
        rows = old if new is None else pd.concat([old, new[self.columns].astype(float)]) if len(old) else new[self.columns].astype(float)
        ready = rows["t"] * 1000 <= watermark_ms
        left, rows = rows[~ready], rows[ready].sort_values("t", kind="stable")
        self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(left):
            self.waiting.put([tuple(map(float, r)) for r in left.itertuples(index=False)])
            self.handle.registerTimer(int(np.ceil(left["t"].max() * 1000)))
        if len(rows):
            state, found = self.step(list(self.held.get()[0]) if self.held.exists() else list(self.start), rows)
            self.held.update(([float(v) for v in state],))
            for name, value in zip(self.keys, key, strict=True):
                found[name] = value
            yield found[[*self.keys, *self.out]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._release(key, pd.concat(list(rows)), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_order(samples: DataFrame, step: Step, start: list[float], out: list[str], late: str, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """``out`` columns (double) of the step over each channel's samples (ts, channel_index, ``columns``) in time order."""
    keys = [*ids(samples), "channel_index"]
    kind = {"recording_id": "string", "channel_index": "long"}
    timed = samples.withWatermark("ts", late).select("ts", *(F.col(k).cast(kind[k]).alias(k) for k in keys), F.col("ts").cast("double").alias("t"), *columns)
    schema = ", ".join([*(f"{k} {kind[k]}" for k in keys), *(f"{c} double" for c in out)])
    return timed.groupBy(*keys).transformWithStateInPandas(InOrder(step, start, keys, ["t", *columns], out), schema, "append", "eventTime")


def causal_filter(samples: DataFrame, sections: list[tuple[list[float], list[float]]], late: str = "10 seconds") -> DataFrame:
    """Second-order sections (b, a with a[0] = 1) run forward only: keys, t, value."""
    plain = [(np.asarray(b, float), np.asarray(a, float)) for b, a in sections]

    def step(held: list[float], rows: pd.DataFrame) -> tuple[list[float], pd.DataFrame]:
        from voltlake.operators.recursive import run_section

        x, states = rows["value"].to_numpy(float)[:, None], np.array(held).reshape(-1, 2, 1)
        left = []
        for section, state in zip(plain, states, strict=True):
            x, state = run_section(section, x, state)
            left.append(state)
        return np.stack(left).ravel().tolist() if left else [], pd.DataFrame({"t": rows["t"].to_numpy(), "value": x[:, 0]})

    return in_order(samples, step, [0.0] * (2 * len(plain)), ["t", "value"], late)


def adaptive_cancelling(samples: DataFrame, order: int, mu: float, late: str = "10 seconds") -> DataFrame:
    """LMS noise cancelling of ``value`` by ``reference``: keys, t, value (less the estimate), estimate; the first ``order`` samples have the estimate 0."""

    def step(held: list[float], rows: pd.DataFrame) -> tuple[list[float], pd.DataFrame]:
        weights, past = np.array(held[: order + 1]), np.array(held[order + 1 :])
        found = np.zeros(len(rows))
        for k, (x, u) in enumerate(zip(rows["value"].tolist(), rows["reference"].tolist(), strict=True)):
            taps = np.append(u, past)
            if len(taps) > order:
                found[k] = weights @ taps
                weights = weights + 2 * mu * (x - found[k]) * taps
            past = taps[:order]
        return [*weights, *past], pd.DataFrame({"t": rows["t"].to_numpy(), "value": rows["value"].to_numpy() - found, "estimate": found})

    return in_order(samples, step, [0.0] * (order + 1), ["t", "value", "estimate"], late, ("value", "reference"))


def adaptive_peaks(samples: DataFrame, refractory_s: float = 0.3, late: str = "10 seconds") -> DataFrame:
    """Peaks above a threshold a quarter of the way from a running noise level to a running signal level, ``refractory_s`` apart: keys, t, score."""

    def step(held: list[float], rows: pd.DataFrame) -> tuple[list[float], pd.DataFrame]:
        signal, noise, last, at, now, before = held
        out = []
        for t, v in zip(rows["t"].tolist(), rows["value"].abs().tolist(), strict=True):
            if now >= before and now > v:
                if now > noise + 0.25 * (signal - noise) and at - last >= refractory_s:
                    out.append((at, now))
                    last, signal = at, 0.125 * now + 0.875 * signal
                else:
                    noise = 0.125 * now + 0.875 * noise
            before, now, at = now, v, t
        return [signal, noise, last, at, now, before], pd.DataFrame(out, columns=["t", "score"], dtype=float)

    return in_order(samples, step, [1.0, 0.1, -1e18, 0.0, float("nan"), float("nan")], ["t", "score"], late)
