"""Tables as recordings, and the two layouts of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.operators.keys import ids


def signal_from_vectors(vectors: DataFrame, index: str = "vec_id", values: str = "embedding") -> DataFrame:
    """LONG samples: one sample a row of vectors, one channel a vector element."""
    return vectors.select(F.col(index).alias("sample_index"), F.posexplode(values).alias("channel_index", "value")).withColumn("value", F.col("value").cast("double"))


def events_from_table(events: DataFrame) -> DataFrame:
    """Event track: code, source, seconds since the first event."""
    start = events.agg(F.min("ts").alias("t0"))
    return events.crossJoin(F.broadcast(start)).select("event_id", F.col("event_type").alias("code"), "user_id", "value", (F.expr("timestampdiff(MICROSECOND, t0, ts)") / 1e6).alias("begin_s"))


def to_traces(samples: DataFrame, *keys: str) -> DataFrame:
    keys = keys or (*ids(samples), "channel_index")
    packed = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sample_index", "value"))).alias("s"))
    return packed.select(*keys, F.transform("s", lambda x: x["value"]).alias("values"))


def to_samples(traces: DataFrame, *keys: str) -> DataFrame:
    keys = keys or (*ids(traces), "channel_index")
    return traces.select(*keys, F.posexplode("values").alias("sample_index", "value")).withColumn("sample_index", F.col("sample_index").cast("long"))


def decimate(samples: DataFrame, factor: int) -> DataFrame:
    """Every factor-th sample."""
    return samples.where(F.col("sample_index") % factor == 0).withColumn("sample_index", F.floor(F.col("sample_index") / factor))


def block_average(samples: DataFrame, factor: int) -> DataFrame:
    """Mean of each block, a short last one included."""
    return samples.groupBy(*ids(samples), "channel_index", F.floor(F.col("sample_index") / factor).alias("sample_index")).agg(F.avg("value").alias("value"))


def linear_upsample(samples: DataFrame, factor: int, n: int) -> DataFrame:
    """Linear interpolation between block centres, clamped at the ends.

    Each centre is joined to the next and then makes the samples up to it, so no table of all samples is
    joined (whose size the planner guesses from the few rows that it is exploded from, and broadcasts it).
    """
    named = ids(samples)
    keys, at = [*named, "channel_index"], F.col("sample_index")
    last = samples.groupBy(*keys).agg(F.max("sample_index").alias("last"))
    after = samples.select(*keys, (at - 1).alias("sample_index"), F.col("value").alias("v1"), F.lit(True).alias("followed"))
    pairs = samples.select(*keys, "sample_index", F.col("value").alias("v0")).join(last, keys).join(after, [*keys, "sample_index"], "left")
    ends = pairs.where((at == F.col("last")) | F.col("followed")).withColumn("v1", F.when(at == F.col("last"), F.col("v0")).otherwise(F.col("v1")))
    centre = (factor - 1) / 2
    first = F.when(at == 0, 0).otherwise(F.ceil(at * factor + centre)).cast("long")
    until = F.when(at == F.col("last"), n - 1).otherwise(F.least(F.ceil((at + 1) * factor + centre) - 1, F.lit(n - 1))).cast("long")
    spread = ends.withColumn("low", at).withColumn("from", first).withColumn("to", until).where("from <= to").withColumn("sample_index", F.explode(F.sequence("from", "to")))
    pos = F.greatest(F.lit(0.0), F.least(F.col("last").cast("double"), (at - centre) / factor))
    return spread.select(*keys, "sample_index", (F.col("v0") + (F.col("v1") - F.col("v0")) * (pos - F.col("low"))).alias("value"))


def unit_geometry(sensors: DataFrame) -> DataFrame:
    """3-D positions on the unit sphere (channel_index, x, y, z); sensors at the origin or without a finite position have none."""
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    placed = sensors.withColumn("__r", size).where((F.col("__r") > 1e-9) & ~F.isnan("__r"))
    return placed.select(*ids(sensors), "channel_index", *((F.col(c) / F.col("__r")).alias(c) for c in ("x", "y", "z")))
