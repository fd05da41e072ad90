"""Set operations on recordings, channels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_recordings(samples: DataFrame, segments: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Recordings one after another by (file_order): samples and segments shifted by the samples before.

    Channels beyond the first file's count are dropped.
    """
    order = Window.orderBy("file_order")  # one row a file
    placed = files.withColumn("offset", F.sum("n_samples").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_samples")).withColumn("limit", F.first("n_channels").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shift = F.broadcast(placed.select("file_id", "offset", "limit"))
    joined = samples.join(shift, "file_id").where(F.col("channel_index") < F.col("limit")).select("channel_index", (F.col("sample_index") + F.col("offset")).alias("sample_index"), "value", "file_id")
    if segments is None:
        return joined, None
    moved = segments.join(shift, "file_id").select(*(((F.col(c) + F.col("offset")).alias(c) if c in ("start_sample", "end_sample") else F.col(c)) for c in segments.columns))
    return joined, moved


def channel_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("channel_index").unionByName(b.select("channel_index")).distinct()


def channel_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """By aggregation: partial groups leave a row a channel and task, so rows of one channel never meet in a join."""
    sides = a.select("channel_index", F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(b.select("channel_index", F.lit(False).alias("a"), F.lit(True).alias("b")))
    return sides.groupBy("channel_index").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).where("a AND b").select("channel_index")


def good_channels(all_: DataFrame, bad: DataFrame) -> DataFrame:
    return all_.join(bad.select("channel_index").distinct(), "channel_index", "left_anti")


def distinct_events(events: DataFrame) -> DataFrame:
    """The first of events equal in file, code and raw begin, in time order."""
    w = Window.partitionBy("source_file", "code", "raw_begin").orderBy("begin_s", "event_id")
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged_channel_sets(own: DataFrame, built_in: DataFrame) -> DataFrame:
    """Built-in sets and those of the user whose id isn't taken."""
    return built_in.unionByName(own.join(built_in.select("set_id"), "set_id", "left_anti").dropDuplicates(["set_id"]))
