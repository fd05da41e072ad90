"""Projections, filters and segment decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.keys import ids


def valid_channels(requested: DataFrame, channels: DataFrame) -> DataFrame:
    """Requested indices that exist with the length of channel 0, each once, in order."""
    reference = channels.where("channel_index = 0").select(F.col("n").alias("n0"))
    ok = channels.crossJoin(F.broadcast(reference)).where("n = n0").select("channel_index")
    return requested.select("channel_index").distinct().join(ok, "channel_index", "left_semi").orderBy("channel_index")


def channels_of_length(samples: DataFrame, n: int) -> DataFrame:
    return samples.groupBy(*ids(samples), "channel_index").agg(F.count("*").alias("n")).where(F.col("n") == n).select(*ids(samples), "channel_index")


def included_channels(channels: DataFrame, excluded: DataFrame, fall_back: bool) -> DataFrame:
    """Channels less the excluded; all of them if none is left and ``fall_back``."""
    left = channels.select("channel_index").join(excluded.select("channel_index"), "channel_index", "left_anti")
    if not fall_back:
        return left
    n = left.agg(F.count("*").alias("left_n"))
    marked = channels.select("channel_index").join(excluded.select("channel_index", F.lit(True).alias("out")), "channel_index", "left").crossJoin(F.broadcast(n))
    return marked.where(F.col("out").isNull() | (F.col("left_n") == 0)).select("channel_index").distinct()


def split_samples(samples: DataFrame, boundary: int, n: int) -> tuple[DataFrame, DataFrame]:
    at = min(max(boundary, 1), n - 1)
    return samples.where(F.col("sample_index") < at), samples.where(F.col("sample_index") >= at).withColumn("sample_index", F.col("sample_index") - at)


def split_events(events: DataFrame, low_s: float, high_s: float) -> DataFrame:
    """Events with low <= begin < high, shifted, their durations clipped."""
    kept = events.where((F.col("begin_s") >= low_s) & (F.col("begin_s") < high_s))
    if "duration_s" in events.columns:
        kept = kept.withColumn("duration_s", F.least("duration_s", F.lit(high_s) - F.col("begin_s")))
    return kept.withColumn("begin_s", F.col("begin_s") - low_s)


def move_channel(channels: DataFrame, index: int, from_role: str, to_role: str) -> DataFrame:
    """The channel changes its role; indices of both roles are packed, it comes last in the new one."""
    moved = (F.col("role") == from_role) & (F.col("channel_index") == index)
    changed = channels.withColumn("__last", moved.cast("int")).withColumn("role", F.when(moved, to_role).otherwise(F.col("role")))
    w = Window.partitionBy("role").orderBy("__last", "channel_index")
    return changed.withColumn("channel_index", F.row_number().over(w) - 1).drop("__last")


def segment_decisions(segments: DataFrame, kept_grades: tuple[str, ...], max_overlap: float) -> DataFrame:
    """kept, and reasons like health:poor and artifact_overlap:12.5%."""
    bad_grade, much = ~F.col("grade").isin(*kept_grades), F.col("overlap_fraction") > max_overlap
    reasons = F.array_compact(F.array(F.when(bad_grade, F.concat(F.lit("health:"), "grade")), F.when(much, F.format_string("artifact_overlap:%.1f%%", F.col("overlap_fraction") * 100))))
    return segments.withColumn("kept", ~bad_grade & ~much).withColumn("reasons", reasons)


def volumes_exceeding(motion: DataFrame, threshold: float) -> DataFrame:
    return motion.where(F.col("fd") > threshold).select("volume")


#: Candidate eye channels (1-based) by kind and least size of the net.
OCULAR = {"blink": ((241, (18, 37, 238, 241)), (127, (8, 25, 126, 127))), "movement": ((252, (226, 252)), (128, (1, 32, 125, 128)))}


def ocular_preset(kind: str, n_channels: Column) -> Column:
    """0-based candidate eye channels; the first up to four where the net isn't known."""
    chosen = F.when(F.lit(False), F.array(F.lit(0)))
    for least, channels in OCULAR[kind]:
        chosen = chosen.when(n_channels >= least, F.array(*(F.lit(c - 1) for c in channels)))
    return chosen.otherwise(F.sequence(F.lit(0), F.least(n_channels, F.lit(4)).cast("int") - 1))


def replayable_steps(steps: DataFrame) -> DataFrame:
    return steps.where("replayable")


def without_artifacts(epochs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Epochs that no artifact interval overlaps."""
    from voltlake.operators.joins import artifact_overlap

    return artifact_overlap(epochs, intervals).where("n_intervals = 0").select(*epochs.columns)
