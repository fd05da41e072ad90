"""Artifact correction that SQL can express: gradient templates, per-event regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.keys import ids


def gradient_removed(samples: DataFrame, first: int, spacing: int, n_volumes: int, before: int = 4, after: int = 4, w_before: float = 0.5, w_after: float = 0.5, excluded: tuple[int, ...] = ()) -> DataFrame:
    """Less a template of neighbouring volumes, after linear detrending of each volume.

    The template at a phase is the weighted mean of the volumes before and after;
    excluded volumes aren't donors but are corrected. Where one side has no donor
    the other has weight 1, and with none the volume is detrended only. Samples
    outside whole volumes stay.
    """
    at = F.col("sample_index") - first
    placed = samples.withColumn("tr", F.when((at >= 0) & (at < spacing * n_volumes), F.floor(at / spacing))).withColumn("phase", F.pmod(at, F.lit(spacing)))
    inside = placed.where("tr IS NOT NULL")
    named = ids(samples)
    line = inside.groupBy(*named, "channel_index", "tr").agg(F.regr_slope("value", "phase").alias("slope"), F.regr_intercept("value", "phase").alias("level"))
    flat = inside.join(line, [*named, "channel_index", "tr"]).withColumn("x", F.col("value") - F.coalesce("level", F.lit(0.0)) - F.coalesce("slope", F.lit(0.0)) * F.col("phase"))
    donor = F.when(~F.col("tr").isin(*excluded), F.col("x")) if excluded else F.col("x")
    w = Window.partitionBy(*named, "channel_index", "phase").orderBy("tr")
    a, b = F.avg(donor).over(w.rowsBetween(-before, -1)), F.avg(donor).over(w.rowsBetween(1, after))
    template = F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b).when(b.isNull(), a).otherwise(w_before * a + w_after * b)
    cleaned = flat.select(*named, "channel_index", "sample_index", (F.col("x") - template).alias("value"))
    return cleaned.unionByName(placed.where("tr IS NULL").select(*named, "channel_index", "sample_index", "value"))


def template_regressed(trials: DataFrame) -> DataFrame:
    """Each event less its projection on the unit average of its channel. Rows of ``times`` count so often in the average."""
    named = [*ids(trials), "category", "channel_index"]
    times = F.col("times") if "times" in trials.columns else F.lit(1)
    mean = trials.groupBy(*named, "rel").agg((F.sum(F.col("value") * times) / F.sum(F.when(F.col("value").isNotNull(), times))).alias("m"))
    size = mean.groupBy(*named).agg(F.sum(F.col("m") ** 2).alias("e"))
    joined = trials.join(mean, [*named, "rel"]).join(size, named)
    scale = F.sum(F.col("value") * F.col("m")).over(Window.partitionBy(*named, "trial")) / F.when(F.col("e") > 1e-18, F.col("e"))
    return joined.withColumn("scale", F.coalesce(scale, F.lit(0.0))).select(*named, "trial", "rel", (F.col("value") - F.col("scale") * F.col("m")).alias("value"), "scale")


#: Trials of a window that one row of ``regression_scales`` holds before they are told apart.
PIECE = 4_096


def regression_scales(windows: DataFrame, placed: DataFrame) -> DataFrame:
    """Keys, category, channel_index, trial, scale of ``template_regressed`` for every trial of ``placed`` (epochs.placed_trials or counted_windows): worked out once a window, and handed to its trials, whose numbers are in a row."""
    keys = [*ids(windows, placed), "category", "window"]
    counted = placed if "times" in placed.columns else placed.groupBy(*keys).agg(F.min("trial").alias("first"), F.count("*").alias("times"))
    found = template_regressed(windows).where("rel = 0").withColumnRenamed("trial", "window")
    packed = found.groupBy(*keys).agg(F.collect_list(F.struct("channel_index", "scale")).alias("c"))
    pieces = counted.join(packed, keys).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(PIECE)))).repartition(200, *keys, "piece")  # few rows make many: spread before that
    trial = F.explode(F.sequence(F.col("first") + F.col("piece"), F.col("first") + F.least(F.col("piece") + PIECE, F.col("times")) - 1))
    return pieces.select(*keys[:-1], trial.alias("trial"), "c").select(*keys[:-1], "trial", F.explode("c").alias("c")).select(*keys[:-1], "trial", "c.channel_index", "c.scale")
