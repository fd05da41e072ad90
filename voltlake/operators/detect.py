"""Detectors that SQL can express: runs, thresholds, spacing, locking, greedy picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.keys import ids
from voltlake.operators.stats import median_upper
from voltlake.operators.topk import find_peaks, threshold_runs


def trigger_spacing(events: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """Intervals between sorted triggers: least, most, upper median, distinct count, and whether all are within the tolerance of the median."""
    keys = (*ids(events), *keys)
    w = Window.partitionBy(*keys).orderBy("begin_s", "event_id")
    gaps = events.withColumn("d", F.col("begin_s") - F.lag("begin_s").over(w)).where("d IS NOT NULL")
    found = gaps.groupBy(*keys).agg(F.min("d").alias("least"), F.max("d").alias("most"), median_upper(F.col("d")).alias("median"), F.countDistinct("d").alias("n_distinct"))
    return found.withColumn("even", F.greatest(F.col("most") - F.col("median"), F.col("median") - F.col("least")) <= tolerance)


def ocular_drive(samples: DataFrame, candidates: tuple[int, ...]) -> DataFrame:
    """The candidate channels' value of largest magnitude at each sample."""
    return samples.where(F.col("channel_index").isin(*candidates)).groupBy(*ids(samples), "sample_index").agg(F.max_by("value", F.struct(F.abs("value"), -F.col("channel_index"))).alias("value"))


def ocular_events(samples: DataFrame, candidates: tuple[int, ...], rate: float, threshold: float = 150.0, polarity: str = "both", min_s: float = 0.05, max_s: float = 0.5, cap: float | None = None, rise_s: float | None = 0.1, gap_s: float = 0.25, velocity: float | None = None, acceleration: float | None = None) -> DataFrame:
    """Blinks or movements: runs over the threshold with duration, peak and rise limits; close ones merge and keep the earlier peak.

    ``velocity`` (per ms) and ``acceleration`` (per ms squared) are the least that a run's largest first and second difference must reach.
    """
    drive = ocular_drive(samples, candidates)
    over = {"positive": F.col("value") >= threshold, "negative": F.col("value") <= -threshold}.get(polarity, F.abs("value") >= threshold)
    named = ids(drive)
    runs = threshold_runs(drive, over, *named)
    length = F.col("end_sample") - F.col("start_sample") + 1
    runs = runs.where(length.between(int(min_s * rate + 0.5), int(max_s * rate + 0.5)))
    if cap is not None:
        runs = runs.where(F.col("peak") <= cap)
    peaks = _peaks(drive, runs)
    if rise_s is not None:
        peaks = peaks.where(F.col("peak_sample") - F.col("start_sample") <= rise_s * rate)
    if velocity is not None or acceleration is not None:
        speeds = _kinematics(drive, peaks, rate)
        fast = F.lit(True)
        for column, least in (("velocity", velocity), ("acceleration", acceleration)):
            fast = fast & (F.coalesce(column, F.lit(0.0)) >= least) if least is not None else fast
        peaks = peaks.join(speeds, [*named, "start_sample", "end_sample"]).where(fast).drop("velocity", "acceleration")
    w = Window.partitionBy(*named).orderBy("start_sample")  # events of a recording
    end = F.max("end_sample").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = peaks.withColumn("fresh", F.when(end.isNull() | (F.col("start_sample") - end > gap_s * rate), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(w))
    return marked.groupBy(*named, "island").agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"), F.min_by("peak_sample", "start_sample").alias("peak_sample"), F.min_by("peak", "start_sample").alias("peak")).drop("island")


def _kinematics(drive: DataFrame, runs: DataFrame, rate: float, bucket: int = 512) -> DataFrame:
    """Largest first and second difference within each run, per millisecond; neighbours meet by joins on the next sample, so no recording is one task."""
    named = ids(drive, runs)
    own = drive.select(*named, "sample_index", F.col("value").cast("double").alias("v"))
    past = own.select(*named, (F.col("sample_index") + 1).alias("sample_index"), F.col("v").alias("__past"))
    coming = own.select(*named, (F.col("sample_index") - 1).alias("sample_index"), F.col("v").alias("__next"))
    per_ms = rate / 1_000
    steps = own.join(past, [*named, "sample_index"]).join(coming, [*named, "sample_index"], "left").select(*named, "sample_index", (F.abs(F.col("v") - F.col("__past")) * per_ms).alias("velocity"), (F.abs(F.col("__next") - 2 * F.col("v") + F.col("__past")) * per_ms**2).alias("acceleration"))
    spread = runs.select(*named, "start_sample", "end_sample").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_sample") / bucket), F.floor(F.col("end_sample") / bucket))))
    hit = steps.withColumn("__b", F.floor(F.col("sample_index") / bucket)).join(spread, [*named, "__b"], "right").where(F.col("sample_index").isNull() | F.col("sample_index").between(F.col("start_sample"), F.col("end_sample")))
    return hit.groupBy(*named, "start_sample", "end_sample").agg(F.max("velocity").alias("velocity"), F.max("acceleration").alias("acceleration"))


def _peaks(drive: DataFrame, runs: DataFrame, bucket: int = 512) -> DataFrame:
    """Sample of the largest magnitude in each run, by a bucketed equi-join."""
    spread = runs.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_sample") / bucket), F.floor(F.col("end_sample") / bucket))))
    named = ids(drive, runs)
    hit = drive.withColumn("__b", F.floor(F.col("sample_index") / bucket)).join(spread, [*named, "__b"]).where(F.col("sample_index").between(F.col("start_sample"), F.col("end_sample")))
    return hit.groupBy(*named, "start_sample", "end_sample", "peak").agg(F.max_by("sample_index", F.struct(F.abs("value"), -F.col("sample_index"))).alias("peak_sample"))


def locked_events(events: DataFrame, shift_s: float, duration_s: float) -> DataFrame:
    """Events moved by a lag; those outside [0, duration) go."""
    return events.withColumn("begin_s", F.col("begin_s") + shift_s).where((F.col("begin_s") >= 0) & (F.col("begin_s") < duration_s))


def field_power_peaks(samples: DataFrame, sigmas: float, spacing: int) -> DataFrame:
    """Peaks of the global field power."""
    from voltlake.operators.windows import gfp

    power = gfp(samples).withColumnRenamed("gfp", "value")
    return find_peaks(power, sigmas, spacing, *ids(samples))


def topography_scores(samples: DataFrame, template: DataFrame) -> DataFrame:
    """Spatial correlation of every sample's map with a template (channel_index, weight), by moments."""
    from voltlake.operators.stats import pearson

    joined = samples.join(template, [*ids(samples, template), "channel_index"])  # a row a sensor: the planner broadcasts it
    return joined.groupBy(*ids(samples), "sample_index").agg(pearson(F.col("value"), F.col("weight")).alias("r"), F.stddev_pop("value").alias("gfp"), F.count("*").alias("n")).where("n >= 3")


def topography_detect(samples: DataFrame, template: DataFrame, least: float, gap: int) -> DataFrame:
    """Samples whose map correlates at least so well, merged by the moving-anchor rule."""
    from voltlake.operators.topk import merge_nearby

    hits = topography_scores(samples, template).where(F.col("r") >= least)
    return merge_nearby(hits.select(*ids(hits), F.col("sample_index").alias("start"), F.col("r").alias("score")), gap, *ids(hits))


def score_summary(matches: DataFrame, least: float) -> DataFrame:
    return matches.agg(F.count("*").alias("candidates"), F.count_if(F.col("score") >= least).alias("matches"), F.max("score").alias("best"), F.percentile("score", 0.5).alias("median"))


def template_channels(averages: DataFrame) -> DataFrame:
    """Channels of an event average by falling peak, then channel."""
    peak = averages.groupBy(*ids(averages), "channel_index").agg(F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"))
    return peak.withColumn("rank", F.row_number().over(Window.partitionBy(*ids(averages)).orderBy(F.desc("peak"), "channel_index")))  # a row a sensor
