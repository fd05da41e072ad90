"""Explainable quality scores of segments and channels, from LONG samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.scoring import finite, grade, impedance_score, score_lower_bound, score_two_sided_ratio, score_upper_ratio
from voltlake.operators.joins import in_segments, swept_overlap
from voltlake.operators.keys import ids
from voltlake.operators.stats import clipping_fraction, excess_kurtosis, percentile, spread_percentiles
from voltlake.operators.tables import written
from voltlake.operators.windows import block_mean_drift, first_difference

#: Fixed values: (green, red) thresholds and weights of the scores.
SEGMENT = {"finite": (0.995, 0.92, 1.2), "coverage": (0.80, 0.45, 0.6), "gfp": (2, 5, 1.5), "amplitude": (3, 8, 1.2), "burst": (8, 24, 1.0), "gfp_bursts": (6, 18, 1.0), "flat": (0.01, 0.20, 1.1), "clip": (0.002, 0.08, 1.1), "fast": (2, 5, 1.0), "drift": (0.8, 2.5, 0.8), "artifacts": (0.02, 0.15, 2.4)}
CHANNEL = {"impedance": 1.4, "finite": (0.995, 0.90, 1.4), "amplitude": (2.5, 6, 1.4), "burst": (8, 24, 1.0), "flat": (0.005, 0.15, 1.3), "clip": (0.002, 0.08, 1.1), "fast": (2, 5, 1.0), "drift": (2.5, 6, 0.8), "kurtosis": (5, 20, 1.0), "line": (3, 10, 0.8)}
WEAK = 0.78


def tumbling_segments(n_samples: Column, length: int) -> Column:
    """Segments of ``length`` samples, the last one shorter, as an array of structs."""
    last = F.greatest(F.lit(0), F.floor((n_samples - 1) / length)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("segment_id"), (k * length).cast("long").alias("start_sample"), F.least((k + 1) * length - 1, n_samples - 1).cast("long").alias("end_sample")))


def with_key(rows: DataFrame, per_recording: DataFrame, named: list[str]) -> DataFrame:
    """Rows with the columns of their recording's row; without recordings, of the only row. The planner broadcasts it if it is small."""
    return rows.join(per_recording, named) if named else rows.crossJoin(F.broadcast(per_recording))


def segment_stride(n: int, rate: float) -> int:
    return max(int(rate / 200 + 0.5), math.ceil(n / 120_000), 1)


def channel_stride(n: int, rate: float) -> int:
    return max(int(rate / 250 + 0.5), math.ceil(n / 30_000), 1)


def weighted(scores: list[tuple[str, Column, float]]) -> tuple[Column, Column, Column]:
    """Weighted mean of the scores that aren't null, whole percent, and the two lowest names under the weak limit."""
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for _, s, w in scores), F.lit(0.0))
    good = sum((F.coalesce(s * w, F.lit(0.0)) for _, s, w in scores), F.lit(0.0)) / total
    listed = F.array_sort(F.filter(F.array(*(F.struct(s.alias("score"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, s, _) in enumerate(scores))), lambda x: x["score"] < WEAK))
    percent = F.round(F.least(F.greatest(good, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")
    return good, percent, F.array_join(F.transform(F.slice(listed, 1, 2), lambda x: x["name"]), " and ")


def segment_health(samples: DataFrame, segment_length: int, n_samples: int, n_channels: int, rate: float, intervals: DataFrame | None = None, stride: int | None = None, segments: DataFrame | None = None) -> DataFrame:
    """One row a segment: features, scores, score, percent, grade, weakest metrics.

    ``segments`` (segment_id, start_sample, end_sample; epochs of any length that don't overlap) take the
    place of tumbling ones of ``segment_length``. Baselines are of the whole recording either way.

    Plan: one aggregation by (segment, sample) for the field power, one by segment
    for amplitudes, both from the same samples with their differences, which are written once, and one row of recording baselines.
    """
    step, named = stride or segment_stride(n_samples, rate), ids(samples)
    seg = F.floor(F.col("sample_index") / segment_length).cast("int").alias("segment_id")
    x = F.when(finite(F.col("value")), F.col("value"))
    held = [] if segments is None else ["start_sample", "end_sample"]
    if segments is not None:
        samples = in_segments(samples, segments)
        seg = F.col("segment_id")
    rows = first_difference(samples.where(F.col("sample_index") % step == 0), carry=False).select(*named, seg, "sample_index", "channel_index", x.alias("x"), "diff", *held, F.lag("channel_index").over(Window.partitionBy(*named, "channel_index", F.floor(F.col("sample_index") / segment_length) if segments is None else "segment_id").orderBy("sample_index")).isNull().alias("opens"))
    rows = written(rows.withColumn("inner", F.when(~F.col("opens"), F.col("diff"))))

    power = rows.groupBy(*named, "segment_id", "sample_index").agg(F.sqrt(F.avg(F.col("x") ** 2)).alias("gfp"))
    at_least = lambda df: df.select(*named, *(F.greatest(c, F.lit(1e-9)).alias(c) for c in df.columns if c not in named))
    high_x = at_least(spread_percentiles(rows.withColumn("size", F.abs("x")), "size", {"b95": 0.95, "b99": 0.99}, *named))
    ratio = rows.groupBy(*named).agg(F.greatest(F.sqrt(F.avg(F.col("diff") ** 2)) / F.greatest(F.sqrt(F.avg(F.col("x") ** 2)), F.lit(1e-9)), F.lit(1e-9)).alias("b_ratio"))
    high_g = at_least(spread_percentiles(power, "gfp", {"g50": 0.5, "g95": 0.95, "g99": 0.99}, *named))
    base = with_key(with_key(ratio, high_x, named), high_g, named)  # a row a recording

    flat = F.greatest(F.col("b95") * 1e-4, F.lit(1e-7))
    by_segment = with_key(rows, base.select(*named, "b95"), named).groupBy(*named, "segment_id").agg(
        F.avg(F.col("x").isNotNull().cast("double")).alias("finite"),
        F.countDistinct("sample_index").alias("points"),
        F.coalesce(F.sqrt(F.avg(F.col("x") ** 2)), F.lit(0.0)).alias("rms"),
        percentile(F.abs("x"), 0.95).alias("p95"),
        percentile(F.abs("x"), 0.99).alias("p99"),
        F.coalesce(F.max(F.abs("x")), F.lit(0.0)).alias("top"),
        F.coalesce(F.sqrt(F.avg(F.col("inner") ** 2)), F.lit(0.0)).alias("d_rms"),
        F.coalesce(F.avg((F.abs("inner") <= flat).cast("double")), F.lit(1.0)).alias("flat"),
    )
    by_power = power.groupBy(*named, "segment_id").agg(percentile(F.col("gfp"), 0.95).alias("gfp_p95"), F.max("gfp").alias("gfp_max"))
    clip = clipping_fraction(rows.where("x IS NOT NULL"), "x", *named, "segment_id")

    last = samples.groupBy(*named).agg(F.least(F.max("sample_index") + 1, F.lit(n_samples)).alias("n"))
    bounds = last.select(*named, F.explode(tumbling_segments(F.col("n"), segment_length)).alias("s")).select(*named, "s.*")
    third = F.greatest(F.floor((F.col("end_sample") - F.col("start_sample") + 1) / 3), F.lit(1))
    start = (F.col("segment_id") * segment_length).cast("long")
    if segments is None:
        ended = with_key(rows, last, named).withColumn("start_sample", start).withColumn("end_sample", F.least(start + segment_length, "n") - 1)
    else:
        ended, bounds = rows, segments.select(*named, "segment_id", F.col("start_sample").cast("long").alias("start_sample"), F.col("end_sample").cast("long").alias("end_sample"))
    edges = ended.withColumn("first", F.when(F.col("sample_index") <= F.col("start_sample") + third, F.col("x"))).withColumn("last", F.when(F.col("sample_index") >= F.col("end_sample") - third, F.col("x")))
    drift = edges.groupBy(*named, "segment_id", "channel_index").agg((F.avg("last") - F.avg("first")).alias("d")).groupBy(*named, "segment_id").agg(F.coalesce(F.sqrt(F.avg(F.col("d") ** 2)), F.lit(0.0)).alias("drift_rms"))
    covered = swept_overlap(bounds, intervals) if intervals is not None else bounds.withColumn("overlap_samples", F.lit(0).cast("long")).withColumn("n_intervals", F.lit(0).cast("long"))

    by = [*named, "segment_id"]
    joined = with_key(covered.join(by_segment, by).join(by_power, by).join(clip, by).join(drift, by), base, named)
    n = F.col("end_sample") - F.col("start_sample") + 1
    marked = F.col("overlap_samples") / n
    s = SEGMENT
    upper = lambda value, key: score_upper_ratio(value, *s[key][:2])
    labelled = score_upper_ratio(marked, *s["artifacts"][:2])
    scores = [
        ("Finite Samples", score_lower_bound(F.col("finite"), *s["finite"][:2]), s["finite"][2]),
        ("Channel Coverage", score_lower_bound(F.lit(1.0), *s["coverage"][:2]), s["coverage"][2]),
        ("GFP", upper(F.col("gfp_p95") / F.col("g95"), "gfp"), s["gfp"][2]),
        ("Amplitude", upper(F.col("p95") / F.col("b95"), "amplitude"), s["amplitude"][2]),
        ("Burst Peaks", upper(F.col("top") / F.col("b99"), "burst"), s["burst"][2]),
        ("GFP Bursts", upper(F.col("gfp_max") / F.col("g99"), "gfp_bursts"), s["gfp_bursts"][2]),
        ("Flat/Clip", F.least(upper(F.col("flat"), "flat"), upper(F.col("clipping"), "clip")), s["flat"][2]),
        ("Fast Noise", upper(F.col("d_rms") / F.greatest("rms", F.lit(1e-9)) / F.col("b_ratio"), "fast"), s["fast"][2]),
        ("Slow Drift", F.when(n / rate >= 0.25, upper(F.col("drift_rms") / F.greatest(F.col("b95") * 0.25, F.lit(1e-9)), "drift")), s["drift"][2]),
        ("Labeled Artifacts", F.when(F.col("n_intervals") > 0, F.least(labelled, F.lit(0.15))).otherwise(labelled), s["artifacts"][2]),
    ]
    good, percent, weakest = weighted(scores)
    return joined.select(
        *by, "start_sample", "end_sample", "points", "finite", "rms", "p95", "top", "gfp_p95", "gfp_max", "d_rms", "flat", "clipping", "drift_rms", "overlap_samples", "n_intervals", good.alias("score"), percent.alias("percent"), grade(good).alias("grade"), weakest.alias("weakest")
    )


def line_power(samples: DataFrame, rate: float, frequency: float = 60.0) -> DataFrame:
    """2 (C^2 + S^2) / (n E) of a sinusoid, by channel; 0 up to 20 samples or if the rate is at most 2.2 times the frequency."""
    phase = 2 * math.pi * frequency / rate * F.col("sample_index")
    named = [*ids(samples), "channel_index"]
    sums = samples.groupBy(*named).agg(F.sum(F.col("value") * F.cos(phase)).alias("c"), F.sum(F.col("value") * F.sin(phase)).alias("s"), F.sum(F.col("value") ** 2).alias("e"), F.count("*").alias("n"))
    ok = (F.col("n") > 20) & F.lit(rate > 2.2 * frequency) & (F.col("e") > 1e-12)
    return sums.select(*named, F.when(ok, 2 * (F.col("c") ** 2 + F.col("s") ** 2) / (F.col("n") * F.col("e"))).otherwise(0.0).alias("line"))


def channel_health(samples: DataFrame, rate: float, impedance: DataFrame | None = None, stride: int = 1) -> DataFrame:
    """One row a channel: features, score, percent, grade, weakest metrics. Baselines are medians across a recording's channels."""
    named, by = ids(samples), [*ids(samples), "channel_index"]
    kept = samples.where(F.col("sample_index") % stride == 0).withColumn("sample_index", F.floor(F.col("sample_index") / stride))
    eff = rate / stride
    x = F.when(finite(F.col("value")), F.col("value"))
    rows = first_difference(kept, carry=True).withColumn("x", x)
    amount = rows.groupBy(*by).agg(
        F.avg(F.col("x").isNotNull().cast("double")).alias("finite"), F.coalesce(F.sqrt(F.avg(F.col("x") ** 2)), F.lit(0.0)).alias("rms"), percentile(F.abs("x"), 0.95).alias("p95"), percentile(F.abs("x"), 0.99).alias("p99"), F.coalesce(F.max(F.abs("x")), F.lit(0.0)).alias("top"), F.coalesce(F.sqrt(F.avg(F.col("diff") ** 2)), F.lit(0.0)).alias("d_rms"), F.coalesce(excess_kurtosis(F.col("x")), F.lit(0.0)).alias("kurtosis")
    )
    flat = rows.join(amount.select(*by, F.greatest(F.col("p95") * 1e-4, F.lit(1e-7)).alias("limit")), by).groupBy(*by).agg(F.coalesce(F.avg((F.abs("diff") <= F.col("limit")).cast("double")), F.lit(1.0)).alias("flat"))
    clip = clipping_fraction(rows.where("x IS NOT NULL"), "x", *by)
    drift = block_mean_drift(kept, max(8, int(2 * eff + 0.5)))
    each = amount.join(flat, by).join(clip, by).join(drift, by).join(line_power(kept, eff), by)
    each = each.withColumn("d_ratio", F.col("d_rms") / F.greatest("rms", F.lit(1e-9))).withColumn("drift_ratio", F.col("drift") / F.greatest("rms", F.lit(1e-9)))

    def typical(name: str, floor: float, fallback: float | None = None) -> Column:
        middle = F.percentile(F.when(F.col(name) > 0, F.col(name)), 0.5)
        return F.greatest(F.coalesce(middle, F.lit(fallback if fallback is not None else 0.0)), F.lit(floor)).alias(f"b_{name}")

    base = each.groupBy(*named).agg(typical("p95", 1e-9), typical("p99", 1e-9), typical("d_ratio", 1e-9), typical("drift_ratio", 1e-9, 0.02), typical("line", 0.0))
    each = with_key(each, base, named)
    each = each.join(impedance.select(*ids(samples, impedance), "channel_index", "impedance_kohm"), [*ids(samples, impedance), "channel_index"], "left") if impedance is not None else each.withColumn("impedance_kohm", F.lit(None).cast("double"))
    c = CHANNEL
    upper = lambda value, key: score_upper_ratio(value, *c[key][:2])
    scores = [
        ("Impedance", F.when(finite(F.col("impedance_kohm")), impedance_score(F.col("impedance_kohm"))), c["impedance"]),
        ("Finite Samples", score_lower_bound(F.col("finite"), *c["finite"][:2]), c["finite"][2]),
        ("Signal Amplitude", F.when((F.col("rms") <= 1e-12) | (F.col("p95") <= 1e-12), 0.0).otherwise(score_two_sided_ratio(F.col("p95") / F.col("b_p95"), *c["amplitude"][:2])), c["amplitude"][2]),
        ("Burst Peaks", upper(F.col("top") / F.col("b_p99"), "burst"), c["burst"][2]),
        ("Flatline", upper(F.col("flat"), "flat"), c["flat"][2]),
        ("Clipping", upper(F.col("clipping"), "clip"), c["clip"][2]),
        ("Fast Noise", upper(F.col("d_ratio") / F.col("b_d_ratio"), "fast"), c["fast"][2]),
        ("Slow Drift", upper(F.col("drift_ratio") / F.col("b_drift_ratio"), "drift"), c["drift"][2]),
        ("Kurtosis", upper(F.greatest("kurtosis", F.lit(0.0)), "kurtosis"), c["kurtosis"][2]),
        ("60 Hz Line", F.when((F.col("line") > 0) & (F.col("b_line") > 0), upper(F.col("line") / F.when(F.col("b_line") > 0, F.col("b_line")), "line")), c["line"][2]),
    ]
    good, percent, weakest = weighted(scores)
    return each.select(*by, "finite", "rms", "p95", "p99", "top", "d_rms", "kurtosis", "flat", "clipping", "drift", "line", good.alias("score"), percent.alias("percent"), grade(good).alias("grade"), weakest.alias("weakest"))


def neighbour_agreement(samples: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Largest |r| of each channel with its neighbours."""
    from voltlake.operators.stats import pearson

    named = ids(samples)
    mine = samples.select(*named, "channel_index", "sample_index", F.col("value").alias("x")).join(F.broadcast(neighbours.select("channel_index", "neighbour")), "channel_index")
    other = samples.select(*named, F.col("channel_index").alias("neighbour"), "sample_index", F.col("value").alias("y"))
    r = mine.join(other, [*named, "neighbour", "sample_index"]).groupBy(*named, "channel_index", "neighbour").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    return r.groupBy(*named, "channel_index").agg(F.max(F.abs("r")).alias("agreement"))


def neighbour_prediction(samples: DataFrame, neighbours: DataFrame, window: int) -> DataFrame:
    """Median over full windows of max(r, 0) between a channel and the inverse-distance blend of its neighbours; bad under 0.485. A channel of less than a window (or windows under 8 samples) has one r over all its samples, if they are more than 8."""
    from voltlake.operators.stats import pearson

    w = F.lit(1.0) / F.greatest(F.sqrt("d2"), F.lit(1e-6))
    total = F.sum(w).over(Window.partitionBy("channel_index"))
    weights = neighbours.select("channel_index", F.col("neighbour").alias("source"), (w / total).alias("weight"))
    by = [*ids(samples), "channel_index"]
    other = samples.select(*ids(samples), F.col("channel_index").alias("source"), "sample_index", F.col("value").alias("y"))
    blend = other.join(F.broadcast(weights), "source").groupBy(*by, "sample_index").agg(F.sum(F.col("weight") * F.col("y")).alias("y"))
    both = samples.join(blend, [*by, "sample_index"]).withColumnRenamed("value", "x")
    each = both.groupBy(*by, F.floor(F.col("sample_index") / window).alias("w")).agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n"))
    windows = each.where((F.col("n") == window) & F.lit(window >= 8)).groupBy(*by).agg(F.percentile(F.greatest("r", F.lit(0.0)), 0.5).alias("prediction"))
    whole = both.groupBy(*by).agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n")).where((F.col("n") > 8) & (F.lit(window < 8) | (F.col("n") < window)))
    found = windows.unionByName(whole.join(windows, by, "left_anti").select(*by, F.greatest("r", F.lit(0.0)).alias("prediction")))
    return found.withColumn("bad", F.col("prediction") < 0.485)


def merged_metrics(metrics: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics (channel_index, name, score, weight) with those of the same name replaced, and the score recomputed by channel."""
    by = [*ids(metrics, new), "channel_index"]
    kept = metrics.join(new.select(*by, "name"), [*by, "name"], "left_anti").unionByName(new)
    good = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    return kept.groupBy(*by).agg(good.alias("score"), F.round(good * 100).cast("int").alias("percent"), grade(good).alias("grade"))


def grade_counts(health: DataFrame) -> DataFrame:
    return health.groupBy(*ids(health), "grade").agg(F.count("*").alias("n"))


def interpolated_health(health: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean score of the channels that contribute to an interpolated one."""
    return weights.where("weight != 0").join(health.select(*ids(health), "channel_index", "score"), "channel_index").groupBy(*ids(health), "target").agg(F.avg("score").alias("score"))


def segment_summary(decisions: DataFrame) -> DataFrame:
    """Counts and samples of all, kept and rejected segments, and the rejected ones by grade."""
    n = F.col("end_sample") - F.col("start_sample") + 1
    return decisions.groupBy(*ids(decisions)).agg(F.count("*").alias("segments"), F.count_if("kept").alias("kept"), F.sum(n).alias("samples"), F.coalesce(F.sum(F.when(F.col("kept"), n)), F.lit(0)).alias("kept_samples"), F.count_if(~F.col("kept") & (F.col("grade") == "poor")).alias("poor"), F.coalesce(F.sum("overlap_samples"), F.lit(0)).alias("overlap_samples"))
