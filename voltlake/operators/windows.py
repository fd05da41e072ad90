"""Sliding computations as window functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.scoring import finite
from voltlake.operators.keys import ids


def per_channel(samples: DataFrame):
    return Window.partitionBy(*ids(samples), "channel_index").orderBy("sample_index")


def with_previous(rows: DataFrame, at: str, columns: tuple[str, ...], size: int = 65_536) -> DataFrame:
    """``rows`` with __<column>, the value in the row before by ``at``. Rows are looked at in blocks of ``size`` of ``at``, and a block gets the last row of the one before it; so no recording's rows meet in one task."""
    keys = ids(rows)
    placed = rows.withColumn("__block", F.floor(F.col(at) / size))
    edges = placed.groupBy(*keys, "__block").agg(F.max_by(F.struct(*columns), at).alias("__last"))  # a row a block
    carried = edges.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__block").alias("__of"), F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block")).alias("__edge"))
    same = F.col("__block").eqNullSafe(F.col("__of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    own = Window.partitionBy(*keys, "__block").orderBy(at)
    first = F.row_number().over(own) == 1
    found = placed.join(carried, same, "left")
    return found.select(*rows.columns, *(F.when(first, F.col(f"__edge.{c}")).otherwise(F.lag(c).over(own)).alias(f"__{c}") for c in columns))


def framewise_displacement(motion: DataFrame, radius_mm: float = 50.0, size: int = 65_536) -> DataFrame:
    """Sum of absolute steps of six parameters, rotations as arcs on a sphere; 0 for the first volume."""
    turns, shifts = ("roll", "pitch", "yaw"), ("d_s", "d_l", "d_p")
    step = lambda c: F.abs(F.col(c) - F.col(f"__{c}"))
    arc = math.pi / 180 * radius_mm
    fd = sum((step(c) * arc for c in turns), F.lit(0.0)) + sum((step(c) for c in shifts), F.lit(0.0))
    return with_previous(motion, "volume", turns + shifts, size).select(*motion.columns, F.coalesce(fd, F.lit(0.0)).alias("fd"))


def first_difference(samples: DataFrame, carry: bool) -> DataFrame:
    """diff against the previous finite value; without ``carry`` a value that isn't finite resets."""
    good = F.when(finite(F.col("value")), F.col("value"))
    w = per_channel(samples)
    before = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if carry else F.lag(good).over(w)
    return samples.withColumn("diff", good - before)


def centred_moving_average(samples: DataFrame, width: int, name: str = "smooth") -> DataFrame:
    r = max(1, width // 2)
    x = F.when(finite(F.col("value")), F.col("value"))
    return samples.withColumn(name, F.coalesce(F.avg(x).over(per_channel(samples).rowsBetween(-r, r)), F.lit(0.0)))


def baseline_removed(samples: DataFrame, rate: float) -> DataFrame:
    """Less the mean of +-0.3 s; 0 for what isn't finite."""
    r = int(0.6 * rate / 2 + 0.5)
    x = F.when(finite(F.col("value")), F.col("value"))
    return samples.withColumn("value", F.coalesce(x - F.avg(x).over(per_channel(samples).rowsBetween(-r, r)), F.lit(0.0)))


def derivative(samples: DataFrame) -> DataFrame:
    w = per_channel(samples)
    after, before = F.lead("value").over(w), F.lag("value").over(w)
    return samples.withColumn("d", F.when(after.isNull() & before.isNull(), 0.0).when(before.isNull(), after - F.col("value")).when(after.isNull(), F.col("value") - before).otherwise((after - before) / 2))


def box_car(samples: DataFrame, width: int) -> DataFrame:
    """Mean of +-width/2, shorter at the ends; unchanged if the series isn't longer than the window."""
    r = width // 2
    n = F.count("*").over(Window.partitionBy(*ids(samples), "channel_index"))
    return samples.withColumn("value", F.when(n <= width, F.col("value")).otherwise(F.avg("value").over(per_channel(samples).rowsBetween(-r, r))))


def sliding_z(samples: DataFrame, width: int) -> DataFrame:
    w = per_channel(samples).rowsBetween(-(width // 2), width // 2)
    sd = F.stddev_pop("value").over(w)
    return samples.withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def sliding_rms_normalised(samples: DataFrame, width: int) -> DataFrame:
    w = per_channel(samples).rowsBetween(-(width // 2), width // 2)
    return samples.withColumn("value", F.col("value") / F.sqrt(F.greatest(F.avg(F.col("value") * F.col("value")).over(w), F.lit(1e-20))))


def block_mean_drift(samples: DataFrame, block: int, *keys: str) -> DataFrame:
    """Population deviation of means of full-enough blocks (8 samples, 2 blocks); 0 otherwise."""
    keys = keys or (*ids(samples), "channel_index")
    means = samples.groupBy(*keys, F.floor(F.col("sample_index") / block).alias("b")).agg(F.avg("value").alias("m"), F.count("*").alias("n")).where("n >= 8")
    return means.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.stddev_pop("m")).otherwise(0.0).alias("drift"))


def gfp(samples: DataFrame, kind: str = "rms") -> DataFrame:
    """Global field power of each sample: rms, rms of finite values, or deviation across channels."""
    x = F.col("value")
    if kind == "finite":
        x = F.when(finite(x), x)
    value: Column = F.stddev_pop(x) if kind == "deviation" else F.sqrt(F.avg(x * x))
    return samples.groupBy(*ids(samples), "sample_index").agg(F.coalesce(value, F.lit(0.0)).alias("gfp"))


def average_reference(samples: DataFrame, bad: tuple[int, ...] = ()) -> DataFrame:
    """Less the mean of the good channels, for every channel."""
    good = F.col("value") if not bad else F.when(~F.col("channel_index").isin(*bad), F.col("value"))
    return samples.withColumn("value", F.col("value") - F.avg(good).over(Window.partitionBy(*ids(samples), "sample_index")))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Start and end sample of consecutive blocks, as a prefix sum of their sizes."""
    before = Window.partitionBy(*ids(blocks)).orderBy("block_index")
    end = F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("start_sample", end - F.col("n")).withColumn("end_sample", end - 1)
