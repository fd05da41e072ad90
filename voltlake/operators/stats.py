"""Statistics with the degenerate cases defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.scoring import finite
from voltlake.operators.keys import ids


def percentile(x: Column, p: float) -> Column:
    """Linear interpolation at p (n - 1); 0 for no values."""
    return F.coalesce(F.percentile(x, p), F.lit(0.0))


def spread_percentiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str, per_octave: int = 64) -> DataFrame:
    """Exact percentiles of non-negative values by key, as columns named in ``shares``; 0 without values.

    ``percentile`` keeps all distinct values of a key in one task. Here values are
    counted by bucket (a fraction of an octave, with partial aggregates), and only the
    buckets that hold a wanted rank are sorted: a key of any size is spread.
    """
    bucket = F.when(F.col(value) > 0, F.floor(F.log2(value) * per_octave)).otherwise(-(1 << 40))
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), bucket.alias("__b"))
    counts = held.groupBy(*keys, "__b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*keys, "__b", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    target = [F.lit(p) * (F.col("total") - 1) for p in shares.values()]
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(high).alias("high"), (F.ceil(t) if high else F.floor(t)).alias("rank"), (t - F.floor(t)).alias("part")) for i, t in enumerate(target) for high in (False, True)))
    wanted = placed.select(*keys, "__b", "before", F.explode(F.filter(ranks, lambda x: (x["rank"] >= F.col("before")) & (x["rank"] < F.col("upto")))).alias("r"))
    chosen = wanted.select(*keys, "__b").distinct()
    listed = held.join(chosen, [*keys, "__b"], "left_semi").groupBy(*keys, "__b").agg(F.sort_array(F.collect_list("__v")).alias("values"))
    found = wanted.join(listed, [*keys, "__b"]).select(*keys, "r.*", F.get("values", (F.col("r.rank") - F.col("before")).cast("int")).alias("x"))
    columns = []
    for i, name in enumerate(shares):
        low, high = (F.max(F.when((F.col("i") == i) & (F.col("high") == h), F.col("x"))) for h in (False, True))
        part = F.max(F.when(F.col("i") == i, F.col("part")))
        columns.append(F.coalesce(low + (high - low) * part, F.lit(0.0)).alias(name))
    return found.groupBy(*keys).agg(*columns)


def rms(x: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


def variance_population(x: Column) -> Column:
    return F.coalesce(F.var_pop(x), F.lit(0.0))


def variance_sample(x: Column) -> Column:
    """Divided by max(n - 1, 1): 0 for one value."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def energy(x: Column) -> Column:
    return F.coalesce(F.sum(x * x), F.lit(0.0))


def excess_kurtosis(x: Column) -> Column:
    """Fourth over squared second central moment, less 3; 0 where the variance vanishes."""
    return F.when(F.var_pop(x) > 1e-18, F.kurtosis(x)).otherwise(0.0)


def median_interpolated(x: Column) -> Column:
    """Over positive finite values, at least 1e-9."""
    return F.greatest(F.coalesce(F.percentile(F.when(finite(x) & (x > 0), x), 0.5), F.lit(0.0)), F.lit(1e-9))


def median_upper(x: Column) -> Column:
    """The upper middle of the sorted values."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def median_middles(x: Column) -> Column:
    return F.percentile(x, 0.5)


def mode(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Most frequent value; the smaller of equally frequent ones."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return df.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def pearson(x: Column, y: Column, degenerate: float | None = 0.0, floor: float = 1e-12) -> Column:
    """Correlation by moments; ``degenerate`` where a variance vanishes."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    sxy = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    sxx, syy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return F.when((n > 0) & (sxx * syy > floor), sxy / F.sqrt(F.when(sxx * syy > floor, sxx * syy))).otherwise(F.lit(degenerate).cast("double"))


def clipping_fraction(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Share of values within max(0.1 % of the peak, 0.01) of it; 0 up to 3 values or a peak of 20."""
    top = df.groupBy(*keys).agg(F.max(F.abs(value)).alias("top"), F.count("*").alias("n"))
    near = F.abs(F.col(value)) >= F.col("top") - F.greatest(F.col("top") * 0.001, F.lit(0.01))
    return df.join(top, list(keys)).groupBy(*keys).agg(F.when((F.first("n") > 3) & (F.first("top") > 20), F.avg(near.cast("double"))).otherwise(0.0).alias("clipping"))


def covariance(samples: DataFrame, n_channels: int, ddof: int = 1) -> DataFrame:
    """Channel covariance (i <= j) of each recording. Each task adds up one Gram matrix a recording, so what is shuffled is n_channels^2 numbers of each.

    Samples that lack a channel are left out.
    """
    size, named = n_channels, ids(samples)

    def gram(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            x = np.array(batch.column("row").to_pylist(), float).reshape(-1, size)
            which = np.array(batch.column("recording_id").to_pylist(), object)
            for key in dict.fromkeys(which.tolist()):
                part = x[which == key]
                total, linear, n = sums.get(key, (0.0, 0.0, 0))
                sums[key] = (total + part.T @ part, linear + part.sum(0), n + len(part))
        i, j = np.triu_indices(size)
        for key, (total, linear, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j]), pa.array(linear[i]), pa.array(linear[j]), pa.array(np.full(len(i), n))], names=["recording_id", "i", "j", "xy", "x", "y", "n"])

    packed = samples.groupBy(*named, "sample_index").agg(F.sort_array(F.collect_list(F.struct("channel_index", "value"))).alias("c")).where(F.size("c") == size)
    rows = packed.select((F.col("recording_id").cast("string") if named else F.lit("")).alias("recording_id"), F.transform("c", lambda c: c["value"]).alias("row"))
    parts = rows.mapInArrow(gram, "recording_id string, i int, j int, xy double, x double, y double, n long")
    return parts.groupBy(*named, "i", "j").agg(((F.sum("xy") - F.sum("x") * F.sum("y") / F.sum("n")) / (F.sum("n") - ddof)).alias("cov"))
