"""Subspaces of event windows by partial Gram matrices: principal components, optimal basis sets, spatial projections.

Windows are cut out of samples by a join on the sample. What a decomposition needs is a matrix of products, of window
positions (width x width, by channel) or of channels (by recording), and sums. Each task
adds up its windows' matrices, Spark adds up the tasks'; the eigenvectors of such a
matrix, which is small whatever the number of windows, are found where it meets (a group
of width or channels squared). Projections are then joins with those vectors. Signs
are fixed: the largest element of a vector is positive.

Edge cases: windows that leave the recording or lack a sample don't count; an event that repeats
counts each time; a channel without windows keeps its samples; fewer windows than
components leave the rest out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.dsp import symmetric_eigen
from voltlake.operators.keys import ids


#: Numbers that a task holds before it hands its sums on.
HELD = 4_000_000


def event_windows(samples: DataFrame, starts: DataFrame, width: int, line: bool = False) -> DataFrame:
    """Keys, channel_index, start, values (``width`` of them), one row for each window and channel.

    ``starts`` has start and, where samples have it, recording_id. With ``line``, less the line through
    the first and the last value. A sample is matched by equality with the window's samples.
    """
    keys = ids(samples)
    each = starts.select(*keys, F.monotonically_increasing_id().alias("__w"), F.col("start").cast("long").alias("start"))
    wanted = each.select(*keys, "__w", "start", F.explode(F.sequence(F.col("start"), F.col("start") + width - 1)).alias("sample_index"))
    cut = samples.join(wanted, [*keys, "sample_index"]).groupBy(*keys, "channel_index", "__w", "start").agg(F.sort_array(F.collect_list(F.struct("sample_index", F.col("value").cast("double").alias("value")))).alias("s"))
    whole = cut.where(F.size("s") == width).select(*keys, "channel_index", "start", F.transform("s", lambda x: x["value"]).alias("values"))
    if not line or width < 2:
        return whole
    first, last = F.get("values", F.lit(0)), F.get("values", F.lit(width - 1))
    return whole.withColumn("__a", first).withColumn("__b", last).withColumn("values", F.transform("values", lambda v, k: v - (F.col("__a") + (F.col("__b") - F.col("__a")) * k / (width - 1)))).drop("__a", "__b")


def window_grams(windows: DataFrame, width: int) -> DataFrame:
    """Keys, channel_index, n, total, gram: number, sum and products (width x width, by rows) of the windows, added up by task first."""
    keys = [*ids(windows), "channel_index"]
    named = windows.select(F.to_json(F.struct(*keys)).alias("__k"), "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            names = np.array(batch.column("__k").to_pylist(), object)
            for name in dict.fromkeys(names.tolist()):
                own = x[names == name]
                part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                totals[name] = totals[name] + part if name in totals else part
                if sum(map(len, totals.values())) > HELD:
                    yield from flushed(totals)
        yield from flushed(totals)

    def flushed(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(total), pa.string()), pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["__k", "at", "v"])
        totals.clear()

    parts = named.mapInArrow(run, "__k string, at int, v double").groupBy("__k", "at").agg(F.sum("v").alias("v"))
    back = F.from_json("__k", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keys).schema.fields))
    packed = parts.groupBy("__k").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v")).withColumn("__f", back)
    return packed.select(*(F.col(f"__f.{k}").alias(k) for k in keys), F.get("v", F.lit(0)).cast("long").alias("n"), F.slice("v", 2, width).alias("total"), F.slice("v", width + 2, width * width).alias("gram"))


def window_components(grams: DataFrame, width: int, most: int, centred: bool = True, of_rows: bool = False) -> DataFrame:
    """Keys, channel_index, component (from 0), eigenvalue, all (sum of the eigenvalues), vector (``width`` values).

    ``centred`` takes the mean window away; with ``of_rows`` each window loses its own mean. A row of ``grams`` is one matrix.
    """
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in grams.select(*ids(grams), "channel_index").schema.fields]
    names = [*ids(grams), "channel_index"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                n, total, gram = row.n, np.asarray(row.total), np.asarray(row.gram).reshape(width, width)
                if centred:
                    gram = gram - np.outer(total, total) / n
                if of_rows:
                    centre = np.eye(width) - 1 / width
                    gram = centre @ gram @ centre
                values, vectors = symmetric_eigen(gram)
                values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
                for k in range(min(most, n, width)):
                    rows.append((*(getattr(row, c) for c in names), k, float(values[k]), float(values.sum()), vectors[:, k].tolist()))
            yield pd.DataFrame(rows, columns=[*names, "component", "eigenvalue", "all", "vector"])

    return grams.where("n > 0").mapInPandas(run, ", ".join([*keys, "component int", "eigenvalue double", "all double", "vector array<double>"]))


def obs_variance(samples: DataFrame, starts: DataFrame, width: int, most: int = 10) -> DataFrame:
    """Keys, component (from 1), explained, cumulative, remaining: percent of the windows' variance around their mean, pooled over channels of at least two windows."""
    keys = ids(samples)
    grams = window_grams(event_windows(samples, starts, width), width).where("n > 1")
    pooled = window_components(grams, width, most).groupBy(*keys, "component").agg(F.sum("eigenvalue").alias("v"))
    total = pooled.groupBy(*keys).agg(F.greatest(F.sum("v"), F.lit(1e-300)).alias("total"))
    share = (pooled.join(total, keys) if keys else pooled.crossJoin(F.broadcast(total))).withColumn("explained", 100 * F.col("v") / F.col("total"))  # one row
    upto = share.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("component", "explained"))).alias("all"))  # at most ``most`` items
    summed = F.transform("all", lambda x, k: F.struct((x["component"] + 1).alias("component"), x["explained"].alias("explained"), F.aggregate(F.slice("all", F.lit(1), k + 1), F.lit(0.0), lambda a, y: a + y["explained"]).alias("cumulative")))
    return upto.select(*keys, F.explode(summed).alias("x")).select(*keys, "x.*", (100 - F.col("x.cumulative")).alias("remaining"))


def basis_removed(samples: DataFrame, starts: DataFrame, width: int, components: int = 3) -> DataFrame:
    """``samples`` less, at each window, its projection on mean and leading components of its channel's windows.

    The basis is orthonormal: the components of the uncentred windows less their line. Where windows overlap the parts are averaged.
    """
    keys = [*ids(samples), "channel_index"]
    windows = event_windows(samples, starts, width, line=True)
    basis = window_components(window_grams(windows, width), width, components, centred=False)
    dot = F.aggregate(F.zip_with("values", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    fitted = windows.join(basis, keys).withColumn("__p", dot).select(*keys, "start", F.posexplode(F.transform("vector", lambda v: v * F.col("__p"))).alias("__j", "v"))
    parts = fitted.groupBy(*keys, "start", "__j").agg(F.sum("v").alias("v"), F.count("*").alias("__c"))
    at = parts.groupBy(*keys, (F.col("start") + F.col("__j")).alias("sample_index")).agg(F.avg("v").alias("__v"))
    return samples.join(at, [*keys, "sample_index"], "left").select(*keys, "sample_index", (F.col("value") - F.coalesce("__v", F.lit(0.0))).alias("value"))


def map_components(samples: DataFrame, times: DataFrame, most: int) -> DataFrame:
    """Keys, component, eigenvalue, all, channel_index, weight: leading directions of the maps at ``times`` (sample_index), each map around its own mean."""
    keys = ids(samples)
    maps = samples.join(times.select(*keys, "sample_index").distinct(), [*keys, "sample_index"]).select(*keys, "sample_index", "channel_index", F.col("value").cast("double").alias("value"))
    packed = maps.groupBy(*keys, "sample_index").agg(F.sort_array(F.collect_list(F.struct("channel_index", "value"))).alias("c"))
    widest = packed.select(F.max(F.size("c"))).first()[0] or 0  # channels
    if not widest:
        return samples.select(*keys, F.lit(0).alias("component"), F.lit(0.0).alias("eigenvalue"), F.lit(0.0).alias("all"), F.col("channel_index"), F.lit(0.0).alias("weight")).where("false")
    rows = packed.where(F.size("c") == widest).select(*keys, F.lit(0).alias("channel_index"), F.transform("c", lambda c: c["value"]).alias("values"), F.transform("c", lambda c: c["channel_index"]).alias("channels"))
    found = window_components(window_grams(rows, widest), widest, most, centred=False, of_rows=True).drop("channel_index")
    channels = rows.groupBy(*keys).agg(F.min("channels").alias("channels"))
    named = found.join(channels, keys) if keys else found.crossJoin(F.broadcast(channels))  # one row
    return named.select(*keys, "component", "eigenvalue", "all", F.explode(F.arrays_zip("channels", "vector")).alias("x")).select(*keys, "component", "eigenvalue", "all", F.col("x.channels").alias("channel_index"), F.col("x.vector").alias("weight"))


def projected_out(samples: DataFrame, directions: DataFrame) -> DataFrame:
    """``samples`` less their part along orthonormal ``directions`` (component, channel_index, weight) of their recording: two joins and a sum by sample."""
    keys = ids(samples)
    named = directions.select(*keys, "component", "channel_index", "weight")
    along = samples.join(named, [*keys, "channel_index"]).groupBy(*keys, "sample_index", "component").agg(F.sum(F.col("value") * F.col("weight")).alias("p"))
    part = along.join(named, [*keys, "component"]).groupBy(*keys, "sample_index", "channel_index").agg(F.sum(F.col("p") * F.col("weight")).alias("__v"))
    return samples.join(part, [*keys, "sample_index", "channel_index"], "left").select(*keys, "channel_index", "sample_index", (F.col("value") - F.coalesce("__v", F.lit(0.0))).alias("value"))


def spatial_projection(samples: DataFrame, starts: DataFrame, width: int, components: int = 2, every: int = 1) -> DataFrame:
    """Maps at every ``every``-th sample of the windows give directions, which are projected out of all samples."""
    times = starts.select(*ids(samples), F.explode(F.sequence(F.col("start").cast("long"), F.col("start").cast("long") + width - 1, F.lit(every).cast("long"))).alias("sample_index"))
    return projected_out(samples, map_components(samples, times, components))
