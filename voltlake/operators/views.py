"""Numeric work behind displays: mirrored sensors, maps, trace bins, event lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.keys import ids


def mirror_partners(layout: DataFrame, limit: float = 0.18) -> DataFrame:
    """The sensor nearest to (-x, y), if closer than the limit. A layout has some hundreds of rows and is held in one."""
    whole = layout.agg(F.collect_list(F.struct("channel_index", "x", "y")).alias("all"))
    near = F.element_at(F.array_sort(F.transform("all", lambda o: F.struct(F.hypot(o["x"] + F.col("me.x"), o["y"] - F.col("me.y")).alias("distance"), o["channel_index"].alias("partner")))), 1)
    return whole.select(F.explode("all").alias("me"), "all").select(F.col("me.channel_index").alias("channel_index"), near.alias("n")).select("channel_index", "n.partner", "n.distance").where(F.col("distance") < limit)


def mirrored_selection(selection: DataFrame, layout: DataFrame) -> DataFrame:
    pairs = mirror_partners(layout)
    return selection.select("channel_index").unionByName(selection.join(pairs, "channel_index").select(F.col("partner").alias("channel_index"))).distinct()


def unpositioned(channels: DataFrame, layout: DataFrame) -> DataFrame:
    return channels.select("channel_index").join(layout.select("channel_index"), "channel_index", "left_anti")


def topomap(values: DataFrame, layout: DataFrame, size: int) -> DataFrame:
    """Inverse-distance (power 3) map on a size x size grid over the unit circle; a sensor's own value within half a cell."""
    sensors = values.join(layout, "channel_index").groupBy(*ids(values)).agg(F.collect_list(F.struct("x", "y", "value")).alias("all"))
    step = 2.0 / (size - 1)
    grid = sensors.select(*ids(values), "all", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("k")).withColumn("gx", F.pmod("k", F.lit(size)) * step - 1).withColumn("gy", F.floor(F.col("k") / size) * step - 1)
    d2 = lambda s: (s["x"] - F.col("gx")) ** 2 + (s["y"] - F.col("gy")) ** 2
    exact = F.filter("all", lambda s: d2(s) < 0.5 * step * step)
    weight = lambda s: F.lit(1.0) / F.pow(F.greatest(d2(s), F.lit(1e-12)), F.lit(1.5))
    sums = F.aggregate("all", F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v")), lambda a, s: F.struct((a["w"] + weight(s)).alias("w"), (a["v"] + weight(s) * s["value"]).alias("v")))
    return grid.where("gx * gx + gy * gy <= 1.0000001").select(*ids(values), "k", F.when(F.size(exact) > 0, F.get(exact, 0)["value"]).otherwise(sums["v"] / sums["w"]).alias("value"))


def trace_bins(samples: DataFrame, n_bins: int, n_samples: int) -> DataFrame:
    """Mean of each pixel bin, values clamped to robust limits (p2, p98 around p50)."""
    named = [*ids(samples), "channel_index"]
    limits = samples.groupBy(*named).agg(F.percentile("value", 0.02).alias("low"), F.percentile("value", 0.5).alias("mid"), F.percentile("value", 0.98).alias("high"))
    clamped = samples.join(limits, named).withColumn("v", F.greatest("low", F.least("high", "value")))
    return clamped.groupBy(*named, F.floor(F.col("sample_index") * n_bins / n_samples).alias("bin")).agg(F.avg("v").alias("value"))


def event_lanes(events: DataFrame, lanes: int, source: str = "source_file") -> DataFrame:
    """Source index (rank of the sorted distinct sources) and lane."""
    sources = events.select(source).distinct().withColumn("source_index", F.row_number().over(Window.orderBy(source)) - 1)  # a row a file
    return events.join(F.broadcast(sources), source).withColumn("lane", F.col("source_index") % lanes)


def dense_markers(events: DataFrame, low: float, high: float, pixels: int, most: int = 180) -> DataFrame:
    """Visible events; beyond ``most`` of them, the first of each (source, pixel)."""
    shown = events.where(F.col("begin_s").between(low, high)).withColumn("pixel", F.round((F.col("begin_s") - low) / (high - low) * pixels).cast("long"))
    n = shown.agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("source_index", "pixel").orderBy("begin_s", "event_id"))
    return shown.withColumn("nth", nth).crossJoin(F.broadcast(n)).where((F.col("n") <= most) | (F.col("nth") == 1)).drop("n", "nth")


def shown(rows: DataFrame, cap: int, *order: str) -> DataFrame:
    """The first rows that a table view lists (a display feature: pairs and channels 80, decisions 120), in order."""
    return rows.orderBy(*order).limit(cap)
