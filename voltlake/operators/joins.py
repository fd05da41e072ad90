"""Joins that are not equi-joins in the first place, planned as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.keys import ids


def interval_overlaps(segments: DataFrame, intervals: DataFrame, bucket: int = 1_024) -> DataFrame:
    """Pairs of overlapping inclusive ranges [start_sample, end_sample], each once.

    Both sides are exploded into buckets and joined on the bucket; a pair counts
    in the bucket of its later start, so long ranges give no duplicates.
    """

    def bucketed(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.greatest(start, end) / bucket))))

    right = bucketed(intervals.withColumnRenamed("start_sample", "a_start").withColumnRenamed("end_sample", "a_end"), "a_start", "a_end")
    pairs = bucketed(segments, "start_sample", "end_sample").join(right, [*ids(segments, intervals), "__b"])
    hit = (F.col("a_start") <= F.col("end_sample")) & (F.col("a_end") >= F.col("start_sample")) & (F.col("__b") == F.floor(F.greatest("a_start", "start_sample") / bucket))
    return pairs.where(hit).drop("__b").withColumn("overlap", F.least("a_end", "end_sample") - F.greatest("a_start", "start_sample") + 1)


def artifact_overlap(segments: DataFrame, intervals: DataFrame, key: str = "segment_id", bucket: int = 1_024) -> DataFrame:
    """Overlapping samples (intervals add up, at most the segment's length) and interval count of every segment."""
    named = ids(segments)
    own = segments.select(*named, key, "start_sample", "end_sample")
    ranges = intervals.select(*ids(segments, intervals), "start_sample", "end_sample")
    summed = interval_overlaps(own, ranges, bucket).groupBy(*named, key).agg(F.sum("overlap").alias("s"), F.count("*").alias("c"))
    length = F.col("end_sample") - F.col("start_sample") + 1
    return segments.join(summed, [*named, key], "left").select(*segments.columns, F.least(F.coalesce("s", F.lit(0)), length).cast("long").alias("overlap_samples"), F.coalesce("c", F.lit(0)).cast("long").alias("n_intervals"))


def containing_epoch(segments: DataFrame, epochs: DataFrame, bucket: float = 1e6) -> DataFrame:
    """The first epoch with begin <= midpoint < end, by (begin, epoch_index), for each segment (begin_us, end_us)."""
    mid = segments.withColumn("mid", (F.col("begin_us") + F.col("end_us")) / 2).withColumn("__b", F.floor(F.col("mid") / bucket))
    named, both = ids(segments), ids(segments, epochs)
    spread = epochs.select(*both, F.col("begin_us").alias("e_begin"), F.col("end_us").alias("e_end"), "epoch_index").withColumn("__b", F.explode(F.sequence(F.floor(F.col("e_begin") / bucket), F.floor(F.col("e_end") / bucket))))
    found = mid.join(spread, [*both, "__b"]).where("mid >= e_begin AND mid < e_end").groupBy(*named, "segment_id").agg(F.min(F.struct("e_begin", "epoch_index")).alias("first"))
    return segments.join(found, [*named, "segment_id"], "left").select(*segments.columns, F.col("first.epoch_index").alias("epoch_index"))


def window_start(rate: float, width: int) -> Column:
    return F.round(F.col("begin_s") * rate).cast("long") - F.lit(width // 2)


def placed_windows(events: DataFrame, rate: float, width: int, n_samples: int) -> DataFrame:
    """Events with the start of their half-open window; windows that leave the recording are dropped."""
    return events.withColumn("start_sample", window_start(rate, width)).where((F.col("start_sample") >= 0) & (F.col("start_sample") + width <= n_samples))


def event_windows(events: DataFrame, rate: float, width: int, n_samples: int) -> DataFrame:
    """A row for each sample of each event's window."""
    placed = placed_windows(events, rate, width, n_samples)
    return placed.withColumn("rel", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("sample_index", F.col("start_sample") + F.col("rel"))


def event_samples(events: DataFrame, samples: DataFrame, rate: float, width: int, n_samples: int) -> DataFrame:
    """Windows joined with samples on the recording and the sample index.

    Windows have a row a sample, not a sample and channel; an array of samples a block
    moves less, but picking from it by lambda is ten times slower than this join.
    """
    return event_windows(events, rate, width, n_samples).join(samples, [*ids(events, samples), "sample_index"])


def nearest(layout: DataFrame, k: int) -> DataFrame:
    """The k nearest other positions of each channel, by squared distance, then channel.

    A layout has some hundreds of rows (one a sensor); it is paired within one
    row that holds all of it, not by a join.
    """
    whole = layout.agg(F.collect_list(F.struct("channel_index", "x", "y")).alias("all"))
    near = F.slice(
        F.array_sort(F.transform(F.filter("all", lambda o: o["channel_index"] != F.col("me.channel_index")), lambda o: F.struct(((o["x"] - F.col("me.x")) ** 2 + (o["y"] - F.col("me.y")) ** 2).alias("d2"), o["channel_index"].alias("neighbour")))), 1, k
    )
    return whole.select(F.explode("all").alias("me"), "all").select(F.col("me.channel_index").alias("channel_index"), F.posexplode(near).alias("nth", "n")).select("channel_index", "nth", "n.neighbour", "n.d2")


def channel_pairs(nodes: DataFrame, node: str = "channel_index") -> DataFrame:
    """All pairs left < right of a node list (some hundreds of rows)."""
    whole = nodes.select(node).distinct().agg(F.sort_array(F.collect_list(node)).alias("all"))
    return whole.select(F.explode("all").alias("left"), "all").select("left", F.explode(F.filter("all", lambda o: o > F.col("left"))).alias("right"))


def mapped_category(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical category by (file_id, raw); the raw name where there is none."""
    return rows.join(mapping.select("file_id", F.col("raw").alias("category"), "canonical"), ["file_id", "category"], "left").withColumn("canonical", F.coalesce("canonical", "category"))


def fuzzy_clusters(names: DataFrame, limit: int = 1) -> DataFrame:
    """name, cluster: normalised names within the edit distance of a cluster's first name join it, first seen first.

    Names (order_no, name) are distinct category names; the greedy order is
    inherently sequential, so it runs as a fold over the list of distinct
    normalised names.
    """
    from voltlake.functions.scoring import normalised_category

    keyed = names.withColumn("norm", normalised_category(F.col("name")))
    distinct = keyed.groupBy("norm").agg(F.min("order_no").alias("order_no")).agg(F.array_sort(F.collect_list(F.struct("order_no", "norm"))).alias("all"))
    empty = F.array().cast("array<struct<norm:string,cluster:string>>")

    def step(acc, x):
        hit = F.filter(acc, lambda c: (c["norm"] == c["cluster"]) & (F.levenshtein(c["cluster"], x["norm"]) <= limit))
        return F.concat(acc, F.array(F.struct(x["norm"].alias("norm"), F.when(F.size(hit) > 0, F.get(hit, 0)["cluster"]).otherwise(x["norm"]).alias("cluster"))))

    clusters = distinct.select(F.explode(F.aggregate("all", empty, step)).alias("c")).select("c.norm", "c.cluster")
    return keyed.join(clusters, "norm").select("name", "norm", "cluster")


def matched_coordinates(channels: DataFrame, sensors: DataFrame) -> DataFrame:
    """Positions by normalised channel name, the first sensor of a name; by position if nothing matches and counts agree."""
    from voltlake.functions.scoring import normalised_channel

    keyed = sensors.withColumn("key", normalised_channel(F.col("label")))
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("sensor_index"))).where("nth = 1")
    named = channels.withColumn("key", normalised_channel(F.col("channel_name"))).join(first.select("key", "x", "y", "z"), "key", "left").drop("key")
    hits = named.agg(F.count("x").alias("hits")).crossJoin(channels.agg(F.count("*").alias("nc"))).crossJoin(sensors.agg(F.count("*").alias("ns")))
    by_place = sensors.select(F.col("sensor_index").alias("channel_index"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    use = (F.col("hits") == 0) & (F.col("nc") == F.col("ns"))
    pick = lambda a, b: F.when(use, F.col(b)).otherwise(F.col(a)).alias(a)
    return named.crossJoin(F.broadcast(hits)).join(by_place, "channel_index", "left").select("channel_index", "channel_name", pick("x", "px"), pick("y", "py"), pick("z", "pz"))


def roi_means(samples: DataFrame, members: DataFrame) -> DataFrame:
    """Mean of the finite values of a node's channels at each sample; 0 without any."""
    from voltlake.functions.scoring import finite

    x = F.when(finite(F.col("value")), F.col("value"))
    return samples.join(F.broadcast(members), "channel_index").groupBy(*ids(samples), "node", "sample_index").agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("value"))


def compatibility(files: DataFrame, reference: DataFrame) -> DataFrame:
    """Flags of each file against the one reference row."""
    ref = reference.select(F.col("n_channels").alias("r_channels"), F.col("sampling_rate").alias("r_rate"))
    differs = F.array_compact(F.array(F.when(F.col("n_channels") != F.col("r_channels"), "channelCount"), F.when(F.abs(F.col("sampling_rate") - F.col("r_rate")) > 1e-4, "samplingRate")))
    return files.crossJoin(F.broadcast(ref)).select(*files.columns, differs.alias("flags"))


def weighted_sources(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """target samples as weighted sums of source channels; weights (target, channel_index, weight) are a sensor table."""
    return samples.join(F.broadcast(weights), "channel_index").groupBy(*ids(samples), "target", "sample_index").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def running_sums(points: DataFrame, keys: list[str], columns: list[str], size: int) -> DataFrame:
    """``points`` (keys, pos, turn, columns) with __<column>: sums over all points up to (pos, turn), itself included; points equal in both come in any order.

    A sweep without one task for a key: points are dealt by ranges of ``size`` positions, what
    lies before a range is one row a range, added up over ranges.
    """
    placed = points.withColumn("__range", F.floor(F.col("pos") / size))
    own = Window.partitionBy(*keys, "__range").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "__range").agg(*(F.sum(c).alias(c) for c in columns))
    carried = totals.select(*keys, "__range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in columns))
    joined = placed.join(carried, [*keys, "__range"])
    return joined.select(*points.columns, *((F.sum(c).over(own) + F.col(f"__before_{c}")).alias(f"__{c}") for c in columns))


def swept_overlap(segments: DataFrame, intervals: DataFrame, key: str = "segment_id", size: int = 65_536) -> DataFrame:
    """``artifact_overlap`` by a sweep: no pairs are made, and an interval costs two points whatever its length.

    The samples that intervals cover up to a place, with repetitions, are a difference of
    sums over starts and ends before it; a segment looks up its two edges. Inclusive ranges; intervals that end before they
    start count as none.
    """
    named = ids(segments, intervals)
    every = ids(segments)
    ranges = intervals.where("end_sample >= start_sample").select(*named, F.col("start_sample").cast("long").alias("a"), (F.col("end_sample") + 1).cast("long").alias("z"))
    own = segments.select(*every, F.col(key).alias("__key"), F.col("start_sample").cast("long").alias("__a"), (F.col("end_sample") + 1).cast("long").alias("__z"))
    nil, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def point(df: DataFrame, pos: str, turn: int, starts, ends, start_sum, end_sum, edge) -> DataFrame:
        return df.select(*named, F.col(pos).alias("pos"), F.lit(turn).alias("turn"), starts.alias("starts"), ends.alias("ends"), start_sum.alias("start_sum"), end_sum.alias("end_sum"), edge.alias("edge"))

    no_edge = F.lit(None).cast("int")
    asked = own.select(*named, F.explode(F.array("__a", "__z")).alias("pos")).distinct()
    points = point(ranges, "z", 0, nil, one, nil, F.col("z"), no_edge).unionByName(point(asked, "pos", 1, nil, nil, nil, nil, F.lit(1))).unionByName(point(ranges, "a", 2, one, nil, F.col("a"), nil, no_edge))
    seen = running_sums(points, named, ["starts", "ends", "start_sum", "end_sum"], size).where("edge IS NOT NULL")
    covered = seen.select(*named, "pos", (F.col("pos") * (F.col("__starts") - F.col("__ends")) - F.col("__start_sum") + F.col("__end_sum")).alias("covered"), F.col("__starts").alias("begun"), F.col("__ends").alias("over"))
    low = covered.select(*named, F.col("pos").alias("__a"), F.col("covered").alias("__low"), F.col("over").alias("__over"))
    high = covered.select(*named, F.col("pos").alias("__z"), F.col("covered").alias("__high"), F.col("begun").alias("__begun"))
    found = own.join(low, [*named, "__a"]).join(high, [*named, "__z"]).select(*every, F.col("__key").alias(key), (F.col("__high") - F.col("__low")).alias("s"), (F.col("__begun") - F.col("__over")).alias("c")).distinct()
    length = F.col("end_sample") - F.col("start_sample") + 1
    return segments.join(found, [*every, key], "left").select(*segments.columns, F.greatest(F.least(F.coalesce("s", nil), length), nil).cast("long").alias("overlap_samples"), F.greatest(F.coalesce("c", nil), nil).cast("long").alias("n_intervals"))


def in_segments(samples: DataFrame, segments: DataFrame, size: int = 4_096) -> DataFrame:
    """``samples`` with segment_id, start_sample, end_sample of the last segment that starts at or before them and hasn't ended; null outside. Segments don't overlap.

    As-of by ranges of ``size`` samples: a range gets the segments that start in it, and the last
    one that started before, so a segment of any length costs one row a range.
    """
    keys = ids(samples)
    starts = segments.select(*keys, F.struct(F.col("start_sample").cast("long").alias("start_sample"), F.col("end_sample").cast("long").alias("end_sample"), F.col("segment_id").alias("segment_id")).alias("s")).withColumn("__range", F.floor(F.col("s.start_sample") / size))
    listed = starts.groupBy(*keys, "__range").agg(F.sort_array(F.collect_list("s")).alias("own"))
    last = samples.groupBy(*keys).agg(F.floor(F.max("sample_index") / size).alias("__last"))
    ranges = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "__last")).alias("__range"))
    every = ranges.join(listed, [*keys, "__range"], "left")
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("__past", F.last(F.element_at("own", -1), ignorenulls=True).over(before))
    known = carried.select(*keys, "__range", F.filter(F.concat(F.array("__past"), F.coalesce("own", F.array().cast(listed.schema["own"].dataType))), lambda s: s.isNotNull()).alias("__all"))
    placed = samples.withColumn("__range", F.floor(F.col("sample_index") / size)).join(known, [*keys, "__range"], "left")
    found = F.try_element_at(F.filter("__all", lambda s: s["start_sample"] <= F.col("sample_index")), F.lit(-1))
    inside = placed.withColumn("__s", found).withColumn("__s", F.when(F.col("__s.end_sample") >= F.col("sample_index"), F.col("__s")))
    return inside.select(*samples.columns, *(F.col(f"__s.{c}").alias(c) for c in ("segment_id", "start_sample", "end_sample")))
