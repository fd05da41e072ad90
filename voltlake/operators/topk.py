"""Greedy merges, suppression and top-k. Order-dependent steps are folds over the sorted array of an island of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "array<struct<start:bigint,score:double>>"


def _items() -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), (-F.col("score")).alias("neg"))))


def islands(candidates: DataFrame, gap: int, keys: tuple[str, ...], size: int | None = None) -> DataFrame:
    """``candidates`` with __island: candidates further than ``gap`` from the one before begin a new one.

    With ``size``, no key's candidates have to meet in one task: they are looked at in
    blocks of ``size`` samples, and islands are stitched over block edges by what each block
    says in one row: its last candidate, and the last start of an island in it.
    """
    if size is None:
        w = Window.partitionBy(*keys).orderBy("start")
        fresh = F.coalesce((F.col("start") - F.lag("start").over(w) > gap).cast("int"), F.lit(1))
        return candidates.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__fresh")
    placed = candidates.withColumn("__block", F.floor(F.col("start") / size))
    own = Window.partitionBy(*keys, "__block").orderBy("start")
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block

    def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
        edges = rows.groupBy(*keys, "__block").agg(F.max(value).alias("__v"))
        return rows.join(edges.select(*keys, "__block", F.max("__v").over(before).alias(name)), [*keys, "__block"])

    seen = carried(placed, F.col("start"), "__past")
    fresh = seen.withColumn("__first", F.when(F.coalesce(F.col("start") - F.coalesce(F.lag("start").over(own), "__past") > gap, F.lit(True)), F.col("start")))
    known = carried(fresh, F.col("__first"), "__open")
    island = F.coalesce(F.max("__first").over(own.rangeBetween(Window.unboundedPreceding, 0)), "__open")
    return known.withColumn("__island", island).select(*candidates.columns, "__island")


def _folded(candidates: DataFrame, gap: int, keys: tuple[str, ...], items: Column, empty: Column, step, size: int | None = None) -> DataFrame:
    """start, score of what a fold keeps of each island: candidates further than ``gap`` from the one before can't touch it, so folds are as short as islands."""
    apart = islands(candidates, gap, keys, size)
    folded = apart.groupBy(*keys, "__island").agg(items.alias("all")).select(*keys, F.explode(F.aggregate("all", empty, step)).alias("__one"))
    return folded.select(*keys, "__one.start", "__one.score")


def merge_nearby(candidates: DataFrame, gap: int, *keys: str, size: int | None = None) -> DataFrame:
    """Chains of starts no further than ``gap`` from the last kept one: the better stays, and moves the anchor."""

    def step(acc: Column, x: Column) -> Column:
        item = F.struct(x["start"].alias("start"), (-x["neg"]).alias("score"))
        last = F.element_at(acc, -1)
        return (
            F.when(F.size(acc) == 0, F.array(item))
            .when(x["start"] - last["start"] > gap, F.concat(acc, F.array(item)))
            .when(-x["neg"] > last["score"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(item)))
            .otherwise(acc)
        )

    return _folded(candidates, gap, keys, _items(), F.array().cast(ITEM), step, size)


def strongest_non_overlapping(candidates: DataFrame, spacing: int, *keys: str, size: int | None = None) -> DataFrame:
    """Best first; one within ``spacing`` of a kept one goes."""

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: F.abs(k["start"] - x["start"]) < spacing)
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), (-x["neg"]).alias("score")))))

    by_score = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("start").cast("bigint").alias("start"))))
    return _folded(candidates, spacing - 1, keys, by_score, F.array().cast(ITEM), step, size)


def local_peaks(samples: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Samples not below their left and above their right neighbour."""
    w = Window.partitionBy(*keys).orderBy("sample_index")
    return samples.withColumn("__a", F.lag(value).over(w)).withColumn("__b", F.lead(value).over(w)).where((F.col(value) >= F.col("__a")) & (F.col(value) > F.col("__b"))).drop("__a", "__b")


def clustered_peaks(peaks: DataFrame, spacing: int, *keys: str) -> DataFrame:
    """The highest of each cluster; a cluster spans ``spacing`` from its first peak, which doesn't move."""
    acc_type = "array<struct<first:bigint,start:bigint,score:double>>"

    def step(acc: Column, x: Column) -> Column:
        score, last = -x["neg"], F.element_at(acc, -1)
        fresh = F.struct(x["start"].alias("first"), x["start"].alias("start"), score.alias("score"))
        better = F.struct(last["first"].alias("first"), x["start"].alias("start"), score.alias("score"))
        return F.when(F.size(acc) == 0, F.array(fresh)).when(x["start"] - last["first"] >= spacing, F.concat(acc, F.array(fresh))).when(score > last["score"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(better))).otherwise(acc)

    return _folded(peaks, spacing - 1, keys, _items(), F.array().cast(acc_type), step)


def _with(rows: DataFrame, stats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with the statistics of their key; of the one row of statistics without keys."""
    return rows.join(stats, list(keys)) if keys else rows.crossJoin(F.broadcast(stats))


def find_peaks(samples: DataFrame, sigmas: float, spacing: int, *keys: str) -> DataFrame:
    """Local maxima above mean + sigmas * deviation of the middle half of the values, then tallest-first suppression."""
    bounds = samples.groupBy(*keys).agg(F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.75).alias("q3"))
    middle = _with(samples, bounds, keys).where("value BETWEEN q1 AND q3").groupBy(*keys).agg((F.avg("value") + sigmas * F.stddev_pop("value")).alias("limit"))
    high = _with(local_peaks(samples, *keys), middle, keys).where("value > limit")
    return strongest_non_overlapping(high.select(*keys, F.col("sample_index").alias("start"), F.col("value").alias("score")), spacing, *keys)


def k_smallest(rows: DataFrame, by: str, k: int, *keys: str, tie: str = "candidate") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(by, tie)
    return rows.where(F.col(by).isNotNull() & ~F.isnan(by)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def correlated_donors(pairs: DataFrame, k: int, half: int, least: float = 0.9) -> DataFrame:
    """For each volume, the k candidates of |r| >= least within +-half, strongest first."""
    near = pairs.where((F.abs(F.col("r")) >= least) & (F.abs(F.col("candidate") - F.col("volume")) <= half) & (F.col("candidate") != F.col("volume")))
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("volume").orderBy(F.desc(F.abs("r")), "candidate"))).where(F.col("nth") <= k)


def threshold_runs(samples: DataFrame, above: Column, *keys: str) -> DataFrame:
    """Islands of consecutive samples for which ``above`` holds: start, end (inclusive), peak."""
    w = Window.partitionBy(*keys).orderBy("sample_index")
    rows = samples.where(above).withColumn("island", F.col("sample_index") - F.row_number().over(w))
    return rows.groupBy(*keys, "island").agg(F.min("sample_index").alias("start_sample"), F.max("sample_index").alias("end_sample"), F.max(F.abs("value")).alias("peak")).drop("island")


def merge_ranges(ranges: DataFrame, gap: int, *keys: str) -> DataFrame:
    """Ranges no further than ``gap`` from the furthest end so far become one; the higher peak stays."""
    w = Window.partitionBy(*keys).orderBy("start_sample", "end_sample")
    end = F.max("end_sample").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(end.isNull() | (F.col("start_sample") - end > gap), 1).otherwise(0)
    marked = ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"), F.max("peak").alias("peak")).drop("island")


def evenly_spaced(rows: DataFrame, order: str, cap: int, *keys: str) -> DataFrame:
    """At most ``cap`` rows, at even distances of the order (a sampling operator)."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(w) - 1
    return rows.withColumn("n", n).withColumn("i", i).where((F.col("n") <= cap) | (F.floor(F.col("i") * cap / F.col("n")) != F.floor((F.col("i") - 1) * cap / F.col("n")))).drop("n", "i")


def visible(rows: DataFrame, low: float, high: float, at: str = "begin_s") -> DataFrame:
    return rows.where(F.col(at).between(low, high))


def natural_order(name: Column) -> list[Column]:
    """Sort keys by the text before a trailing number, then by the number."""
    return [F.regexp_replace(name, r"\d+$", ""), F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")), F.lit("0")).cast("long"), name]


def natural_key(name: Column) -> Column:
    """Sort key of text with numbers anywhere in it: its parts in order, numbers of any length by value, letters without case. Names that differ in case or leading zeros only tie."""
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    part = lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 6, "0"), number(p))).otherwise(F.lower(p))
    return F.transform(F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0)), part)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with place, from 1, in the order given, which must be one without ties. No window over all rows: they are dealt by ranges, and each range counts on from those before it."""
    from voltlake.operators.tables import written

    at = F.monotonically_increasing_id()
    keys = [f"__k{i}" for i in range(len(order))]
    ranged = df.select("*", *(o.alias(k) for o, k in zip(order, keys, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(ranged.select(*(F.col(c) for c in df.columns), F.spark_partition_id().alias("__part"), at.alias("__at")))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))  # a row a range
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return dealt.join(offsets, "__part").select(*(F.col(c) for c in df.columns), (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("place"))


def totals_before(df: DataFrame, keys: list[str], at: str, value: str, size: int = 65_536) -> DataFrame:
    """``df`` with before, the sum of ``value`` in the key's rows of lesser ``at``, of which each comes once. Rows are looked at in blocks of ``size`` of ``at``, and a block is told the sum of those before it."""
    placed = df.withColumn("__block", F.floor(F.col(at) / size))
    past = Window.partitionBy(*(f"__{c}" for c in keys)).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*(F.col(c).alias(f"__{c}") for c in keys), F.col("__block").alias("__of")).agg(F.sum(value).alias("__n"))  # a row a block
    carried = sums.select(*(f"__{c}" for c in keys), "__of", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__past"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys), F.col("__block").eqNullSafe(F.col("__of")))
    own = Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(carried, same).select(*(F.col(c) for c in df.columns), (F.col("__past") + F.coalesce(F.sum(value).over(own), F.lit(0))).alias("before"))


def numbered_within(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` with place, from 0, in the order given within each key; numbered as by ``numbered``, so no key's rows have to meet in one task."""
    placed = numbered(df, *(F.col(c) for c in (*keys, *order)))
    firsts = placed.groupBy(*(F.col(c).alias(f"__{c}") for c in keys)).agg(F.min("place").alias("__least"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys))
    return placed.join(firsts, same).select(*(F.col(c) for c in df.columns), (F.col("place") - F.col("__least")).alias("place"))
