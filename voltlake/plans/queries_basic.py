"""Statistics, windows, scalars, selections: queries and SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.functions import scoring as sc
from voltlake.operators import layout, select, sets, stats, topk, windows
from voltlake.operators.keys import ids
from voltlake.plans.registry import CHANNELS, SERIES, SIGNAL, TRACK, out, query, r, series, signal, table, track


@query(f"WITH {SIGNAL} SELECT ch::BIGINT AS channel_index, round(quantile_cont(abs(v), 0.95), 6) + 0.0 AS p95, round(sqrt(avg(v*v)), 6) + 0.0 AS rms, round(var_pop(v), 6) + 0.0 AS var_pop, round(var_samp(v), 6) + 0.0 AS var_samp, round(sum(v*v), 5) + 0.0 AS energy, round(kurtosis_pop(v), 5) + 0.0 AS kurtosis FROM s GROUP BY ch", two=True)
def channel_statistics(spark, d):
    v, s = F.col("value"), signal(spark, d)
    return s.groupBy(*ids(s), F.col("channel_index").cast("long").alias("channel_index")).agg(r(stats.percentile(F.abs(v), 0.95)).alias("p95"), r(stats.rms(v)).alias("rms"), r(stats.variance_population(v)).alias("var_pop"), r(stats.variance_sample(v)).alias("var_samp"), r(stats.energy(v), 5).alias("energy"), r(stats.excess_kurtosis(v), 5).alias("kurtosis"))


@query(f"WITH {SERIES} SELECT ch AS channel_index, round(greatest(coalesce(quantile_cont(v, 0.5) FILTER (v > 0 AND isfinite(v)), 0), 1e-9), 6) AS interpolated, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS upper, round(quantile_cont(v, 0.5), 6) AS middles FROM r GROUP BY ch", two=True)
def median_rules(spark, d):
    v, s = F.col("value"), series(spark, d)
    return s.groupBy(*ids(s), "channel_index").agg(r(stats.median_interpolated(v)).alias("interpolated"), r(stats.median_upper(v)).alias("upper"), r(stats.median_middles(v)).alias("middles"))


@query("SELECT l_shipmode_channel AS channel_index, v AS value, n FROM (SELECT l_linenumber AS l_shipmode_channel, l_quantity AS v, count(*) AS n, row_number() OVER (PARTITION BY l_linenumber ORDER BY count(*) DESC, l_quantity) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def mode_per_channel(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_index"), F.col("l_quantity").alias("value"))
    return stats.mode(li, "value", "channel_index").select("channel_index", "value", "n")


@query("SELECT l_returnflag AS file_id, round(corr(l_quantity, l_extendedprice), 6) AS r, 0.0::DOUBLE AS constant FROM lineitem GROUP BY 1")
def pearson_by_file(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("file_id")).agg(r(stats.pearson(q, F.col("l_extendedprice"))).alias("r"), stats.pearson(q, F.lit(1.0)).alias("constant"))


@query("WITH t AS (SELECT l_linenumber AS c, l_quantity AS v, max(abs(l_quantity)) OVER (PARTITION BY l_linenumber) AS m, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem) SELECT c AS channel_index, round(CASE WHEN min(n) > 3 AND min(m) > 20 THEN avg(CASE WHEN abs(v) >= m - greatest(m * 0.001, 0.01) THEN 1.0 ELSE 0.0 END) ELSE 0.0 END, 6) AS clipping FROM t GROUP BY c")
def clipping(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_index"), F.col("l_quantity").alias("value"))
    return stats.clipping_fraction(li, "value", "channel_index").withColumn("clipping", r("clipping"))


@query(f"WITH {SIGNAL} SELECT a.ch::BIGINT AS i, b.ch::BIGINT AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM s a JOIN s b ON a.i = b.i AND a.ch <= b.ch GROUP BY ALL", two=True)
def covariance_matrix(spark, d):
    return out(stats.covariance(signal(spark, d), CHANNELS), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r("cov").alias("cov"))


@query("WITH m AS (SELECT o_orderkey AS volume, o_totalprice / 1e5 AS p FROM orders), x AS (SELECT volume, abs(p - lag(p) OVER (ORDER BY volume)) AS d FROM m) SELECT volume, round(coalesce(d * 0.3 * pi() / 180 * 50 + d * 0.7, 0), 6) AS fd FROM x")
def framewise_displacement(spark, d):
    p = F.col("o_totalprice") / 1e5
    zero = F.lit(0.0)
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("volume"), (p * 0.3).alias("roll"), zero.alias("pitch"), zero.alias("yaw"), (p * 0.7).alias("d_s"), zero.alias("d_l"), zero.alias("d_p"))
    return windows.framewise_displacement(m).select("volume", r("fd").alias("fd"))


@query("WITH m AS (SELECT o_orderkey AS volume, o_totalprice / 1e5 AS p FROM orders), x AS (SELECT volume, coalesce(abs(p - lag(p) OVER (ORDER BY volume)), 0) AS fd FROM m) SELECT count(*) FILTER (fd > 1)::BIGINT AS n_above, round(avg(CASE WHEN fd > 1 THEN 1.0 ELSE 0.0 END), 6) AS fraction, round(max(fd), 6) AS top FROM x")
def motion_censoring(spark, d):
    zero = F.lit(0.0)
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("volume"), *(zero.alias(c) for c in ("roll", "pitch", "yaw", "d_l", "d_p")), (F.col("o_totalprice") / 1e5).alias("d_s"))
    fd = windows.framewise_displacement(m)
    return fd.agg(F.count_if(F.col("fd") > 1).alias("n_above"), r(F.avg((F.col("fd") > 1).cast("double"))).alias("fraction"), r(F.max("fd")).alias("top"))


@query(f"WITH {SERIES}, d AS (SELECT ch, v - lag(v) OVER (PARTITION BY ch ORDER BY i) AS x FROM r) SELECT ch AS channel_index, round(sqrt(avg(x*x)), 6) AS carried, round(sqrt(avg(x*x)), 6) AS reset, count(x) AS n FROM d GROUP BY ch", two=True)
def first_differences(spark, d):
    s = series(spark, d)
    by = [*ids(s), "channel_index"]
    each = lambda carry, name: windows.first_difference(s, carry).groupBy(*by).agg(r(F.sqrt(F.avg(F.col("diff") ** 2))).alias(name), F.count("diff").alias(f"n_{name}"))
    return out(each(True, "carried").join(each(False, "reset"), by), "channel_index", "carried", "reset", F.col("n_reset").alias("n"))


@query(f"WITH {SERIES} SELECT ch AS channel_index, i AS sample_index, round(avg(v) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM r", two=True)
def moving_average(spark, d):
    return out(windows.centred_moving_average(series(spark, d), 7), "channel_index", "sample_index", r("smooth").alias("smooth"))


@query(f"WITH {SERIES} SELECT ch AS channel_index, i AS sample_index, round(v - avg(v) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS value FROM r", two=True)
def baseline_removed(spark, d):
    return out(windows.baseline_removed(series(spark, d), 10.0), "channel_index", "sample_index", r("value").alias("value"))


@query(f"WITH {SERIES}, x AS (SELECT *, lead(v) OVER w AS b, lag(v) OVER w AS a FROM r WINDOW w AS (PARTITION BY ch ORDER BY i)) SELECT ch AS channel_index, i AS sample_index, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END, 6) + 0.0 AS d FROM x", two=True)
def central_derivative(spark, d):
    return out(windows.derivative(series(spark, d)), "channel_index", "sample_index", r("d").alias("d"))


@query(f"WITH {SERIES} SELECT ch AS channel_index, i AS sample_index, round(CASE WHEN count(*) OVER (PARTITION BY ch) <= 5 THEN v ELSE avg(v) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS value FROM r", two=True)
def box_car(spark, d):
    return out(windows.box_car(series(spark, d), 5), "channel_index", "sample_index", r("value").alias("value"))


@query(f"WITH {SERIES} SELECT ch AS channel_index, i AS sample_index, round((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 0 THEN stddev_pop(v) OVER w ELSE 1 END, 5) + 0.0 AS z FROM r WINDOW w AS (PARTITION BY ch ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)", two=True)
def sliding_z(spark, d):
    return out(windows.sliding_z(series(spark, d), 9), "channel_index", "sample_index", r("z", 5).alias("z"))


@query(f"WITH {SERIES} SELECT ch AS channel_index, i AS sample_index, round(v / sqrt(greatest(avg(v*v) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 1e-20)), 6) AS value FROM r", two=True)
def sliding_rms(spark, d):
    return out(windows.sliding_rms_normalised(series(spark, d), 9), "channel_index", "sample_index", r("value").alias("value"))


@query(f"WITH {SERIES}, b AS (SELECT ch, i // 10 AS b, avg(v) AS m, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 8) SELECT ch AS channel_index, round(CASE WHEN count(*) >= 2 THEN stddev_pop(m) ELSE 0 END, 6) AS drift FROM b GROUP BY ch", two=True)
def block_drift(spark, d):
    return out(windows.block_mean_drift(series(spark, d), 10), "channel_index", r("drift").alias("drift"))


@query(f"WITH {SIGNAL} SELECT i AS sample_index, round(sqrt(avg(v*v)), 6) AS rms, round(stddev_pop(v), 6) AS deviation FROM s GROUP BY i", two=True)
def global_field_power(spark, d):
    s = signal(spark, d)
    return out(windows.gfp(s), "sample_index", r("gfp").alias("rms")).join(out(windows.gfp(s, "deviation"), "sample_index", r("gfp").alias("deviation")), [*ids(s), "sample_index"])


@query(f"WITH {SIGNAL} SELECT i AS sample_index, ch::BIGINT AS channel_index, round(v - avg(v) FILTER (ch NOT IN (3, 5)) OVER (PARTITION BY i), 6) + 0.0 AS value FROM s", two=True)
def average_reference(spark, d):
    return out(windows.average_reference(signal(spark, d), (3, 5)), "sample_index", F.col("channel_index").cast("long").alias("channel_index"), r("value").alias("value"))


@query("WITH b AS (SELECT o_custkey AS recording_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS block_index, floor(o_totalprice / 1000)::BIGINT + 1 AS n FROM orders) SELECT recording_id, block_index::BIGINT AS block_index, (sum(n) OVER w - n)::BIGINT AS start_sample, (sum(n) OVER w - 1)::BIGINT AS end_sample FROM b WINDOW w AS (PARTITION BY recording_id ORDER BY block_index)")
def block_offsets(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), F.row_number().over(w).cast("long").alias("block_index"), (F.floor(F.col("o_totalprice") / 1000) + 1).alias("n"))
    return windows.block_offsets(b).select("recording_id", "block_index", "start_sample", "end_sample")


@query(f"WITH {SIGNAL} SELECT ch::BIGINT AS channel_index, (i // 4)::BIGINT AS sample_index, round(avg(v), 6) + 0.0 AS value FROM s GROUP BY 1, 2", two=True)
def block_averaged(spark, d):
    return out(layout.block_average(signal(spark, d), 4), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value").alias("value"))


@query(f"WITH {SIGNAL} SELECT ch::BIGINT AS channel_index, (i // 5)::BIGINT AS sample_index, round(v, 6) + 0.0 AS value FROM s WHERE i % 5 = 0", two=True)
def decimated(spark, d):
    return out(layout.decimate(signal(spark, d), 5), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value").alias("value"))


@query(f"""WITH {SIGNAL}, b AS (SELECT ch, i // 4 AS k, avg(v) AS v FROM s GROUP BY 1, 2), g AS (SELECT ch, max(k) AS last, unnest(range((SELECT max(vec_id) + 1 FROM embeddings))) AS i FROM b GROUP BY ch),
p AS (SELECT *, greatest(0.0, least(last::DOUBLE, (i - 1.5) / 4)) AS pos FROM g)
SELECT p.ch::BIGINT AS channel_index, p.i::BIGINT AS sample_index, round(a.v + (c.v - a.v) * (pos - floor(pos)), 6) + 0.0 AS value FROM p JOIN b a ON a.ch = p.ch AND a.k = floor(pos) JOIN b c ON c.ch = p.ch AND c.k = least(floor(pos) + 1, last)""", two=True)
def linear_upsampled(spark, d):
    from voltlake.plans.registry import n_samples

    return out(layout.linear_upsample(layout.block_average(signal(spark, d), 4), 4, n_samples(spark, d)), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value").alias("value"))


@query(f"WITH {SIGNAL} SELECT ch::BIGINT AS channel_index, i AS sample_index, round(v, 6) + 0.0 AS value FROM s", two=True)
def layout_round_trip(spark, d):
    return out(layout.to_samples(layout.to_traces(signal(spark, d))), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value").alias("value"))


_UP = "CASE WHEN {x} <= {g} THEN 1.0 WHEN {x} >= {h} THEN 0.0 ELSE 1.0 - ({x} - {g}) / ({h} - {g}) END"


@query(f"""SELECT event_id, round({_UP.format(x='value / 50', g='2.0', h='6.0')}, 6) AS upper, round(CASE WHEN value <= 0 THEN 0.0 ELSE {_UP.format(x='greatest(value / 50, 50 / value)', g='2.5', h='6.0')} END, 6) AS two_sided,
round(CASE WHEN value / 50 >= 0.995 THEN 1.0 WHEN value / 50 <= 0.9 THEN 0.0 ELSE (value / 50 - 0.9) / 0.095 END, 4) AS lower, CASE WHEN value / 100 >= 0.78 THEN 'good' WHEN value / 100 >= 0.5 THEN 'watch' ELSE 'poor' END AS grade,
round(CASE WHEN value < 40 THEN 1.0 WHEN value < 60 THEN 1 - (value - 40) / 20 * 0.22 WHEN value < 70 THEN 0.78 - (value - 60) / 10 * 0.28 ELSE greatest(0, 0.49 - (value - 70) / 50 * 0.49) END, 6) AS impedance,
CASE WHEN value < 40 THEN 'great' WHEN value < 60 THEN 'good' WHEN value < 70 THEN 'fair' ELSE 'poor' END AS band, printf('%.1f%%', greatest(0.0, least(100.0, value + 0.001))) AS percent, printf('%.1fx', value + 0.001) AS ratio FROM events""")
def score_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", r(sc.score_upper_ratio(v / 50, 2, 6)).alias("upper"), r(sc.score_two_sided_ratio(v / 50, 2.5, 6)).alias("two_sided"), r(sc.score_lower_bound(v / 50, 0.995, 0.9), 4).alias("lower"), sc.grade(v / 100).alias("grade"), r(sc.impedance_score(v)).alias("impedance"), sc.impedance_band(v).alias("band"), sc.format_percent((v + 0.001) / 100).alias("percent"), sc.format_ratio(v + 0.001).alias("ratio")
    )


@query("SELECT DISTINCT p_type AS name, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS norm, levenshtein(lower(p_type), 'standard') AS distance, nullif(trim(p_type), '') AS kept FROM part")
def category_names(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    return p.select("name", sc.normalised_category(F.col("name")).alias("norm"), F.levenshtein(F.lower("name"), F.lit("standard")).cast("long").alias("distance"), sc.non_empty(F.col("name")).alias("kept"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 1e-3 ELSE 1.0 END AS scale FROM part")
def unit_scales(spark, d):
    """A unit a row of ``part``, known and unknown ones."""
    unit = F.element_at(F.array(*map(F.lit, ("V", "mV", "µV", "", "nV", "x"))), F.col("p_size") % 6 + 1)
    return table(spark, d, "part").select("p_partkey", sc.unit_scale(unit).alias("scale"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS dot, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE - list_avg(embedding)))), 6) AS scale FROM embeddings")
def vector_functions(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    centred = sc.mean_centred(F.col("e"))
    return table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", r(sc.dot(F.col("e"), F.col("e")), 5).alias("dot"), r(F.array_max(F.transform(centred, lambda x: F.abs(x)))).alias("scale"))


@query(f"WITH {TRACK} SELECT event_id, code, round(t, 6) AS begin_s, floor(t * 1e6 + 0.5)::BIGINT AS begin_us FROM e")
def event_track(spark, d):
    return track(spark, d).select("event_id", "code", r("begin_s").alias("begin_s"), F.floor(F.col("begin_s") * 1e6 + 0.5).alias("begin_us"))


@query(f"WITH {TRACK} SELECT event_id, code, round(t - 1000, 6) AS begin_s FROM e WHERE t >= 1000 AND t < 200000")
def split_events(spark, d):
    return select.split_events(track(spark, d), 1000.0, 200000.0).select("event_id", "code", r("begin_s").alias("begin_s"))


@query(f"WITH {SIGNAL} SELECT 0 AS part, ch::BIGINT AS channel_index, count(*) AS n, max(i)::BIGINT AS last FROM s WHERE i < 100 GROUP BY ch UNION ALL SELECT 1, ch::BIGINT, count(*), max(i - 100)::BIGINT FROM s WHERE i >= 100 GROUP BY ch", two=True)
def split_samples(spark, d):
    from voltlake.plans.registry import n_samples

    parts = select.split_samples(signal(spark, d), 100, n_samples(spark, d))
    each = [p.groupBy(*ids(p), F.col("channel_index").cast("long").alias("channel_index")).agg(F.count("*").alias("n"), F.max("sample_index").cast("long").alias("last")).withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    return each[0].unionByName(each[1])


@query("WITH c AS (SELECT l_linenumber AS channel_index, count(*) AS n FROM lineitem GROUP BY 1) SELECT channel_index FROM c WHERE channel_index NOT IN (2, 4)")
def included_channels(spark, d):
    channels = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_index")).distinct()
    return select.included_channels(channels, channels.where("channel_index IN (2, 4)"), False)


@query("SELECT DISTINCT l_linenumber AS channel_index FROM lineitem")
def included_channels_fall_back(spark, d):
    channels = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_index")).distinct()
    return select.included_channels(channels, channels, True)


@query(f"WITH {SERIES}, c AS (SELECT ch, count(*) AS n FROM r GROUP BY ch) SELECT ch AS channel_index FROM c WHERE n = (SELECT n FROM c WHERE ch = 0)")
def valid_channels(spark, d):
    counts = series(spark, d).groupBy("channel_index").agg(F.count("*").alias("n"))
    return select.valid_channels(counts, counts)


@query("WITH c AS (SELECT DISTINCT l_linenumber AS ch FROM lineitem) SELECT CASE WHEN ch = 3 THEN 'pns' ELSE 'eeg' END AS role, ch::BIGINT AS was, CASE WHEN ch = 3 THEN 0 ELSE row_number() OVER (PARTITION BY ch = 3 ORDER BY ch) - 1 END::BIGINT AS channel_index FROM c")
def moved_channel(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_index")).distinct().withColumn("was", F.col("channel_index").cast("long")).withColumn("role", F.lit("eeg"))
    return select.move_channel(c, 3, "eeg", "pns").select("role", "was", F.col("channel_index").cast("long").alias("channel_index"))


@query(f"WITH {TRACK}, g AS (SELECT code, avg(value) / 350 AS f FROM e GROUP BY code), h AS (SELECT code, f, CASE WHEN f >= 0.78 THEN 'good' WHEN f >= 0.5 THEN 'watch' ELSE 'poor' END AS grade FROM g) SELECT code, grade IN ('good', 'watch') AND f <= 0.1 AS kept, concat_ws('|', CASE WHEN grade = 'poor' THEN 'health:poor' END, CASE WHEN f > 0.1 THEN printf('artifact_overlap:%.1f%%', f * 100) END) AS reasons FROM h")
def segment_decisions(spark, d):
    g = track(spark, d).groupBy("code").agg((F.avg("value") / 350).alias("overlap_fraction"))
    return select.segment_decisions(g.withColumn("grade", sc.grade(F.col("overlap_fraction"))), ("good", "watch"), 0.1).select("code", "kept", F.array_join("reasons", "|").alias("reasons"))


@query("SELECT p_partkey, CASE WHEN p_size * 6 >= 241 THEN '17,36,237,240' WHEN p_size * 6 >= 127 THEN '7,24,125,126' ELSE '0,1,2,3' END AS blink, CASE WHEN p_size * 6 >= 252 THEN '225,251' WHEN p_size * 6 >= 128 THEN '0,31,124,127' ELSE '0,1,2,3' END AS movement FROM part WHERE p_size * 6 >= 4")
def ocular_presets(spark, d):
    """A net a row of ``part``, with six channels for each unit of its size."""
    n = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 6).cast("int").alias("n")).where("n >= 4")
    return n.select("p_partkey", *(F.array_join(select.ocular_preset(k, F.col("n")), ",").alias(k) for k in ("blink", "movement")))


@query("WITH f AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT f, (sum(n) OVER (ORDER BY f) - n)::BIGINT AS off FROM f) SELECT l_returnflag AS file_id, min(off + k)::BIGINT AS first, max(off + k)::BIGINT AS last, count(*) AS n FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem) JOIN o ON o.f = l_returnflag GROUP BY 1")
def appended_recordings(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("value"))
    placed = topk.numbered_within(rows, ["file_id"], "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = placed.select("file_id", F.lit(0).alias("channel_index"), F.col("place").cast("long").alias("sample_index"), "value")
    files = s.groupBy("file_id").agg(F.count("*").alias("n_samples")).withColumn("n_channels", F.lit(1)).withColumn("file_order", F.dense_rank().over(Window.orderBy("file_id")))
    joined, _ = sets.append_recordings(s, None, files)
    return joined.groupBy("file_id").agg(F.min("sample_index").alias("first"), F.max("sample_index").alias("last"), F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT l_linenumber AS c FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_linenumber + 3 AS c FROM lineitem) SELECT 'union' AS op, c AS channel_index FROM (SELECT c FROM a UNION SELECT c FROM b) UNION ALL SELECT 'intersection', c FROM (SELECT c FROM a INTERSECT SELECT c FROM b) UNION ALL SELECT 'difference', c FROM (SELECT c FROM a EXCEPT SELECT c FROM b)")
def channel_set_operations(spark, d):
    li = table(spark, d, "lineitem")
    a, b = li.where("l_returnflag = 'A'").select(F.col("l_linenumber").alias("channel_index")), li.select((F.col("l_linenumber") + 3).alias("channel_index"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "channel_index")
    return named("union", sets.channel_union(a, b)).unionByName(named("intersection", sets.channel_intersection(a, b))).unionByName(named("difference", sets.good_channels(a.distinct(), b.distinct())))


@query("SELECT count(*) AS n, count(DISTINCT code) AS codes FROM (SELECT event_type AS code, user_id, value, row_number() OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def deduplicated_events(spark, d):
    e = track(spark, d).withColumn("source_file", F.col("user_id")).withColumn("raw_begin", F.floor("value"))
    return sets.distinct_events(e).agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"))


@query("SELECT event_id, name FROM (SELECT event_id, value / 10 AS hz FROM events) JOIN (VALUES ('Delta', 1.0::DOUBLE, 4.0::DOUBLE), ('Theta', 4.0, 8.0), ('Alpha', 8.0, 13.0), ('Beta', 13.0, 30.0), ('Low Gamma', 30.0, 45.0)) t(name, low, high) ON hz >= low AND hz < high")
def band_presets(spark, d):
    """The band of a frequency a row of ``events``."""
    from voltlake.schema import BANDS

    hz = F.col("value") / 10
    band = F.coalesce(*(F.when((hz >= low) & (hz < high), name) for name, low, high in BANDS))
    return table(spark, d, "events").select("event_id", band.alias("name")).where("name IS NOT NULL")


@query(f"WITH {SERIES}, x AS (SELECT ch, i, v, v > 200 AS up, i - row_number() OVER (PARTITION BY ch, v > 200 ORDER BY i) AS g FROM r) SELECT ch AS channel_index, min(i)::BIGINT AS start_sample, max(i)::BIGINT AS end_sample, round(max(abs(v)), 6) AS peak FROM x WHERE up GROUP BY ch, g", two=True)
def threshold_runs(spark, d):
    from voltlake.operators.topk import threshold_runs as runs

    s = series(spark, d)
    return out(runs(s, F.col("value") > 200, *ids(s), "channel_index"), "channel_index", "start_sample", "end_sample", r("peak").alias("peak"))


@query(f"""WITH {SERIES}, x AS (SELECT ch, i, v, i - row_number() OVER (PARTITION BY ch, v > 200 ORDER BY i) AS g FROM r WHERE true), y AS (SELECT ch, min(i) AS a, max(i) AS b, max(abs(v)) AS p FROM (SELECT ch, i, v, i - row_number() OVER (PARTITION BY ch ORDER BY i) AS g FROM r WHERE v > 200) GROUP BY ch, g),
m AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a - max(b) OVER w > 3 THEN 1 ELSE 0 END AS f FROM y WINDOW w AS (PARTITION BY ch ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), n AS (SELECT *, sum(f) OVER (PARTITION BY ch ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT ch AS channel_index, min(a)::BIGINT AS start_sample, max(b)::BIGINT AS end_sample, round(max(p), 6) AS peak FROM n GROUP BY ch, k""", two=True)
def merged_ranges(spark, d):
    from voltlake.operators.topk import merge_ranges
    from voltlake.operators.topk import threshold_runs as runs

    s = series(spark, d)
    by = [*ids(s), "channel_index"]
    return out(merge_ranges(runs(s, F.col("value") > 200, *by), 3, *by), "channel_index", "start_sample", "end_sample", r("peak").alias("peak"))


@query(f"WITH {TRACK}, g AS (SELECT code, t - lag(t) OVER (PARTITION BY code ORDER BY t, event_id) AS d FROM e) SELECT code, round(min(d), 6) AS least, round(max(d), 6) AS most, round(list_sort(list(d) FILTER (d IS NOT NULL))[count(d) // 2 + 1], 6) AS median, count(DISTINCT d) AS n_distinct, max(abs(d - m)) <= 0.001 AS even FROM (SELECT *, list_sort(list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY code))[count(d) OVER (PARTITION BY code) // 2 + 1] AS m FROM g) GROUP BY code")
def trigger_spacing(spark, d):
    from voltlake.operators.detect import trigger_spacing as spacing

    out = spacing(track(spark, d), 0.001, "code")
    return out.select("code", r("least").alias("least"), r("most").alias("most"), r("median").alias("median"), "n_distinct", "even")


@query(f"WITH {SERIES} SELECT ch AS channel_index FROM r GROUP BY ch HAVING count(*) = (SELECT count(*) FROM r WHERE ch = 1)", two=True)
def channels_of_length(spark, d):
    s = series(spark, d)
    n = s.where("channel_index = 1").agg(F.countDistinct("sample_index")).first()[0]
    return out(select.channels_of_length(s, n), "channel_index")


@query("SELECT p_partkey, (p_partkey % 8) > 5 OR ((p_partkey % 8) = 5 AND (p_partkey % 6) >= 2) AS recent FROM part")
def versions(spark, d):
    version = F.concat_ws(".", F.col("p_partkey") % 8, F.col("p_partkey") % 6, F.lit("4 (r28)"))
    return table(spark, d, "part").select("p_partkey", sc.version_at_least(version, 5, 2).alias("recent"))


@query("WITH a AS (SELECT p_partkey, p_partkey % 13 * 1.0 AS r, p_partkey % 180 * 1.0 AS t, p_partkey % 360 * 1.0 AS p FROM part) SELECT p_partkey, round(r * sin(radians(t)) * cos(radians(p)), 6) + 0.0 AS x, round(r * sin(radians(t)) * sin(radians(p)), 6) + 0.0 AS y, round(r * cos(radians(t)), 6) + 0.0 AS z FROM a")
def spherical_positions(spark, d):
    k = F.col("p_partkey")
    found = table(spark, d, "part").select("p_partkey", *sc.spherical_to_cartesian(k % 13, k % 180, k % 360))
    return found.select("p_partkey", *(r(c).alias(c) for c in ("x", "y", "z")))


@query("WITH a AS (SELECT p_partkey AS k, p_partkey % 13 * 1.0 AS x, p_partkey % 7 - 3.0 AS y, p_partkey % 5 * 1.0 AS z FROM part), b AS (SELECT *, sqrt(x * x + y * y + z * z) AS q FROM a) SELECT k AS channel_index, round(x / q, 6) + 0.0 AS x, round(y / q, 6) + 0.0 AS y, round(z / q, 6) + 0.0 AS z FROM b WHERE q > 0")
def unit_geometry(spark, d):
    k = F.col("p_partkey")
    found = layout.unit_geometry(table(spark, d, "part").select(k.alias("channel_index"), (k % 13).cast("double").alias("x"), (k % 7 - 3).cast("double").alias("y"), (k % 5).cast("double").alias("z")))
    return found.select("channel_index", *(r(c).alias(c) for c in ("x", "y", "z")))


@query("WITH c AS (SELECT DISTINCT p_size AS k, 'E' || p_size || CASE WHEN p_size % 2 = 0 THEN '-REF' ELSE '' END AS n FROM part) SELECT k::BIGINT AS channel_index, n AS channel_name, CASE WHEN k <= 40 THEN k * 0.5 END AS x FROM c")
def matched_coordinates(spark, d):
    from voltlake.operators.joins import matched_coordinates as match

    k = F.col("p_size")
    names = table(spark, d, "part").select(k.alias("channel_index"), F.concat(F.lit("E"), k, F.when(k % 2 == 0, "-REF").otherwise("")).alias("channel_name")).distinct()
    sensors = spark.range(1, 41).select((F.col("id") + 100).alias("sensor_index"), F.concat(F.lit("e "), "id").alias("label"), (F.col("id") * 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return match(names, sensors).select(F.col("channel_index").cast("long").alias("channel_index"), "channel_name", "x")
