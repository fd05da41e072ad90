"""Joins, sorts, epochs, health, views: queries and SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.operators import correct, detect, epochs, health, joins, topk, views
from voltlake.operators.keys import ids
from voltlake.plans.registry import CHANNELS, RATE, SERIES, SIGNAL, TRACK, both, circle, n_samples, out, query, r, series, signal, table, track

_RANGES = "seg AS (SELECT user_id AS segment_id, floor(min(t))::BIGINT AS a, floor(min(t))::BIGINT + 5000 AS b FROM e GROUP BY 1), art AS (SELECT event_id AS id, floor(t)::BIGINT AS a, floor(t)::BIGINT + floor(value)::BIGINT AS b FROM e WHERE code = 'error')"


def ranges(spark, d):
    e = track(spark, d)
    start = F.floor(F.min("begin_s"))
    seg = e.groupBy(F.col("user_id").alias("segment_id")).agg(start.alias("start_sample"), (start + 5000).alias("end_sample"))
    art = e.where("code = 'error'").select(F.col("event_id").alias("artifact_id"), F.floor("begin_s").alias("start_sample"), (F.floor("begin_s") + F.floor("value")).alias("end_sample"))
    return seg, art


@query(f"WITH {TRACK}, {_RANGES} SELECT segment_id, least(coalesce(sum(least(art.b, seg.b) - greatest(art.a, seg.a) + 1), 0), 5001)::BIGINT AS overlap_samples, count(art.id) AS n_intervals FROM seg LEFT JOIN art ON art.a <= seg.b AND art.b >= seg.a GROUP BY segment_id")
def artifact_overlap(spark, d):
    return joins.artifact_overlap(*ranges(spark, d)).select("segment_id", "overlap_samples", "n_intervals")


@query(f"WITH {TRACK}, {_RANGES} SELECT segment_id, least(coalesce(sum(least(art.b, seg.b) - greatest(art.a, seg.a) + 1), 0), 5001)::BIGINT AS overlap_samples, count(art.id) AS n_intervals FROM seg LEFT JOIN art ON art.a <= seg.b AND art.b >= seg.a GROUP BY segment_id")
def artifact_overlap_by_sweep(spark, d):
    return joins.swept_overlap(*ranges(spark, d), size=500).select("segment_id", "overlap_samples", "n_intervals")


_SHORT = "seg AS (SELECT event_id AS segment_id, floor(t)::BIGINT AS a, floor(t)::BIGINT + 40 AS b FROM e WHERE code = 'click'), art AS (SELECT floor(t)::BIGINT AS a, floor(t)::BIGINT + floor(value / 10)::BIGINT AS b FROM e WHERE code = 'error')"


@query(f"WITH {TRACK}, {_SHORT} SELECT segment_id FROM seg WHERE NOT EXISTS (SELECT 1 FROM art WHERE art.a <= seg.b AND art.b >= seg.a)")
def epochs_without_artifacts(spark, d):
    from voltlake.operators.select import without_artifacts

    e, start = track(spark, d), F.floor("begin_s")
    seg = e.where("code = 'click'").select(F.col("event_id").alias("segment_id"), start.alias("start_sample"), (start + 40).alias("end_sample"))
    art = e.where("code = 'error'").select(start.alias("start_sample"), (start + F.floor(F.col("value") / 10)).alias("end_sample"))
    return without_artifacts(seg, art).select("segment_id")


@query("WITH ep AS (SELECT o_orderkey AS k, (o_orderkey * 1000)::BIGINT AS a, (o_orderkey * 1000 + 1500)::BIGINT AS b FROM orders), sg AS (SELECT l_orderkey AS id, min(l_orderkey) * 1000 + 900 AS m FROM lineitem GROUP BY 1) SELECT id AS segment_id, (SELECT min(struct_pack(a := ep.a, k := ep.k)).k FROM ep WHERE m >= ep.a AND m < ep.b)::BIGINT AS epoch_index FROM sg")
def segment_epochs(spark, d):
    ep = table(spark, d, "orders").select(F.col("o_orderkey").alias("epoch_index"), (F.col("o_orderkey") * 1000).alias("begin_us"), (F.col("o_orderkey") * 1000 + 1500).alias("end_us"))
    sg = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment_id")).distinct().select("segment_id", (F.col("segment_id") * 1000 + 800).alias("begin_us"), (F.col("segment_id") * 1000 + 1000).alias("end_us"))
    return joins.containing_epoch(sg, ep, 1e5).select("segment_id", "epoch_index")


#: Triggers within the recording: events' times folded into its two seconds.
_TRIG = f"{TRACK}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), g AS (SELECT event_id, code, (t - floor(t / 2) * 2) AS t FROM e)"
_WIN = "w AS (SELECT event_id, code, t, round(t * 250)::BIGINT - 5 AS a FROM g, n WHERE round(t * 250) - 5 >= 0 AND round(t * 250) + 5 <= n), u AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY t, event_id) - 1 AS trial, unnest(range(10)) AS rel FROM w)"
_TRIALS = f"{SIGNAL}, {_TRIG}, {_WIN}, x AS (SELECT code AS category, trial, ch, rel, v FROM u JOIN s ON s.i = a + rel)"


def triggers(spark, d):
    t = F.col("begin_s") - F.floor(F.col("begin_s") / 2) * 2
    e = track(spark, d).select("event_id", "code", t.alias("begin_s"))
    return both(e, e)


def placed(spark, d, number: bool = True):
    """Complete trials of ten samples; with ``number``, their windows with the numbers of trials."""
    n = n_samples(spark, d)
    found = triggers(spark, d).where((F.round(F.col("begin_s") * RATE) >= 5) & (F.round(F.col("begin_s") * RATE) + 5 <= n))
    return epochs.counted_windows(found, RATE, 5, 5, n) if number else epochs.placed_trials(found, RATE, 5, 5, n, False)


def trials(spark, d, number: bool = False):
    """Trials by window; most queries need no numbers."""
    return epochs.windows(placed(spark, d, number), signal(spark, d), 10)


@query(f"WITH {_TRIALS} SELECT category, ch::BIGINT AS channel_index, rel::BIGINT AS rel, round(avg(v), 6) + 0.0 AS value, count(*) AS n_trials FROM x GROUP BY ALL", two=True)
def event_average(spark, d):
    return out(epochs.average_trials(trials(spark, d)), "category", F.col("channel_index").cast("long").alias("channel_index"), F.col("rel").cast("long").alias("rel"), r("value").alias("value"), "n_trials")


@query(f"WITH {_TRIALS}, c AS (SELECT category, ch, rel, v - avg(v) FILTER (rel < 5) OVER (PARTITION BY category, trial, ch) AS v FROM x) SELECT category, ch::BIGINT AS channel_index, rel::BIGINT AS rel, round(avg(v), 6) + 0.0 AS value FROM c GROUP BY ALL", two=True)
def baseline_corrected_average(spark, d):
    return out(epochs.average_trials(epochs.baseline_corrected(trials(spark, d), 5)), "category", F.col("channel_index").cast("long").alias("channel_index"), F.col("rel").cast("long").alias("rel"), r("value").alias("value"))


@query(f"""WITH {_TRIALS}, tn AS (SELECT category, max(trial) + 1 AS nt FROM x GROUP BY 1), p AS (SELECT category, ch, rel, avg(v) AS m, avg(CASE WHEN trial % 2 = 0 THEN v ELSE -v END) AS q, avg(v) FILTER (trial % 2 = 0) AS a, avg(v) FILTER (trial % 2 = 1) AS b FROM x GROUP BY ALL),
o AS (SELECT category, sqrt(avg(m*m)) AS sig, sqrt(avg(q*q)) AS noise, sqrt(avg(m*m) FILTER (rel < 5)) AS base, max(abs(m)) FILTER (rel >= 5) AS peak, corr(a, b) AS r FROM p GROUP BY 1), f AS (SELECT category, sum(s) AS gs, sum(k) AS gk FROM (SELECT category, rel, sqrt(avg(m*m)) AS s, sqrt(avg(q*q)) AS k FROM p GROUP BY ALL) GROUP BY 1)
SELECT category, nt::BIGINT AS trial_count, round(sqrt(nt), 6) AS root_n, round(noise, 6) AS plus_minus_noise, round(sig / noise, 5) AS plus_minus_snr, round(gs / gk, 5) AS gfp_snr, round(base, 6) AS baseline_noise, round(peak / base, 5) AS baseline_snr, round(2 * r / (1 + r), 5) + 0.0 AS split_half FROM tn JOIN o USING (category) JOIN f USING (category)""", two=True)
def snr_metrics(spark, d):
    m = epochs.snr_metrics(trials(spark, d, True), 5)
    return out(m, "category", "trial_count", *(r(c, k).alias(c) for c, k in (("root_n", 6), ("plus_minus_noise", 6), ("plus_minus_snr", 5), ("gfp_snr", 5), ("baseline_noise", 6), ("baseline_snr", 5), ("split_half", 5))))


@query(f"""WITH {_TRIALS}, c AS (SELECT *, avg(v) FILTER (rel < 1) OVER k AS a, avg(v) FILTER (rel >= 9) OVER k AS b FROM x WINDOW k AS (PARTITION BY category, trial, ch)) SELECT category, ch::BIGINT AS channel_index, rel::BIGINT AS rel, round(avg(v - (a + (b - a) * rel / 9)), 6) + 0.0 AS value FROM c GROUP BY ALL""", two=True)
def preview_average(spark, d):
    return out(epochs.linear_baseline_average(trials(spark, d), 10, RATE), "category", F.col("channel_index").cast("long").alias("channel_index"), F.col("rel").cast("long").alias("rel"), r("value").alias("value"))


@query(f"WITH {_TRIALS}, m AS (SELECT category, ch, rel, avg(v) AS m FROM x GROUP BY ALL), e2 AS (SELECT category, ch, sum(m*m) AS e FROM m GROUP BY ALL), k AS (SELECT category, trial, ch, sum(v*m) / any_value(e2.e) AS k FROM x JOIN m USING (category, ch, rel) JOIN e2 USING (category, ch) GROUP BY ALL) SELECT category, ch::BIGINT AS channel_index, trial::BIGINT AS trial, round(k, 5) + 0.0 AS scale FROM k", two=True)
def template_regression(spark, d):
    p = placed(spark, d)
    return out(correct.regression_scales(epochs.windows(p, signal(spark, d), 10), p), "category", F.col("channel_index").cast("long").alias("channel_index"), F.col("trial").cast("long").alias("trial"), r("scale", 5).alias("scale"))


_AVERAGES = "a AS (SELECT l_returnflag AS file, l_linenumber AS ch, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS rel, avg(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY ALL)"


def file_averages(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file_id"), F.lit("all").alias("category"), F.col("l_linenumber").alias("channel_index"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("rel"), F.col("l_quantity").alias("value"))
    return epochs.average_trials(li)


@query(f"WITH {_AVERAGES} SELECT ch AS channel_index, rel, round(sum(n * v) / sum(n), 6) AS by_trials, round(avg(v), 6) AS per_file, sum(n)::BIGINT AS n_trials FROM a GROUP BY ALL")
def grand_average(spark, d):
    a = file_averages(spark, d)
    by = epochs.grand_average(a).select("channel_index", "rel", r("value").alias("by_trials"), "n_trials")
    return by.join(epochs.grand_average(a, "equalPerFile").select("channel_index", "rel", r("value").alias("per_file")), ["channel_index", "rel"])


@query(f"WITH {_AVERAGES}, o AS (SELECT *, dense_rank() OVER (ORDER BY file) - 1 AS k FROM a), q AS (SELECT ch, rel, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * n * v) / sum(n) AS x, count(DISTINCT k) AS f FROM o GROUP BY ALL) SELECT rel, round(sqrt(avg(x*x)), 6) AS noise FROM q WHERE f >= 2 GROUP BY rel")
def file_noise_curve(spark, d):
    a = file_averages(spark, d).withColumn("file_order", F.dense_rank().over(Window.orderBy("file_id")) - 1)
    return epochs.residual_noise_curve(a).select("rel", r("noise").alias("noise"))


@query("SELECT l_returnflag AS category, count(*) AS total, count(*) FILTER (l_discount < 0.05) AS good, min(l_linenumber) AS epoch_length FROM lineitem GROUP BY 1")
def category_summary(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), (F.col("l_discount") < 0.05).alias("is_good"), F.col("l_linenumber").alias("n_samples"))
    return epochs.category_summary(t)


@query("WITH c AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1) SELECT f AS file_id, round(n / sum(n) OVER (), 6) AS weight FROM c")
def normalised_weights(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("file_id")).agg(F.count("*").cast("double").alias("weight")).withColumn("one", F.lit(1))
    return epochs.normalised_weights(c, "one").select("file_id", r("weight").alias("weight"))


@query("SELECT o_orderpriority AS reason, count(*) AS total FROM orders GROUP BY 1")
def rejection_totals(spark, d):
    steps = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("reasons"))
    return epochs.rejection_totals(steps)


_CIRCLE = "l AS (SELECT k AS ch, round(cos(2 * pi() * k / 64) * CASE WHEN k % 2 = 1 THEN 1.0 ELSE 0.55 END, 9) AS x, round(sin(2 * pi() * k / 64) * CASE WHEN k % 2 = 1 THEN 1.0 ELSE 0.55 END, 9) AS y FROM (SELECT unnest(range(64)) AS k))"


def sensors(spark):
    return spark.createDataFrame(circle(CHANNELS), "channel_index int, x double, y double")


def placed_sensors(spark, d):
    """The sensors of the channels that the recording has."""
    return sensors(spark).join(signal(spark, d).select("channel_index").distinct(), "channel_index", "left_semi")


@query(f"WITH {_CIRCLE}, p AS (SELECT a.ch, b.ch AS o, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM l a JOIN l b ON a.ch <> b.ch), k AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY round(d2, 7), o) AS n FROM p) SELECT ch::BIGINT AS channel_index, round(max(d2), 6) AS furthest, count(*) AS n FROM k WHERE n <= 6 GROUP BY ch")
def nearest_neighbours(spark, d):
    return joins.nearest(placed_sensors(spark, d), 6).groupBy(F.col("channel_index").cast("long").alias("channel_index")).agg(r(F.max("d2")).alias("furthest"), F.count("*").alias("n"))


@query("SELECT a.c AS \"left\", b.c AS \"right\" FROM (SELECT DISTINCT l_linenumber AS c FROM lineitem) a JOIN (SELECT DISTINCT l_linenumber AS c FROM lineitem) b ON a.c < b.c")
def channel_pairs(spark, d):
    return joins.channel_pairs(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_index")))


@query("SELECT l_returnflag AS file_id, l_linestatus AS category, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Target' ELSE l_linestatus END AS canonical, count(*) AS n FROM lineitem GROUP BY ALL")
def mapped_categories(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file_id"), F.col("l_linestatus").alias("category"))
    mapping = spark.createDataFrame([("A", "F", "Target")], "file_id string, raw string, canonical string")
    return joins.mapped_category(rows, mapping).groupBy("file_id", "category", "canonical").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_type AS name, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS norm FROM part), d AS (SELECT norm, row_number() OVER (ORDER BY min(name)) AS k FROM n GROUP BY norm),
f AS (SELECT k, norm, norm AS cluster, [norm] AS heads FROM d WHERE k = 1 UNION ALL SELECT d.k, d.norm, coalesce(list_filter(heads, lambda z: levenshtein(z, d.norm) <= 1)[1], d.norm), CASE WHEN len(list_filter(heads, lambda z: levenshtein(z, d.norm) <= 1)) > 0 THEN heads ELSE list_append(heads, d.norm) END FROM f JOIN d ON d.k = f.k + 1) SELECT name, norm, cluster FROM n JOIN f USING (norm)""")
def fuzzy_categories(spark, d):
    w = Window.orderBy("name")
    return joins.fuzzy_clusters(table(spark, d, "part").select(F.col("p_type").alias("name")).distinct().withColumn("order_no", F.row_number().over(w))).select("name", "norm", "cluster")


@query(f"WITH {SIGNAL} SELECT (ch // 8)::BIGINT AS node, i AS sample_index, round(avg(v), 6) + 0.0 AS value FROM s GROUP BY ALL", two=True)
def roi_means(spark, d):
    members = spark.range(CHANNELS).select(F.col("id").cast("int").alias("channel_index"), F.floor(F.col("id") / 8).alias("node"))
    return out(joins.roi_means(signal(spark, d), members), "node", "sample_index", r("value").alias("value"))


@query("WITH f AS (SELECT l_returnflag AS f, count(DISTINCT l_linenumber) AS c, count(*)::DOUBLE AS r FROM lineitem GROUP BY 1), k AS (SELECT c, r FROM f ORDER BY f LIMIT 1) SELECT f.f AS file_id, concat_ws(',', CASE WHEN f.c <> k.c THEN 'channelCount' END, CASE WHEN abs(f.r - k.r) > 1e-4 THEN 'samplingRate' END) AS flags FROM f, k")
def file_compatibility(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("file_id")).agg(F.countDistinct("l_linenumber").alias("n_channels"), F.count("*").cast("double").alias("sampling_rate"))
    first = f.agg(F.min_by(F.struct("n_channels", "sampling_rate"), "file_id").alias("x")).select("x.*")
    return joins.compatibility(f, first).select("file_id", F.array_join("flags", ",").alias("flags"))


@query(f"WITH {SIGNAL} SELECT i AS sample_index, round(sum(v * (ch + 1) / 2080.0), 6) + 0.0 AS value FROM s GROUP BY i", two=True)
def weighted_sources(spark, d):
    weights = spark.range(CHANNELS).select(F.lit(64).alias("target"), F.col("id").cast("int").alias("channel_index"), ((F.col("id") + 1) / F.lit(2080.0)).alias("weight"))
    return out(joins.weighted_sources(signal(spark, d), weights), "sample_index", r("value").alias("value"))


@query(f"WITH {SERIES}, x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM r WINDOW w AS (PARTITION BY ch ORDER BY i)) SELECT ch AS channel_index, i AS sample_index FROM x WHERE v >= a AND v > b", two=True)
def local_peaks(spark, d):
    s = series(spark, d)
    return out(topk.local_peaks(s, *ids(s), "channel_index"), "channel_index", "sample_index")


def _greedy(f):
    def run(spark, d):
        peaks = topk.local_peaks(series(spark, d), "channel_index").select("channel_index", F.col("sample_index").alias("start"), F.col("value").alias("score"))
        return f(peaks)

    return run


merge_nearby_starts = _greedy(lambda p: topk.merge_nearby(p, 4, "channel_index"))
merge_nearby_starts.__name__ = "merge_nearby_starts"
query(f"""WITH RECURSIVE {SERIES}, x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM r WINDOW w AS (PARTITION BY ch ORDER BY i)), p AS (SELECT ch, i, v, row_number() OVER (PARTITION BY ch ORDER BY i) AS k FROM x WHERE v >= a AND v > b),
f AS (SELECT ch, k, i AS ki, v AS kv, NULL::BIGINT AS oi, NULL::DOUBLE AS ov FROM p WHERE k = 1 UNION ALL SELECT p.ch, p.k, CASE WHEN p.i - ki > 4 OR p.v > kv THEN p.i ELSE ki END, CASE WHEN p.i - ki > 4 OR p.v > kv THEN p.v ELSE kv END, CASE WHEN p.i - ki > 4 THEN ki END, CASE WHEN p.i - ki > 4 THEN kv END FROM f JOIN p ON p.ch = f.ch AND p.k = f.k + 1)
SELECT ch AS channel_index, oi AS start, ov AS score FROM f WHERE oi IS NOT NULL UNION ALL SELECT ch, ki, kv FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY k DESC) AS z FROM f) WHERE z = 1""")(merge_nearby_starts)
strongest_peaks = _greedy(lambda p: topk.strongest_non_overlapping(p, 5, "channel_index"))
strongest_peaks.__name__ = "strongest_peaks"
#: Best first, one at a time: a list of what is kept, in recursion over the rank.
_STRONGEST = "o AS (SELECT ch, i, v, row_number() OVER (PARTITION BY ch ORDER BY v DESC, i) AS k FROM p), f AS (SELECT ch, k, [i] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.ch, o.k, CASE WHEN len(list_filter(kept, lambda z: abs(z - o.i) < {spacing})) > 0 THEN kept ELSE list_append(kept, o.i) END FROM f JOIN o ON o.ch = f.ch AND o.k = f.k + 1), z AS (SELECT ch, unnest(arg_max(kept, k)) AS i FROM f GROUP BY ch)"
_PEAKS = "x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM r WINDOW w AS (PARTITION BY ch ORDER BY i)), p AS (SELECT ch, i, v FROM x WHERE v >= a AND v > b)"
query(f"WITH RECURSIVE {SERIES}, {_PEAKS}, {_STRONGEST.format(spacing=5)} SELECT ch AS channel_index, i AS start, v AS score FROM z JOIN o USING (ch, i)")(strongest_peaks)
clustered_peaks = _greedy(lambda p: topk.clustered_peaks(p, 6, "channel_index"))
clustered_peaks.__name__ = "clustered_peaks"
query(f"""WITH RECURSIVE {SERIES}, {_PEAKS}, o AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY i) AS k FROM p),
f AS (SELECT ch, k, i AS fi, i AS ki, v AS kv, NULL::BIGINT AS oi, NULL::DOUBLE AS ov FROM o WHERE k = 1 UNION ALL SELECT o.ch, o.k, CASE WHEN o.i - fi >= 6 THEN o.i ELSE fi END, CASE WHEN o.i - fi >= 6 OR o.v > kv THEN o.i ELSE ki END, CASE WHEN o.i - fi >= 6 OR o.v > kv THEN o.v ELSE kv END, CASE WHEN o.i - fi >= 6 THEN ki END, CASE WHEN o.i - fi >= 6 THEN kv END FROM f JOIN o ON o.ch = f.ch AND o.k = f.k + 1)
SELECT ch AS channel_index, oi AS start, ov AS score FROM f WHERE oi IS NOT NULL UNION ALL SELECT ch, arg_max(ki, k), arg_max(kv, k) FROM f GROUP BY ch""")(clustered_peaks)


#: Local maxima over mean and deviation of the middle half.
_HIGH = "q AS (SELECT ch, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY ch), m AS (SELECT r.ch, avg(v) + {sigmas} * stddev_pop(v) AS lim FROM r JOIN q USING (ch) WHERE v BETWEEN q1 AND q3 GROUP BY r.ch), x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM r WINDOW w AS (PARTITION BY ch ORDER BY i)), p AS (SELECT x.ch, i, v FROM x JOIN m USING (ch) WHERE v >= a AND v > b AND v > lim)"


@query(f"WITH RECURSIVE {SERIES}, {_HIGH.format(sigmas='1.0')}, {_STRONGEST.format(spacing=5)} SELECT ch AS channel_index, i AS start, v AS score FROM z JOIN o USING (ch, i)", two=True)
def spaced_peaks(spark, d):
    s = series(spark, d)
    return out(topk.find_peaks(s, 1.0, 5, *ids(s), "channel_index"), "channel_index", "start", "score")


@query("SELECT l_orderkey AS volume, l_partkey AS candidate, k::BIGINT AS nth FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 3")
def k_smallest(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("volume"), F.col("l_partkey").alias("candidate"), F.struct("l_partkey", "l_suppkey").alias("tie"), F.col("l_extendedprice").alias("distance"))
    return topk.k_smallest(rows, "distance", 3, "volume", tie="tie").select("volume", "candidate", F.col("nth").cast("long").alias("nth"))


@query(f"WITH {SERIES}, k AS (SELECT *, count(*) OVER (PARTITION BY ch) AS n FROM r) SELECT ch AS channel_index, i AS sample_index FROM k WHERE n <= 20 OR floor(i * 20 / n) <> floor((i - 1) * 20 / n)", two=True)
def evenly_spaced_windows(spark, d):
    s = series(spark, d)
    return out(topk.evenly_spaced(s, "sample_index", 20, *ids(s), "channel_index"), "channel_index", "sample_index")


@query("SELECT DISTINCT p_type AS name, row_number() OVER (ORDER BY p_type) AS place FROM (SELECT DISTINCT p_type FROM part)")
def natural_sort(spark, d):
    names = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(*topk.natural_order(F.col("name")))).cast("long").alias("place"))


@query("WITH n AS (SELECT DISTINCT p_brand, p_size FROM part) SELECT p_brand || '-' || p_size || ' x' AS name, row_number() OVER (ORDER BY regexp_extract(p_brand, '[0-9]+')::INT, p_size) AS place FROM n")
def natural_places(spark, d):
    """Names with numbers inside, in natural order, numbered without one task for all."""
    names = table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit(" x")).alias("name")).distinct()
    return topk.numbered(names, topk.natural_key(F.col("name")), F.col("name")).select("name", F.col("place").cast("long").alias("place"))


@query(f"WITH {TRACK} SELECT event_id FROM e WHERE t BETWEEN 5000 AND 90000")
def visible_events(spark, d):
    return topk.visible(track(spark, d), 5000, 90000).select("event_id")


@query(f"WITH {TRACK} SELECT event_id, round(t - 2500.5, 6) AS begin_s FROM e WHERE t - 2500.5 >= 0 AND t - 2500.5 < 100000")
def locked_events(spark, d):
    return detect.locked_events(track(spark, d), -2500.5, 100000.0).select("event_id", r("begin_s").alias("begin_s"))


@query(f"WITH {SIGNAL} SELECT i AS sample_index, arg_max(v, struct_pack(a := abs(v), c := -ch)) AS value FROM s WHERE ch IN (1, 2, 3) GROUP BY i", two=True)
def ocular_drive(spark, d):
    return detect.ocular_drive(signal(spark, d), (1, 2, 3))


@query(f"""WITH {SIGNAL}, dr AS (SELECT i, arg_max(v, struct_pack(a := abs(v), c := -ch)) AS v FROM s WHERE ch IN (0, 1, 2, 3) GROUP BY i), h AS (SELECT i, v, i - row_number() OVER (ORDER BY i) AS g FROM dr WHERE abs(v) >= 0.2),
u AS (SELECT min(i) AS a, max(i) AS b, arg_max(i, struct_pack(m := abs(v), c := -i)) AS p, max(abs(v)) AS m FROM h GROUP BY g HAVING count(*) BETWEEN 1 AND 125), k AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a - max(b) OVER w > 2 THEN 1 ELSE 0 END AS fresh FROM u WINDOW w AS (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), l AS (SELECT *, sum(fresh) OVER (ORDER BY a) AS isle FROM k)
SELECT min(a)::BIGINT AS start_sample, max(b)::BIGINT AS end_sample, arg_min(p, a)::BIGINT AS peak_sample, round(arg_min(m, a), 6) AS peak FROM l GROUP BY isle""", two=True)
def ocular_events(spark, d):
    return out(detect.ocular_events(signal(spark, d), (0, 1, 2, 3), RATE, threshold=0.2, min_s=0.004, rise_s=None, gap_s=0.008), "start_sample", "end_sample", "peak_sample", r("peak").alias("peak"))


@query(f"""WITH {SIGNAL}, dr AS (SELECT i, arg_max(v, struct_pack(a := abs(v), c := -ch)) AS v FROM s WHERE ch IN (0, 1, 2, 3) GROUP BY i), k0 AS (SELECT i, v, abs(v - lag(v) OVER (ORDER BY i)) * 0.25 AS sp, abs(lead(v) OVER (ORDER BY i) - 2 * v + lag(v) OVER (ORDER BY i)) * 0.0625 AS ac FROM dr), h AS (SELECT i, v, sp, ac, i - row_number() OVER (ORDER BY i) AS g FROM k0 WHERE abs(v) >= 0.2),
u AS (SELECT min(i) AS a, max(i) AS b, arg_max(i, struct_pack(m := abs(v), c := -i)) AS p, max(abs(v)) AS m FROM h GROUP BY g HAVING count(*) BETWEEN 1 AND 125 AND coalesce(max(sp), 0) >= 0.05 AND coalesce(max(ac), 0) >= 0.02), k AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a - max(b) OVER w > 2 THEN 1 ELSE 0 END AS fresh FROM u WINDOW w AS (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), l AS (SELECT *, sum(fresh) OVER (ORDER BY a) AS isle FROM k)
SELECT min(a)::BIGINT AS start_sample, max(b)::BIGINT AS end_sample, arg_min(p, a)::BIGINT AS peak_sample, round(arg_min(m, a), 6) AS peak FROM l GROUP BY isle""", two=True)
def ocular_events_with_gates(spark, d):
    found = detect.ocular_events(signal(spark, d), (0, 1, 2, 3), RATE, threshold=0.2, min_s=0.004, rise_s=None, gap_s=0.008, velocity=0.05, acceleration=0.02)
    return out(found, "start_sample", "end_sample", "peak_sample", r("peak").alias("peak"))


@query(f"WITH RECURSIVE {SIGNAL}, r AS (SELECT 0 AS ch, i, sqrt(avg(v * v)) AS v FROM s GROUP BY i), {_HIGH.format(sigmas='0.5')}, {_STRONGEST.format(spacing=10)} SELECT i AS start, round(v, 6) AS score FROM z JOIN o USING (ch, i)", two=True)
def field_power_peaks(spark, d):
    return out(detect.field_power_peaks(signal(spark, d), 0.5, 10), "start", r("score").alias("score"))


@query(f"WITH {SIGNAL}, t AS (SELECT ch, v AS w FROM s WHERE i = 0) SELECT i AS sample_index, round(corr(v, w), 5) + 0.0 AS r FROM s JOIN t USING (ch) GROUP BY i", two=True)
def topography_scores(spark, d):
    s = signal(spark, d)
    return out(detect.topography_scores(s, s.where("sample_index = 0").select(*ids(s), "channel_index", F.col("value").alias("weight"))), "sample_index", r("r", 5).alias("r"))


@query(f"""WITH RECURSIVE {SIGNAL}, t AS (SELECT ch, v AS w FROM s WHERE i = 0), c AS (SELECT i, corr(v, w) AS v FROM s JOIN t USING (ch) GROUP BY i), p AS (SELECT i, v, row_number() OVER (ORDER BY i) AS k FROM c WHERE v >= 0.2),
f AS (SELECT k, i AS ki, v AS kv, NULL::BIGINT AS oi, NULL::DOUBLE AS ov FROM p WHERE k = 1 UNION ALL SELECT p.k, CASE WHEN p.i - ki > 5 OR p.v > kv THEN p.i ELSE ki END, CASE WHEN p.i - ki > 5 OR p.v > kv THEN p.v ELSE kv END, CASE WHEN p.i - ki > 5 THEN ki END, CASE WHEN p.i - ki > 5 THEN kv END FROM f JOIN p ON p.k = f.k + 1)
SELECT oi AS start, round(ov, 5) AS score FROM f WHERE oi IS NOT NULL UNION ALL SELECT arg_max(ki, k), round(arg_max(kv, k), 5) FROM f""", two=True)
def topography_detect(spark, d):
    s = signal(spark, d)
    return _rounded(detect.topography_detect(s, s.where("sample_index = 0").select(*ids(s), "channel_index", F.col("value").alias("weight")), 0.2, 5))


def _rounded(picks):
    return out(picks, "start", r("score", 5).alias("score"))


@query(f"WITH {SIGNAL}, p AS (SELECT ch, max(abs(v)) AS p FROM s GROUP BY ch) SELECT ch::BIGINT AS channel_index, round(p, 6) AS peak, row_number() OVER (ORDER BY p DESC, ch) AS rank FROM p", two=True)
def ranked_channels(spark, d):
    return out(detect.template_channels(signal(spark, d)), F.col("channel_index").cast("long").alias("channel_index"), r("peak").alias("peak"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SIGNAL}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), k AS (SELECT ch, i, v, i // 25 AS tr, i % 25 AS ph FROM s, n WHERE i < n // 25 * 25), f AS (SELECT ch, tr, regr_slope(v, ph) AS m, regr_intercept(v, ph) AS c FROM k GROUP BY ALL), z AS (SELECT k.*, v - c - m * ph AS x FROM k JOIN f USING (ch, tr)),
w AS (SELECT *, avg(x) OVER (PARTITION BY ch, ph ORDER BY tr ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, avg(x) OVER (PARTITION BY ch, ph ORDER BY tr ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS b FROM z)
SELECT ch::BIGINT AS channel_index, i AS sample_index, round(x - CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE 0.5 * a + 0.5 * b END, 6) + 0.0 AS value FROM w UNION ALL SELECT ch::BIGINT, i, round(v, 6) + 0.0 FROM s, n WHERE i >= n // 25 * 25""", two=True)
def gradient_removal(spark, d):
    return out(correct.gradient_removed(signal(spark, d), 0, 25, n_samples(spark, d) // 25), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value").alias("value"))


_UP = "CASE WHEN {x} <= {g} THEN 1.0 WHEN {x} >= {h} THEN 0.0 ELSE 1.0 - ({x} - {g}) / ({h} - {g}) END"
_LOW = "CASE WHEN {x} >= {g} THEN 1.0 WHEN {x} <= {h} THEN 0.0 ELSE ({x} - {h}) / ({g} - {h}) END"


def _u(x, key, table_=health.SEGMENT):
    return _UP.format(x=f"({x})", g=float(table_[key][0]), h=float(table_[key][1]))


SEGMENT_HEALTH_SQL = f"""WITH {SIGNAL}, n AS (SELECT max(i) + 1 AS n FROM s),
x AS (SELECT ch, i, v, i // 63 AS seg, v - lag(v) OVER (PARTITION BY ch ORDER BY i) AS d, row_number() OVER (PARTITION BY ch, i // 63 ORDER BY i) AS k FROM s),
g AS (SELECT seg, i, sqrt(avg(v*v)) AS g FROM x GROUP BY ALL),
b AS (SELECT greatest(quantile_cont(abs(v), 0.95), 1e-9) AS b95, greatest(quantile_cont(abs(v), 0.99), 1e-9) AS b99, greatest(sqrt(avg(d*d)) / greatest(sqrt(avg(v*v)), 1e-9), 1e-9) AS br FROM x),
bg AS (SELECT greatest(quantile_cont(g, 0.95), 1e-9) AS g95, greatest(quantile_cont(g, 0.99), 1e-9) AS g99 FROM g),
f AS (SELECT seg, min(i) AS a, max(i) AS z, sqrt(avg(v*v)) AS rms, quantile_cont(abs(v), 0.95) AS p95, max(abs(v)) AS top, coalesce(sqrt(avg(d*d) FILTER (k > 1)), 0) AS dr, coalesce(avg(CASE WHEN abs(d) <= greatest(b95 * 1e-4, 1e-7) THEN 1.0 ELSE 0.0 END) FILTER (k > 1), 1.0) AS flat, count(*) AS cnt FROM x, b GROUP BY seg),
h AS (SELECT seg, quantile_cont(g, 0.95) AS gp, max(g) AS gm FROM g GROUP BY seg),
c AS (SELECT x.seg, CASE WHEN max(cnt) > 3 AND max(top) > 20 THEN avg(CASE WHEN abs(v) >= top - greatest(top * 0.001, 0.01) THEN 1.0 ELSE 0.0 END) ELSE 0.0 END AS clip FROM x JOIN f USING (seg) GROUP BY 1),
dr AS (SELECT seg, sqrt(avg(q*q)) AS drift FROM (SELECT x.seg, ch, avg(v) FILTER (i >= z - greatest((z - a + 1) // 3, 1)) - avg(v) FILTER (i <= a + greatest((z - a + 1) // 3, 1)) AS q FROM x JOIN f USING (seg) GROUP BY ALL) GROUP BY seg),
t AS (SELECT seg, a, z, rms, p95, gp, gm, drift, 1.0 AS s1, 1.0 AS s2, {_u('gp / g95', 'gfp')} AS s3, {_u('p95 / b95', 'amplitude')} AS s4, {_u('top / b99', 'burst')} AS s5, {_u('gm / g99', 'gfp_bursts')} AS s6, least({_u('flat', 'flat')}, {_u('clip', 'clip')}) AS s7, {_u('dr / greatest(rms, 1e-9) / br', 'fast')} AS s8,
CASE WHEN (z - a + 1) / 250.0 >= 0.25 THEN {_u('drift / greatest(b95 * 0.25, 1e-9)', 'drift')} END AS s9, 1.0 AS s10 FROM f JOIN h USING (seg) JOIN c USING (seg) JOIN dr USING (seg), b, bg),
q AS (SELECT *, (s1*1.2 + s2*0.6 + s3*1.5 + s4*1.2 + s5 + s6 + s7*1.1 + s8 + coalesce(s9*0.8, 0) + s10*2.4) / (1.2 + 0.6 + 1.5 + 1.2 + 1 + 1 + 1.1 + 1 + CASE WHEN s9 IS NULL THEN 0 ELSE 0.8 END + 2.4) AS score FROM t)
SELECT seg::BIGINT AS segment_id, a::BIGINT AS start_sample, z::BIGINT AS end_sample, round(rms, 6) AS rms, round(p95, 6) AS p95, round(gp, 6) AS gfp_p95, round(gm, 6) AS gfp_max, round(drift, 6) AS drift_rms, round(score, 6) AS score, round(score * 100)::BIGINT AS percent, CASE WHEN score >= 0.78 THEN 'good' WHEN score >= 0.5 THEN 'watch' ELSE 'poor' END AS grade FROM q"""


@query(SEGMENT_HEALTH_SQL, two=True)
def segment_health(spark, d):
    h = health.segment_health(signal(spark, d), 63, n_samples(spark, d), CHANNELS, RATE, stride=1)
    return out(h, F.col("segment_id").cast("long").alias("segment_id"), "start_sample", "end_sample", *(r(c).alias(c) for c in ("rms", "p95", "gfp_p95", "gfp_max", "drift_rms", "score")), F.col("percent").cast("long").alias("percent"), "grade")


#: The same over epochs of growing length, 20, 40, 60 ... samples.
_EPOCHS_SQL = SEGMENT_HEALTH_SQL.replace("x AS (SELECT ch, i, v, i // 63 AS seg", "ep AS (SELECT k, 10 * k * (k + 1) AS lo, 10 * (k + 1) * (k + 2) AS hi FROM (SELECT unnest(range(200)) AS k)),\nx AS (SELECT ch, i, v, ep.k AS seg", 1).replace("PARTITION BY ch, i // 63 ORDER BY i) AS k FROM s)", "PARTITION BY ch, ep.k ORDER BY i) AS k FROM s JOIN ep ON i >= lo AND i < hi)", 1)


@query(_EPOCHS_SQL, two=True)
def segment_health_of_epochs(spark, d):
    n, x = n_samples(spark, d), signal(spark, d)
    k = F.col("id")
    grown = spark.range(200).select(k.alias("segment_id"), (10 * k * (k + 1)).alias("start_sample"), F.least(10 * (k + 1) * (k + 2) - 1, F.lit(n - 1)).alias("end_sample")).where(F.col("start_sample") < n)
    named = grown.crossJoin(F.broadcast(x.select(*ids(x)).distinct())) if ids(x) else grown  # two names
    h = health.segment_health(x, 63, n, CHANNELS, RATE, stride=1, segments=named)
    return out(h, F.col("segment_id").cast("long").alias("segment_id"), "start_sample", "end_sample", *(r(c).alias(c) for c in ("rms", "p95", "gfp_p95", "gfp_max", "drift_rms", "score")), F.col("percent").cast("long").alias("percent"), "grade")


_MARKED = "ar AS (SELECT unnest([30, 100]) AS aa, unnest([90, 101]) AS az), ov AS (SELECT seg, coalesce(sum(least(az, z) - greatest(aa, a) + 1) FILTER (aa IS NOT NULL), 0)::BIGINT AS os, count(aa) AS ni, least(1.0, coalesce(sum(least(az, z) - greatest(aa, a) + 1) FILTER (aa IS NOT NULL), 0) / (any_value(z) - any_value(a) + 1)) AS mk FROM f LEFT JOIN ar ON aa <= z AND az >= a GROUP BY seg),"
_MARKED_SQL = (
    SEGMENT_HEALTH_SQL.replace("t AS (SELECT seg, a, z,", _MARKED + "\nt AS (SELECT seg, a, z, os, ni,")
    .replace("1.0 AS s10 FROM f JOIN h USING (seg)", f"CASE WHEN ni > 0 THEN least({_u('mk', 'artifacts')}, 0.15) ELSE {_u('mk', 'artifacts')} END AS s10 FROM f JOIN ov USING (seg) JOIN h USING (seg)")
    .replace("SELECT seg::BIGINT AS segment_id, a::BIGINT", "SELECT seg::BIGINT AS segment_id, os AS overlap_samples, ni AS n_intervals, a::BIGINT")
)


@query(_MARKED_SQL, two=True)
def segment_health_with_artifacts(spark, d):
    art = spark.createDataFrame([(0, 30, 90), (1, 100, 101)], "artifact_id int, start_sample long, end_sample long")
    h = health.segment_health(signal(spark, d), 63, n_samples(spark, d), CHANNELS, RATE, art, stride=1)
    return out(h, F.col("segment_id").cast("long").alias("segment_id"), "overlap_samples", "n_intervals", "start_sample", "end_sample", *(r(c).alias(c) for c in ("rms", "p95", "gfp_p95", "gfp_max", "drift_rms", "score")), F.col("percent").cast("long").alias("percent"), "grade")


def _c(x, key):
    return _u(x, key, health.CHANNEL)


CHANNEL_HEALTH_SQL = f"""WITH {SIGNAL}, x AS (SELECT *, v - lag(v) OVER (PARTITION BY ch ORDER BY i) AS d FROM s), f AS (SELECT ch, sqrt(avg(v*v)) AS rms, quantile_cont(abs(v), 0.95) AS p95, quantile_cont(abs(v), 0.99) AS p99, max(abs(v)) AS top, sqrt(avg(d*d)) AS dr, kurtosis_pop(v) AS k, 2 * (sum(v * cos(2 * pi() * 60 / 250 * i)) ** 2 + sum(v * sin(2 * pi() * 60 / 250 * i)) ** 2) / (count(*) * sum(v*v)) AS line, count(*) AS n FROM x GROUP BY ch),
fl AS (SELECT ch, avg(CASE WHEN abs(d) <= greatest(p95 * 1e-4, 1e-7) THEN 1.0 ELSE 0.0 END) FILTER (d IS NOT NULL) AS flat FROM x JOIN f USING (ch) GROUP BY ch), bl AS (SELECT ch, CASE WHEN count(*) >= 2 THEN stddev_pop(m) ELSE 0 END AS drift FROM (SELECT ch, i // 500 AS b, avg(v) AS m, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 8) GROUP BY ch),
e AS (SELECT *, dr / greatest(rms, 1e-9) AS dq, drift / greatest(rms, 1e-9) AS fq FROM f JOIN fl USING (ch) JOIN bl USING (ch)), b AS (SELECT greatest(quantile_cont(p95, 0.5), 1e-9) AS b95, greatest(quantile_cont(p99, 0.5), 1e-9) AS b99, greatest(quantile_cont(dq, 0.5), 1e-9) AS bd, greatest(coalesce(quantile_cont(fq, 0.5) FILTER (fq > 0), 0.02), 1e-9) AS bf, coalesce(quantile_cont(line, 0.5) FILTER (line > 0), 0) AS bline FROM e),
t AS (SELECT ch, rms, p95, top, line, 1.0 AS s2, {_UP.format(x='greatest(p95 / b95, b95 / p95)', g='2.5', h='6.0')} AS s3, {_c('top / b99', 'burst')} AS s4, {_c('flat', 'flat')} AS s5, 1.0 AS s6, {_c('dq / bd', 'fast')} AS s7, {_c('fq / bf', 'drift')} AS s8, {_c('greatest(k, 0)', 'kurtosis')} AS s9, {_c('line / bline', 'line')} AS s10 FROM e, b),
q AS (SELECT *, (s2*1.4 + s3*1.4 + s4 + s5*1.3 + s6*1.1 + s7 + s8*0.8 + s9 + s10*0.8) / 9.8 AS score FROM t) SELECT ch::BIGINT AS channel_index, round(rms, 6) AS rms, round(p95, 6) AS p95, round(top, 6) AS top, round(line, 6) AS line, round(score, 6) AS score, round(score * 100)::BIGINT AS percent, CASE WHEN score >= 0.78 THEN 'good' WHEN score >= 0.5 THEN 'watch' ELSE 'poor' END AS grade FROM q"""


@query(CHANNEL_HEALTH_SQL, two=True)
def channel_health(spark, d):
    return _channel_table(health.channel_health(signal(spark, d), RATE))


def _channel_table(h, digits=6):
    return out(h, F.col("channel_index").cast("long").alias("channel_index"), *(r(c).alias(c) for c in ("rms", "p95", "top", "line")), r("score", digits).alias("score"), F.col("percent").cast("long").alias("percent"), "grade")


_Z = "(5 + sqrt(ch) * 7.3)"
_IMPEDANCE_SQL = CHANNEL_HEALTH_SQL.replace("1.0 AS s2,", f"CASE WHEN {_Z} < 40 THEN 1.0 WHEN {_Z} < 60 THEN 1 - ({_Z} - 40) / 20 * 0.22 WHEN {_Z} < 70 THEN 0.78 - ({_Z} - 60) / 10 * 0.28 ELSE greatest(0, 0.49 - ({_Z} - 70) / 50 * 0.49) END AS s1, 1.0 AS s2,").replace("(s2*1.4 +", "(s1*1.4 + s2*1.4 +").replace("/ 9.8 AS score", "/ 11.2 AS score").replace("round(score, 6) AS score", "round(score, 5) AS score")


@query(_IMPEDANCE_SQL, two=True)
def channel_health_with_impedance(spark, d):
    z = spark.range(CHANNELS).select(F.col("id").cast("int").alias("channel_index"), (F.lit(5.0) + F.sqrt("id") * 7.3).alias("impedance_kohm"))
    return _channel_table(health.channel_health(signal(spark, d), RATE, z), 5)


@query(f"""WITH {SIGNAL}, {_CIRCLE}, pr AS (SELECT a.ch, b.ch AS o, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM l a JOIN l b ON a.ch <> b.ch), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY d2, o) AS k FROM pr) WHERE k <= 6), ag AS (SELECT ch, max(abs(r)) AS agreement FROM (SELECT nn.ch, o, corr(x.v, y.v) AS r FROM nn JOIN s x ON x.ch = nn.ch JOIN s y ON y.ch = nn.o AND y.i = x.i GROUP BY ALL) GROUP BY ch),
wt AS (SELECT ch, o, (1 / greatest(sqrt(d2), 1e-6)) / sum(1 / greatest(sqrt(d2), 1e-6)) OVER (PARTITION BY ch) AS w FROM nn), bl AS (SELECT wt.ch, s.i, sum(w * v) AS y FROM wt JOIN s ON s.ch = wt.o GROUP BY ALL), pw AS (SELECT s.ch, s.i // 100 AS win, corr(v, y) AS r, count(*) AS n FROM s JOIN bl ON bl.ch = s.ch AND bl.i = s.i GROUP BY ALL), pd AS (SELECT ch, quantile_cont(greatest(r, 0), 0.5) AS prediction FROM pw WHERE n = 100 GROUP BY ch)
SELECT ch::BIGINT AS channel_index, round(agreement, 5) AS agreement, round(prediction, 5) + 0.0 AS prediction, prediction < 0.485 AS bad FROM ag JOIN pd USING (ch)""", two=True)
def neighbour_agreement(spark, d):
    s = signal(spark, d)
    near = joins.nearest(sensors(spark), 6)
    joined = health.neighbour_agreement(s, near).join(health.neighbour_prediction(s, near, 100), [*ids(s), "channel_index"])
    return out(joined, F.col("channel_index").cast("long").alias("channel_index"), r("agreement", 5).alias("agreement"), r("prediction", 5).alias("prediction"), "bad")


@query("SELECT grade, count(*) AS n FROM (SELECT CASE WHEN value / 350 >= 0.78 THEN 'good' WHEN value / 350 >= 0.5 THEN 'watch' ELSE 'poor' END AS grade FROM events) GROUP BY grade")
def grade_counts(spark, d):
    from voltlake.functions.scoring import grade

    return health.grade_counts(table(spark, d, "events").select(grade(F.col("value") / 350).alias("grade")))


@query(f"WITH {SERIES}, m AS (SELECT ch, avg(v) / 200 AS s FROM r GROUP BY ch) SELECT ch AS channel_index, round((least(s, 1.0) * 1.4 + 0.5 * 1.0) / 2.4, 6) AS score FROM m")
def merged_health_metrics(spark, d):
    m = series(spark, d).groupBy("channel_index").agg((F.avg("value") / 200).alias("s"))
    old = m.select("channel_index", F.lit("Amplitude").alias("name"), F.least("s", F.lit(1.0)).alias("score"), F.lit(1.4).alias("weight")).unionByName(m.select("channel_index", F.lit("Spectral").alias("name"), F.lit(0.1).alias("score"), F.lit(1.0).alias("weight")))
    new = m.select("channel_index", F.lit("Spectral").alias("name"), F.lit(0.5).alias("score"), F.lit(1.0).alias("weight"))
    return health.merged_metrics(old, new).select("channel_index", r("score").alias("score"))


@query(f"WITH {_CIRCLE}, p AS (SELECT a.ch, b.ch AS o, sqrt((a.x + b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM l a, l b) SELECT ch::BIGINT AS channel_index, o::BIGINT AS partner FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY d, o) AS k FROM p) WHERE k = 1 AND d < 0.18")
def mirror_partners(spark, d):
    return views.mirror_partners(placed_sensors(spark, d)).select(F.col("channel_index").cast("long").alias("channel_index"), F.col("partner").cast("long").alias("partner"))


@query(f"WITH {_CIRCLE} SELECT unnest(range(70))::BIGINT AS channel_index EXCEPT SELECT ch::BIGINT FROM l")
def unpositioned_channels(spark, d):
    return views.unpositioned(spark.range(70).select(F.col("id").alias("channel_index")), placed_sensors(spark, d).withColumn("channel_index", F.col("channel_index").cast("long")))


@query(f"""WITH {SIGNAL}, {_CIRCLE}, q AS (SELECT x, y, v FROM s JOIN l USING (ch) WHERE i = 10), g AS (SELECT k, (k % 24) * (2.0 / 23) - 1 AS gx, (k // 24) * (2.0 / 23) - 1 AS gy FROM (SELECT unnest(range(576)) AS k)), j AS (SELECT k, v, (x - gx) ** 2 + (y - gy) ** 2 AS d2 FROM g, q WHERE gx * gx + gy * gy <= 1.0000001)
SELECT k::BIGINT AS k, round(coalesce(max(v) FILTER (d2 < 0.5 * (2.0 / 23) ** 2), sum(v / greatest(d2, 1e-12) ** 1.5) / sum(1 / greatest(d2, 1e-12) ** 1.5)), 5) + 0.0 AS value FROM j GROUP BY k""", two=True)
def topographic_map(spark, d):
    return out(views.topomap(signal(spark, d).where("sample_index = 10"), sensors(spark), 24), F.col("k").cast("long").alias("k"), r("value", 5).alias("value"))


@query(f"WITH {SIGNAL}, n AS (SELECT max(i) + 1 AS n FROM s), q AS (SELECT ch, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM s GROUP BY ch) SELECT ch::BIGINT AS channel_index, floor(i * 50 / n)::BIGINT AS bin, round(avg(greatest(a, least(b, v))), 6) + 0.0 AS value FROM s JOIN q USING (ch), n GROUP BY ALL", two=True)
def trace_bins(spark, d):
    return out(views.trace_bins(signal(spark, d), 50, n_samples(spark, d)), F.col("channel_index").cast("long").alias("channel_index"), "bin", r("value").alias("value"))


@query(f"WITH {TRACK} SELECT event_id, (dense_rank() OVER (ORDER BY user_id) - 1)::BIGINT AS source_index, ((dense_rank() OVER (ORDER BY user_id) - 1) % 4)::BIGINT AS lane FROM e")
def event_lanes(spark, d):
    return views.event_lanes(track(spark, d), 4, "user_id").select("event_id", F.col("source_index").cast("long").alias("source_index"), F.col("lane").cast("long").alias("lane"))


@query(f"WITH {TRACK}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id, round((t - 0) / 50000 * 300) ORDER BY t, event_id) AS k, count(*) OVER () AS n FROM e WHERE t BETWEEN 0 AND 50000) SELECT event_id FROM v WHERE n <= 180 OR k = 1")
def dense_markers(spark, d):
    return views.dense_markers(track(spark, d).withColumn("source_index", F.col("user_id")), 0.0, 50000.0, 300).select("event_id")


def crc32_sql(name: str, source: str, text: str, columns: str) -> str:
    """Views that add h, the CRC-32 of a text, to the columns of a view; the table of 256 remainders is made by its rule."""
    return f"""{name}_t AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
{name}_b AS (SELECT {columns}, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT *, encode({text}) AS b FROM {source})),
{name} AS (SELECT {columns}, xor(4294967295, list_reduce([4294967295] || b, lambda c, x: xor(tab[(xor(c, x) % 256) + 1], c >> 8))) AS h FROM {name}_b, {name}_t)"""


@query(
    f"""WITH {_TRIALS}, m AS (SELECT category, ch, trial, avg(v) AS m FROM x WHERE rel >= 5 GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY category, ch ORDER BY trial) - 1 AS k, count(*) OVER (PARTITION BY category, ch) AS n FROM m), t AS (SELECT DISTINCT category, n FROM q WHERE n >= 4), {crc32_sql("o", "t", "'1:' || category", "category, n")},
h0 AS (SELECT category, n, d, (h % 2147483647 + d * 1000003 + k * 7919) % 2147483647 AS h FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, unnest(range(200)) AS d FROM o))), h1 AS (SELECT category, n, d, (h * h + 48271) % 2147483647 AS h FROM h0), h2 AS (SELECT category, n, d, (h * h + 48271) % 2147483647 AS h FROM h1), h3 AS (SELECT category, n, d, (h * h + 48271) % 2147483647 % n AS k, count(*) AS c FROM h2 GROUP BY ALL),
pick AS (SELECT q.category, ch, d, sum(c * m) / any_value(q.n) AS m FROM h3 JOIN q ON q.category = h3.category AND q.n = h3.n AND q.k = h3.k GROUP BY ALL), sd AS (SELECT category, ch, stddev_pop(m) AS sd FROM pick GROUP BY ALL) SELECT category, round(avg(sd), 7) AS sme FROM sd GROUP BY category""",
    two=True,
)
def measurement_error(spark, d):
    return out(epochs.measurement_error(trials(spark, d), 5), "category", r("sme", 7).alias("sme"))


@query(f"WITH {_TRIALS}, a AS (SELECT category, ch, rel, avg(v) AS v FROM x GROUP BY ALL), n AS (SELECT category, count(DISTINCT trial) AS k FROM x GROUP BY 1) SELECT category, any_value(k) AS trial_count, round(sqrt(any_value(k)), 6) AS root_n, round(sqrt(avg(v*v) FILTER (rel < 5)), 6) AS baseline_noise, round(max(abs(v)) FILTER (rel >= 5) / sqrt(avg(v*v) FILTER (rel < 5)), 5) AS baseline_snr FROM a JOIN n USING (category) GROUP BY category".replace("n AS (SELECT category, count", "nn AS (SELECT category, count").replace("JOIN n USING", "JOIN nn USING"), two=True)
def averaged_snr(spark, d):
    m = epochs.snr_for_averaged(epochs.average_trials(trials(spark, d)), 5)
    return out(m, "category", "trial_count", r("root_n").alias("root_n"), r("baseline_noise").alias("baseline_noise"), r("baseline_snr", 5).alias("baseline_snr"))


@query(f"WITH {SIGNAL}, p AS (SELECT max(abs(v)) AS pb, max(abs(v * 0.25)) AS pa, sqrt(avg(v*v)) AS rb, sqrt(avg(v*v*0.0625)) AS ra FROM s) SELECT round(pb, 6) AS peak_before, round(pa, 6) AS peak_after, round(rb, 6) AS rms_before, round(ra, 6) AS rms_after, round(1 - pa / pb, 6) AS peak_reduction, round(1 - ra / rb, 6) AS rms_reduction FROM p", two=True)
def reduction_metrics(spark, d):
    before = signal(spark, d).withColumnRenamed("sample_index", "rel")
    m = epochs.reduction_metrics(before, before.withColumn("value", F.col("value") * 0.25))
    return out(m, *(r(c).alias(c) for c in m.columns if c != "recording_id"))


@query(f"WITH {_TRIALS} SELECT category, ch::BIGINT AS channel_index, round(avg(v), 6) + 0.0 AS value FROM x WHERE rel = 5 GROUP BY ALL", two=True)
def centre_topography(spark, d):
    return out(epochs.centre_topography(epochs.average_trials(trials(spark, d)), 10), "category", F.col("channel_index").cast("long").alias("channel_index"), r("value").alias("value"))


@query("WITH h AS (SELECT l_linenumber AS ch, avg(l_discount) * 10 AS s FROM lineitem GROUP BY 1) SELECT 99 AS target, round(avg(s), 6) AS score FROM h WHERE ch <= 3")
def interpolated_health(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("channel_index")).agg((F.avg("l_discount") * 10).alias("score"))
    w = h.select(F.lit(99).alias("target"), "channel_index", F.when(F.col("channel_index") <= 3, 0.4).otherwise(0.0).alias("weight"))
    return health.interpolated_health(h, w).select("target", r("score").alias("score"))


@query("SELECT count(*) AS candidates, count(*) FILTER (value >= 200) AS matches, max(value) AS best, round(quantile_cont(value, 0.5), 6) AS median FROM events")
def score_summary(spark, d):
    return detect.score_summary(table(spark, d, "events").select(F.col("value").alias("score")), 200.0).withColumn("median", r("median"))


@query("WITH p AS (SELECT l_orderkey AS volume, l_orderkey + l_linenumber - 4 AS candidate, max(1 - l_discount * 2) AS r FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY abs(r) DESC, candidate) AS nth FROM p WHERE abs(r) >= 0.9 AND abs(candidate - volume) <= 3 AND candidate <> volume) SELECT volume, candidate, nth FROM k WHERE nth <= 2")
def correlated_donors(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("volume"), (F.col("l_orderkey") + F.col("l_linenumber") - 4).alias("candidate")).agg(F.max(1 - F.col("l_discount") * 2).alias("r"))
    return topk.correlated_donors(p, 2, 3).select("volume", "candidate", F.col("nth").cast("long").alias("nth"))


@query("WITH t AS (SELECT l_returnflag AS file_id, count(*) AS n, stddev_pop(l_discount) AS s FROM lineitem GROUP BY 1) SELECT file_id, round(CASE WHEN s > 1e-9 THEN 1 / (s * s) ELSE greatest(n, 1) END, 4) AS weight FROM t")
def inverse_variance_weights(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("file_id")).agg(F.count("*").alias("n"), F.stddev_pop("l_discount").alias("s"))
    return t.select("file_id", r(epochs.inverse_variance_weight(F.lit(None).cast("double"), F.col("s"), F.col("n")), 4).alias("weight"))


@query(f"WITH {TRACK}, g AS (SELECT code, count(*) AS n, avg(value) / 350 AS f, min(floor(t))::BIGINT AS a FROM e GROUP BY code), k AS (SELECT *, CASE WHEN f >= 0.78 THEN 'good' WHEN f >= 0.5 THEN 'watch' ELSE 'poor' END AS grade, f > 0.29 AS kept FROM g) SELECT count(*) AS segments, count(*) FILTER (kept) AS kept, sum(100)::BIGINT AS samples, coalesce(sum(100) FILTER (kept), 0)::BIGINT AS kept_samples, count(*) FILTER (NOT kept AND grade = 'poor') AS poor, sum(n)::BIGINT AS overlap_samples FROM k")
def segment_summary(spark, d):
    from voltlake.functions.scoring import grade

    g = track(spark, d).groupBy("code").agg(F.count("*").alias("overlap_samples"), (F.avg("value") / 350).alias("f"), F.floor(F.min("begin_s")).alias("start_sample"))
    k = g.select("overlap_samples", grade(F.col("f")).alias("grade"), (F.col("f") > 0.29).alias("kept"), "start_sample", (F.col("start_sample") + 99).alias("end_sample"))
    return health.segment_summary(k)


@query(f"WITH {_CIRCLE}, p AS (SELECT a.ch, b.ch AS o, sqrt((a.x + b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM l a, l b), m AS (SELECT ch, o FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY d, o) AS k FROM p) WHERE k = 1 AND d < 0.18) SELECT DISTINCT c::BIGINT AS channel_index FROM (SELECT unnest([1, 5, 9]) AS c UNION ALL SELECT o FROM m WHERE ch IN (1, 5, 9))")
def mirrored_selection(spark, d):
    chosen = spark.createDataFrame([(1,), (5,), (9,)], "channel_index int")
    return views.mirrored_selection(chosen, placed_sensors(spark, d)).select(F.col("channel_index").cast("long").alias("channel_index"))
