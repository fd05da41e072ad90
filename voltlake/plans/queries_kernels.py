"""Kernels on traces: queries. SQL where a transform is a finite sum; tests compare the others with generated signals."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.functions import cardiac, dsp
from voltlake.operators import components, kernels, matched, recursive, spectra, subspaces
from voltlake.operators.keys import ids
from voltlake.operators.layout import to_samples, to_traces
from voltlake.operators.tables import new_folder, written
from voltlake.plans.queries_relational import SEGMENT_HEALTH_SQL
from voltlake.plans.registry import CHANNELS, RATE, SIGNAL, circle, n_samples, out, query, r, signal, table
from voltlake.plans.script import Pipeline
from voltlake.sources import packages


def traces(spark, d):
    t = to_traces(signal(spark, d))
    return t if "recording_id" in t.columns else t.withColumn("recording_id", F.lit("embeddings"))


def segments(spark, d) -> list[tuple[int, int]]:
    return [(0, n_samples(spark, d))]


def _spectra_sql(windows: str, length: int) -> str:
    """Views f and p: spectra of the windows (view ``wins``, starts a), and their mean power."""
    return f"""{SIGNAL}, {windows}, x AS (SELECT ch, a, i - a AS k, v FROM s, wins WHERE i >= a AND i < a + {length}), y AS (SELECT ch, a, k, (v - avg(v) OVER (PARTITION BY ch, a)) * (0.5 - 0.5 * cos(2 * pi() * k / {length})) AS v FROM x), b AS (SELECT unnest(range({length // 2})) AS bin),
    f AS (SELECT ch, a, bin, sum(v * cos(2 * pi() * bin * k / {length})) AS re, sum(v * sin(2 * pi() * bin * k / {length})) AS im FROM y, b GROUP BY ALL), p AS (SELECT ch, bin, bin * 250.0 / {length} AS hz, avg(re * re + im * im) AS p FROM f GROUP BY ALL)"""


_SPECTRA = _spectra_sql("wins AS (SELECT unnest(range(0, (SELECT max(vec_id) + 1 FROM embeddings) - 255, 128)) AS a)", 256)


@query(f"WITH {_SPECTRA} SELECT ch::BIGINT AS channel_index, bin::BIGINT AS bin, round(p, 5) AS power FROM p", two=True)
def power_spectrum(spark, d):
    return out(spectra.pooled_spectra(traces(spark, d), segments(spark, d), RATE), F.col("channel_index").cast("long").alias("channel_index"), F.col("bin").cast("long").alias("bin"), r("power", 5).alias("power"))


@query(f"WITH {_SPECTRA}, bands AS (SELECT unnest(['Delta', 'Theta', 'Alpha', 'Beta', 'Low Gamma']) AS band, unnest([1.0, 4.0, 8.0, 13.0, 30.0]) AS lo, unnest([4.0, 8.0, 13.0, 30.0, 45.0]) AS hi), a AS (SELECT ch, band, sum(CASE WHEN hz BETWEEN lo AND hi THEN p ELSE 0 END) AS v FROM p, bands GROUP BY ALL) SELECT ch::BIGINT AS channel_index, band, round(v, 5) AS absolute, round(v / sum(v) OVER (PARTITION BY ch), 6) AS relative, round(log10(greatest(v, 1e-12)), 6) + 0.0 AS log10_power FROM a", two=True)
def band_powers(spark, d):
    b = spectra.band_powers(spectra.pooled_spectra(traces(spark, d), segments(spark, d), RATE))
    return out(b, F.col("channel_index").cast("long").alias("channel_index"), "band", r("absolute", 5).alias("absolute"), r("relative").alias("relative"), r("log10_power").alias("log10_power"))


@query(f"WITH {_SPECTRA}, v AS (SELECT ch, log10(greatest(avg(p), 1e-12)) AS v FROM p WHERE hz BETWEEN 1 AND 100 GROUP BY ch) SELECT ch::BIGINT AS channel_index, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 5) + 0.0 AS z FROM v", two=True)
def spectral_outliers(spark, d):
    return out(spectra.spectral_outliers(spectra.pooled_spectra(traces(spark, d), segments(spark, d), RATE)), F.col("channel_index").cast("long").alias("channel_index"), r("z", 5).alias("z"))


@query(f"WITH {_SPECTRA} SELECT ch::BIGINT AS channel_index, round(regr_slope(log10(greatest(p, 1e-12)), log10(hz)) FILTER (hz BETWEEN 2 AND 40), 5) + 0.0 AS slope, round(sum(p) FILTER (hz > 20 AND hz <= 40) / sum(p) FILTER (hz BETWEEN 2 AND 20), 5) AS emg_ratio, round(max(p) FILTER (abs(bin - 61) <= 1) / quantile_cont(p, 0.5) FILTER (abs(bin - 61) BETWEEN 2 AND 6), 5) AS line_snr FROM p GROUP BY ch", two=True)
def advanced_spectral(spark, d):
    return out(spectra.advanced_spectral(spectra.pooled_spectra(traces(spark, d), segments(spark, d), RATE)), F.col("channel_index").cast("long").alias("channel_index"), r("slope", 5).alias("slope"), r("emg_ratio", 5).alias("emg_ratio"), r("line_snr", 5).alias("line_snr"))


_BANDS = "bands AS (SELECT unnest(['Delta', 'Theta', 'Alpha', 'Beta', 'Low Gamma']) AS band, unnest([1.0, 4.0, 8.0, 13.0, 30.0]) AS lo, unnest([4.0, 8.0, 13.0, 30.0, 45.0]) AS hi)"
_PAIRS = f"""{_BANDS}, fb AS (SELECT band, ch, a, bin, re, im, sqrt(re * re + im * im) AS z FROM f JOIN bands ON bin * 250.0 / 256 BETWEEN lo AND hi), c AS (SELECT x.band, x.ch AS p, y.ch AS q, sum(x.re * y.re + x.im * y.im) AS cr, sum(x.im * y.re - x.re * y.im) AS ci, sum(x.z * x.z) AS px, sum(y.z * y.z) AS py, sum(abs(x.im * y.re - x.re * y.im)) AS ai,
sum((x.re * y.re + x.im * y.im) / (x.z * y.z)) AS lr, sum((x.im * y.re - x.re * y.im) / (x.z * y.z)) AS li, count(*) AS n FROM fb x JOIN fb y ON x.band = y.band AND x.a = y.a AND x.bin = y.bin AND x.ch < y.ch GROUP BY ALL), am AS (SELECT band, ch, a, avg(z) AS z FROM fb GROUP BY ALL), ac AS (SELECT x.band, x.ch AS p, y.ch AS q, corr(x.z, y.z) AS aec FROM am x JOIN am y ON x.band = y.band AND x.a = y.a AND x.ch < y.ch GROUP BY ALL),
pr AS (SELECT p::VARCHAR AS node_a, q::VARCHAR AS node_b, band, unnest(['coherence', 'imaginary_coherence', 'plv', 'wpli', 'aec']) AS metric, unnest([(cr * cr + ci * ci) / (px * py), abs(ci) / sqrt(px * py), sqrt(lr * lr + li * li) / n, abs(ci) / ai, aec]) AS value FROM c JOIN ac USING (band, p, q))"""


@query(f"WITH {_SPECTRA}, {_PAIRS} SELECT node_a, node_b, metric, round(value, 5) + 0.0 AS value FROM pr WHERE band = 'Alpha'", two=True)
def connectivity(spark, d):
    c = spectra.connectivity(traces(spark, d), segments(spark, d), RATE).where("band = 'Alpha'")
    return out(c, "node_a", "node_b", "metric", r("value", 5).alias("value"))


@query(f"WITH {_SPECTRA}, {_PAIRS} SELECT node_a, node_b, band, metric, round(value, 5) + 0.0 AS value FROM pr")
def connectivity_all(spark, d):
    return out(spectra.connectivity(traces(spark, d), segments(spark, d), RATE), "node_a", "node_b", "band", "metric", r("value", 5).alias("value"))


def _result_sql(views: str) -> str:
    return f"""WITH {views}, {_PAIRS}, aa AS (SELECT ch, band, sum(CASE WHEN hz BETWEEN lo AND hi THEN p ELSE 0 END) AS v FROM p, bands GROUP BY ALL), pw AS (SELECT ch, band, v, v / sum(v) OVER (PARTITION BY ch) AS rel FROM aa)
SELECT 'spectral' AS row_type, 'channel' AS scope, (ch + 1)::DOUBLE AS channel_index, 'Ch ' || (ch + 1) AS channel_name, NULL::VARCHAR AS node_a, NULL::VARCHAR AS node_b, band, unnest(['absolute', 'relative', 'log10']) AS metric, round(unnest([v, rel, log10(greatest(v, 1e-12))]), 5) + 0.0 AS value FROM pw
UNION ALL SELECT 'spectral', 'summary', NULL, NULL, NULL, NULL, band, unnest(['absolute', 'relative']), round(unnest([avg(v), avg(rel)]), 5) FROM pw GROUP BY band UNION ALL SELECT 'connectivity', 'pair', NULL, NULL, node_a, node_b, band, metric, round(value, 5) + 0.0 FROM pr"""


@query(_result_sql(_SPECTRA))
def resting_result_rows(spark, d):
    t = traces(spark, d)
    rows = spectra.result_rows(spectra.band_powers(spectra.pooled_spectra(t, segments(spark, d), RATE)), spectra.connectivity(t, segments(spark, d), RATE))
    return _result_table(rows)


def _result_table(rows):
    return out(rows, "row_type", "scope", F.col("channel_index").cast("double").alias("channel_index"), "channel_name", "node_a", "node_b", "band", "metric", r("value", 5).alias("value"))


def _q(name, f, sql=None, two=False):
    def run(spark, d):
        return f(spark, d)

    run.__name__ = name
    query(sql, two)(run)


def _samples(t):
    """Samples of traces, rounded for comparison."""
    return out(to_samples(t), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value", 5).alias("value"))


_N = "(SELECT max(vec_id) + 1 FROM embeddings)"


def _zero_phase(sections: list, lead: float) -> str:
    """Views y0 (channels as a list, by sample) to y<number of sections>: each section forward and backward over the reflected signal."""
    pad = f"least({max(math.ceil(3 * RATE / lead), 24)}, {_N} - 1)"
    views = [f"y0 AS (SELECT i, list(v ORDER BY ch) AS v FROM s GROUP BY i), g AS (SELECT unnest(range(0, {_N} + 2 * {pad})) AS j)"]
    for k, (b, a) in enumerate(sections):
        (b0, b1, b2), (_, a1, a2) = ((f"({float(x)!r}::DOUBLE)" for x in c) for c in (b, a))
        views.append(f"x{k} AS (SELECT j, v FROM g JOIN y{k} ON i = CASE WHEN j < {pad} THEN {pad} - j WHEN j >= {pad} + {_N} THEN 2 * ({_N} - 1) - (j - {pad}) ELSE j - {pad} END)")
        for name, source, value, first, step in ((f"f{k}", f"x{k}", "v", "0", "+ 1"), (f"b{k}", f"f{k}", "y", f"(SELECT max(j) FROM f{k})", "- 1")):
            keep = "(SELECT j, y AS v FROM {0})".format(source) if value == "y" else source
            state = lambda y: f"list_transform(range(1, 65), lambda c: {b1} * v[c] - {a1} * {y}[c] + s2[c]) AS s1, list_transform(range(1, 65), lambda c: {b2} * v[c] - {a2} * {y}[c]) AS s2"  # noqa: E731, B023
            views.append(
                f"{name} AS (SELECT j, y, {state('y')} FROM (SELECT j, v, list_transform(range(1, 65), lambda c: {b0} * v[c]) AS y, list_transform(range(1, 65), lambda c: 0.0::DOUBLE) AS s2 FROM {keep} WHERE j = {first}) UNION ALL SELECT j, y, {state('y')} FROM (SELECT e.j, e.v, p.s2, list_transform(range(1, 65), lambda c: {b0} * e.v[c] + p.s1[c]) AS y FROM {name} p JOIN {keep} e ON e.j = p.j {step}))"
            )
        views.append(f"y{k + 1} AS (SELECT j - {pad} AS i, y AS v FROM b{k} WHERE j >= {pad} AND j < {pad} + {_N})")
    return ", ".join(views)


_BAND = dsp.butterworth("high", 1.0, RATE, 24) + dsp.butterworth("low", 40.0, RATE, 24)
_FLAT = "SELECT unnest(range(64))::BIGINT AS channel_index, i AS sample_index, round(unnest({v}), 5) + 0.0 AS value FROM {t}"
_q("filtered_signal", lambda s, d: _samples(kernels.filtered(traces(s, d), RATE, high=1.0, low=40.0, notch=60.0)), f"WITH RECURSIVE {SIGNAL}, {_zero_phase([*_BAND, dsp.biquad('notch', 60.0, RATE, dsp.NOTCH_Q)], 1.0)} {_FLAT.format(v='v', t='y5')}", True)
_LOWER = dsp.butterworth("high", 10.0, RATE, 24) + dsp.butterworth("low", 40.0, RATE, 24)
_q(
    "filtered_by_blocks",
    lambda s, d: out(recursive.band_pass_blocks(signal(s, d), RATE, high=10.0, low=40.0, notch=60.0, size=128), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value", 5).alias("value")),
    f"WITH RECURSIVE {SIGNAL}, {_zero_phase([*_LOWER, dsp.biquad('notch', 60.0, RATE, dsp.NOTCH_Q)], 10.0)} {_FLAT.format(v='v', t='y5')}",
    True,
)


def _line_sql(strength: float = 1.0) -> str:
    """Sinusoids at 60 and 120 Hz, one after the other, fitted in windows of 4 s that overlap by half."""
    stages, last = [f"n AS (SELECT least({_N}, 1000) AS n, {_N} AS len), st AS (SELECT DISTINCT a FROM (SELECT unnest(range(0, len - n + 1, greatest(1, n // 2))) AS a FROM n UNION ALL SELECT len - n FROM n))"], "s"
    for k in (1, 2):
        stages.append(
            f"w{k} AS (SELECT ch, a, i, v - avg(v) OVER (PARTITION BY ch, a) AS y, sin(2 * pi() * {60 * k} / 250 * i) AS sn, cos(2 * pi() * {60 * k} / 250 * i) AS cs, 0.500001 - 0.5 * cos(2 * pi() * (i - a) / (n - 1)) AS tp FROM {last}, st, n WHERE i >= a AND i < a + n), "
            f"m{k} AS (SELECT ch, a, sum(sn * sn) AS ss, sum(sn * cs) AS sc, sum(cs * cs) AS cc, sum(sn * y) AS sy, sum(cs * y) AS cy, sum(y * y) AS yy FROM w{k} GROUP BY ALL), c{k} AS (SELECT ch, a, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS p, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS q, ss, sc, cc, yy FROM m{k}), "
            f"t{k} AS (SELECT ch, i, sum(CASE WHEN p * p * ss + 2 * p * q * sc + q * q * cc >= {max(2e-4, 2e-3 / strength)} * yy THEN (p * sn + q * cs) * tp ELSE 0 END) / greatest(sum(tp), 1e-6) AS f FROM w{k} JOIN c{k} USING (ch, a) GROUP BY ALL), l{k} AS (SELECT ch, i, v - {strength} * f AS v FROM {last} JOIN t{k} USING (ch, i))"
        )
        last = f"l{k}"
    return f"WITH {SIGNAL}, {', '.join(stages)} SELECT ch::BIGINT AS channel_index, i AS sample_index, round(v, 5) + 0.0 AS value FROM {last}"


_q("line_noise_reduced", lambda s, d: _samples(kernels.line_reduced(traces(s, d), RATE)), _line_sql(), True)
_q("wavelet_reduced", lambda s, d: to_samples(kernels.wavelet_reduced(traces(s, d)), "recording_id", "channel_index"))


def _detail_sql(levels: int = 5) -> str:
    """View dt: each channel's detail energy e by sample, of the dilated 1-4-6-4-1 smoothing with clamped edges."""
    at = lambda k, step: f"v{k}[greatest(1, least(len(v{k}), j + ({step})))]"
    views = ["h0 AS (SELECT ch, list(v ORDER BY i) AS v0 FROM s GROUP BY ch)"]
    for k in range(levels):
        d = 2**k
        views.append(f"h{k + 1} AS (SELECT *, list_transform(range(1, len(v{k}) + 1), lambda j: ({at(k, -2 * d)} + 4 * {at(k, -d)} + 6 * v{k}[j] + 4 * {at(k, d)} + {at(k, 2 * d)}) / 16) AS v{k + 1} FROM h{k})")
    energy = " + ".join(f"(v{k}[j] - v{k + 1}[j]) ** 2" for k in range(levels))
    views.append(f"dt AS (SELECT ch, unnest(range(len(v0))) AS i, unnest(list_transform(range(1, len(v0) + 1), lambda j: sqrt({energy}))) AS e FROM h{levels})")
    return ", ".join(views)


_q(
    "wavelet_ranges",
    lambda s, d: out(kernels.wavelet_ranges(traces(s, d), RATE, sensitivity=0.9, least_s=0.008), "start_sample", "end_sample", r("peak").alias("peak")),
    f"""WITH {SIGNAL}, {_detail_sql()}, q AS (SELECT ch, greatest(quantile_cont(e, 0.95), 1e-12) AS q FROM dt GROUP BY ch), dr AS (SELECT i, max(e / q) AS d FROM dt JOIN q USING (ch) GROUP BY i), h AS (SELECT i, d, i - row_number() OVER (ORDER BY i) AS g FROM dr WHERE d >= 1.4), u AS (SELECT min(i) AS a, max(i) AS b, max(d) AS p FROM h GROUP BY g HAVING count(*) >= 2),
m AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a - max(b) OVER w > 25 THEN 1 ELSE 0 END AS f FROM u WINDOW w AS (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), k AS (SELECT *, sum(f) OVER (ORDER BY a) AS isle FROM m) SELECT min(a)::BIGINT AS start_sample, max(b)::BIGINT AS end_sample, round(max(p), 6) AS peak FROM k GROUP BY isle ORDER BY peak DESC LIMIT 50""",
    True,
)
_q(
    "wavelet_goodness",
    lambda s, d: out(kernels.wavelet_goodness(traces(s, d)), F.col("channel_index").cast("long").alias("channel_index"), r("score", 5).alias("score")),
    f"""WITH {SIGNAL}, {_detail_sql()}, f AS (SELECT ch, avg(e * e) AS a, quantile_cont(e, 0.99) AS b FROM dt GROUP BY ch), k AS (SELECT f.ch, a, b, c FROM f JOIN (SELECT ch, max(abs(v)) AS c FROM s GROUP BY ch) USING (ch)), m AS (SELECT greatest(quantile_cont(a, 0.5), 1e-9) AS ma, greatest(quantile_cont(b, 0.5), 1e-9) AS mb, greatest(quantile_cont(c, 0.5), 1e-9) AS mc FROM k)
SELECT ch::BIGINT AS channel_index, round(0.46 * greatest(0, least(1, 1 - (a / ma - 2) / 6)) + 0.30 * greatest(0, least(1, 1 - (b / mb - 2) / 6)) + 0.24 * greatest(0, least(1, 1 - (c / mc - 2.5) / 6.5)), 5) AS score FROM k, m""",
    True,
)


def _ma(x: str, radius: int) -> str:
    return f"avg({x}) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"


def _slope(x: str) -> str:
    w = "OVER (PARTITION BY ch ORDER BY i)"
    return f"CASE WHEN lag({x}) {w} IS NULL THEN lead({x}) {w} - {x} WHEN lead({x}) {w} IS NULL THEN {x} - lag({x}) {w} ELSE (lead({x}) {w} - lag({x}) {w}) / 2 END"


def _robust(table: str, x: str) -> str:
    """Centre and scale of a column by channel."""
    return f"(SELECT ch, any_value(c) AS c, greatest(1.4826 * quantile_cont(abs({x} - c), 0.5), (quantile_cont({x}, 0.95) - any_value(c)) / 3, 0.1 * sqrt(avg(({x} - c) ** 2)), 1e-6) AS z FROM (SELECT *, quantile_cont({x}, 0.5) OVER (PARTITION BY ch) AS c FROM {table}) GROUP BY ch)"


#: Steps from the slope d of the filtered lead f to its envelope e, at 250 Hz (radii in samples).
_ENVELOPES = {
    "pan_tompkins": f"ev AS (SELECT ch, i, {_ma('d * d', 19)} AS e FROM dd)",
    "hamilton": f"e1 AS (SELECT ch, i, {_ma('abs(d)', 10)} AS x FROM dd), ev AS (SELECT ch, i, greatest(x - 0.5 * {_ma('x', 125)}, 0) AS e FROM e1)",
    "wfdb": f"rs AS {_robust('dd', 'd')}, e1 AS (SELECT ch, i, d, sqrt(1 + (d / z) ** 2) - 1 AS x FROM dd JOIN rs USING (ch)), ev AS (SELECT ch, i, {_ma('x', 16)} + sqrt(greatest({_ma('d * d', 6)}, 0)) AS e FROM e1)",
    "wavelet": f"e1 AS (SELECT ch, i, f, {_ma('f', 3)} AS a, {_ma('f', 6)} AS b, {_ma('f', 12)} AS c, {_ma('f', 25)} AS g FROM dd), e2 AS (SELECT ch, i, sqrt((f - a) ** 2 + 0.85 * (a - b) ** 2 + 0.6 * (b - c) ** 2 + 0.35 * (c - g) ** 2) AS x FROM e1), ev AS (SELECT ch, i, {_ma('x', 10)} AS e FROM e2)",
    "christov": f"e1 AS (SELECT ch, i, abs(d) + 0.45 * abs({_slope('d')}) AS x FROM dd), e2 AS (SELECT ch, i, {_ma('x', 5)} AS x FROM e1), ev AS (SELECT ch, i, greatest(x - 0.35 * {_ma('x', 35)}, 0) AS e FROM e2)",
}


def _r_wave_sql(algorithm: str, threshold: float = 2.0) -> str:
    base = f"WITH RECURSIVE {SIGNAL}, bs AS (SELECT ch, i, v - {_ma('v', 75)} AS f FROM s)"
    if algorithm == "simple":
        base += f", ev AS (SELECT ch, i, f AS e FROM bs), wv AS (SELECT * FROM bs), rb AS {_robust('ev', 'e')}, ag AS (SELECT i, max(abs((e - c) / z)) AS v FROM ev JOIN rb USING (ch) GROUP BY i)"
    else:
        base += f", hp AS (SELECT ch, i, f - {_ma('f', 25)} AS f FROM bs), wv AS (SELECT ch, i, {_ma('f', 4)} AS f FROM hp), dd AS (SELECT ch, i, f, {_slope('f')} AS d FROM wv), {_ENVELOPES[algorithm]}, rb AS {_robust('ev', 'e')}, ag AS (SELECT i, greatest(max((e - c) / z), 0) AS v FROM ev JOIN rb USING (ch) GROUP BY i)"
    base += ", lo AS (SELECT i, v, row_number() OVER (ORDER BY i) AS k FROM (SELECT *, lag(v) OVER (ORDER BY i) AS a, lead(v) OVER (ORDER BY i) AS b FROM ag) WHERE v >= a AND v > b)"
    if algorithm == "simple":
        base += f", pk AS (SELECT i, v FROM lo WHERE v >= {threshold})"
    else:
        share, least, low_share, low_least = cardiac.LEVELS[algorithm]
        level, floor = max(threshold * share, least), max(threshold * low_share, low_least)
        base += f""", cl AS (SELECT k, i AS fi, i AS ki, v AS kv, NULL::BIGINT AS oi, NULL::DOUBLE AS ov FROM lo WHERE k = 1 UNION ALL SELECT lo.k, CASE WHEN lo.i - fi > 20 THEN lo.i ELSE fi END, CASE WHEN lo.i - fi > 20 OR lo.v > kv THEN lo.i ELSE ki END, CASE WHEN lo.i - fi > 20 OR lo.v > kv THEN lo.v ELSE kv END, CASE WHEN lo.i - fi > 20 THEN ki END, CASE WHEN lo.i - fi > 20 THEN kv END FROM cl JOIN lo ON lo.k = cl.k + 1),
cp AS (SELECT i, v, row_number() OVER (ORDER BY i) AS k FROM (SELECT oi AS i, ov AS v FROM cl WHERE oi IS NOT NULL UNION ALL SELECT arg_max(ki, k), arg_max(kv, k) FROM cl)), lv AS (SELECT greatest({level}, quantile_cont(v, 0.85)) AS sg, greatest(0, quantile_cont(v, 0.2)) AS ns FROM cp),
ad AS (SELECT 0::BIGINT AS k, 0::BIGINT AS i, 0.0::DOUBLE AS v, false AS hit, sg, ns, greatest({floor}, least({level}, ns + 0.25 * (sg - ns))) AS lim FROM lv UNION ALL SELECT k, i, v, hit, sg, ns, greatest({floor}, ns + 0.25 * (sg - ns)) FROM (SELECT cp.k, cp.i, cp.v, cp.v >= lim AS hit, CASE WHEN cp.v >= lim THEN 0.125 * cp.v + 0.875 * sg ELSE sg END AS sg, CASE WHEN cp.v >= lim THEN ns ELSE 0.125 * cp.v + 0.875 * ns END AS ns FROM ad JOIN cp ON cp.k = ad.k + 1)), pk AS (SELECT i, v FROM ad WHERE hit)"""
    return base + """, ld AS (SELECT i, max(abs(f)) AS m FROM wv GROUP BY i), rf AS (SELECT pk.i AS p, any_value(v) AS v, arg_max(ld.i, struct_pack(m := m, n := -ld.i)) AS i FROM pk JOIN ld ON ld.i BETWEEN pk.i - 20 AND pk.i + 20 GROUP BY pk.i),
o AS (SELECT 0 AS ch, i, v, row_number() OVER (ORDER BY v DESC, p) AS k FROM rf), f AS (SELECT k, [i] AS kept, [v] AS vals FROM o WHERE k = 1 UNION ALL SELECT o.k, CASE WHEN len(list_filter(kept, lambda z: abs(z - o.i) < 75)) > 0 THEN kept ELSE list_append(kept, o.i) END, CASE WHEN len(list_filter(kept, lambda z: abs(z - o.i) < 75)) > 0 THEN vals ELSE list_append(vals, o.v) END FROM f JOIN o ON o.k = f.k + 1)
SELECT unnest(kept) AS sample_index, round(unnest(vals), 5) AS score FROM (SELECT arg_max(kept, k) AS kept, arg_max(vals, k) AS vals FROM f)"""


for _algorithm in cardiac.ALGORITHMS:
    _q(f"r_waves_{_algorithm}", lambda s, d, a=_algorithm: out(kernels.r_wave_events(traces(s, d), RATE, a), "sample_index", r("score", 5).alias("score")), _r_wave_sql(_algorithm), True)
_PULSE = dsp.butterworth("high", 40 / 60, RATE, 12) + dsp.butterworth("low", 3.0, RATE, 12)
_q(
    "bcg_periodic",
    lambda s, d: out(kernels.bcg_events(traces(s, d), RATE, "periodic"), "sample_index"),
    f"""WITH RECURSIVE {SIGNAL}, {_zero_phase(_PULSE, 40 / 60)}, r AS (SELECT i, sqrt(list_avg(list_transform(v, lambda x: x * x))) AS v FROM y2), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM r), m AS (SELECT avg(v) + 2.5 * stddev_pop(v) AS lim FROM r, q WHERE v BETWEEN q1 AND q3), p AS (SELECT i, v FROM (SELECT *, lag(v) OVER (ORDER BY i) AS a, lead(v) OVER (ORDER BY i) AS b FROM r), m WHERE v >= a AND v > b AND v > lim),
o AS (SELECT i, v, row_number() OVER (ORDER BY v DESC, i) AS k FROM p), h AS (SELECT k, [i] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.k, CASE WHEN len(list_filter(kept, lambda z: abs(z - o.i) < 50)) > 0 THEN kept ELSE list_append(kept, o.i) END FROM h JOIN o ON o.k = h.k + 1) SELECT unnest(arg_max(kept, k)) AS sample_index FROM h""",
    True,
)
_CARDIAC = dsp.butterworth("high", 0.7, RATE, 12) + dsp.butterworth("low", 10.0, RATE, 12)
_q(
    "cardiac_power",
    lambda s, d: out(kernels.cardiac_trace(traces(s, d), RATE), "sample_index", r("value").alias("value")),
    f"WITH RECURSIVE {SIGNAL}, {_zero_phase(_CARDIAC, 0.7)}, z AS (SELECT i, unnest(range(64)) AS ch, unnest(v) AS v FROM y2), w AS (SELECT ch, sqrt(avg(v * v)) AS w FROM z GROUP BY ch) SELECT i AS sample_index, round(sum(w * abs(v)) / (SELECT sum(w) FROM w), 6) AS value FROM z JOIN w USING (ch) GROUP BY i",
    True,
)
_q(
    "reduction_candidates",
    lambda s, d: out(kernels.reduction_candidates(traces(s, d), 12, 20), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("rms").alias("rms")),
    f"WITH {SIGNAL}, p AS (SELECT ch, arg_max(i, struct_pack(m := abs(v), n := -i)) AS p FROM s GROUP BY ch) SELECT ch::BIGINT AS channel_index, any_value(p) AS sample_index, round(sqrt(avg(v * v)), 6) AS rms FROM s JOIN p USING (ch) WHERE i BETWEEN p - 12 AND p + 12 GROUP BY ch ORDER BY sqrt(avg(v * v)) DESC, ch LIMIT 20",
    True,
)


@query(f"WITH {SIGNAL}, p AS (SELECT v AS x, v * 0.6 + 0.01 * (i % 5) AS y FROM s) SELECT round(var_pop(y) / var_pop(x), 6) AS variance_retained, round(corr(x, y), 6) AS r, round(sqrt(avg((x - y) ** 2)), 6) AS removed_rms, round(1 - max(abs(y)) / max(abs(x)), 6) AS peak_reduction FROM p", two=True)
def cleaning_preview(spark, d):
    before = signal(spark, d)
    after = before.withColumn("value", F.col("value") * 0.6 + 0.01 * (F.col("sample_index") % 5))
    m = kernels.cleaning_preview(to_traces(before), to_traces(after))
    return out(m, *(r(c).alias(c) for c in ("variance_retained", "r", "removed_rms", "peak_reduction")))


for _method in ("spatial", "refined"):
    _q(f"bcg_{_method}", lambda s, d, m=_method: kernels.bcg_events(traces(s, d), RATE, m))
_q(
    "template_waveform",
    lambda s, d: out(kernels.template_events(traces(s, d), 100, 32, 0.2, "waveform"), "sample_index", r("score", 5).alias("score")),
    f"""WITH RECURSIVE {SIGNAL}, tp AS (SELECT ch, i - 100 AS w, v AS t FROM s WHERE i >= 100 AND i < 132), te AS (SELECT ch, sum(t * t) AS e, avg(t) AS m, sqrt(avg(t * t)) AS r FROM tp GROUP BY ch), best AS (SELECT arg_max(ch, struct_pack(e := e, c := -ch)) AS ch FROM te), un AS (SELECT w, (t - avg(t) OVER ()) AS t FROM tp JOIN best USING (ch)), one AS (SELECT i, v - avg(v) OVER () AS v FROM s JOIN best USING (ch)),
st AS (SELECT unnest(range(0, {_N} - 31)) AS a), pj AS (SELECT a, abs(sum(v * t)) AS p FROM st JOIN one ON i >= a AND i < a + 32 JOIN un ON w = i - a GROUP BY a), lm AS (SELECT avg(p) + 1.25 * stddev_pop(p) AS lim FROM pj), lo AS (SELECT a, p, row_number() OVER (ORDER BY p DESC, a) AS k FROM (SELECT *, lag(p) OVER (ORDER BY a) AS b, lead(p) OVER (ORDER BY a) AS c FROM pj), lm WHERE p >= b AND p > c AND p >= lim),
gr AS (SELECT k, [a] AS kept FROM lo WHERE k = 1 UNION ALL SELECT lo.k, CASE WHEN len(list_filter(kept, lambda z: abs(z - lo.a) < 10)) > 0 THEN kept ELSE list_append(kept, lo.a) END FROM gr JOIN lo ON lo.k = gr.k + 1), ks AS (SELECT arg_max(kept, k) AS kept FROM gr), cs AS (SELECT unnest(CASE WHEN len(kept) >= 12 THEN kept ELSE range(0, {_N} - 31, 8) END) AS a FROM ks), fine AS (SELECT DISTINCT greatest(0, least({_N} - 32, a + d)) AS a FROM cs, (SELECT unnest(range(-4, 5)) AS d)),
rr AS (SELECT a, s.ch, corr(v, t) AS r FROM fine JOIN s ON i >= a AND i < a + 32 JOIN tp ON tp.ch = s.ch AND w = i - a GROUP BY ALL), sc AS (SELECT a, sum(rr.r * te.r) / (SELECT sum(r) FROM te) AS v FROM rr JOIN te USING (ch) GROUP BY a), p AS (SELECT a AS i, v, row_number() OVER (ORDER BY a) AS k FROM sc WHERE v >= 0.2),
f AS (SELECT k, i AS ki, v AS kv, NULL::BIGINT AS oi, NULL::DOUBLE AS ov FROM p WHERE k = 1 UNION ALL SELECT p.k, CASE WHEN p.i - ki > 16 OR p.v > kv THEN p.i ELSE ki END, CASE WHEN p.i - ki > 16 OR p.v > kv THEN p.v ELSE kv END, CASE WHEN p.i - ki > 16 THEN ki END, CASE WHEN p.i - ki > 16 THEN kv END FROM f JOIN p ON p.k = f.k + 1) SELECT oi + 16 AS sample_index, round(ov, 5) AS score FROM f WHERE oi IS NOT NULL UNION ALL SELECT arg_max(ki, k) + 16, round(arg_max(kv, k), 5) FROM f""",
    True,
)
_q(
    "template_waveform_by_blocks",
    lambda s, d: out(matched.waveform_matches(signal(s, d), 100, 32, 0.2, size=64), "sample_index", r("score", 5).alias("score")),
    f"""WITH RECURSIVE {SIGNAL}, tp AS (SELECT ch, i - 100 AS w, v AS t FROM s WHERE i >= 100 AND i < 132), te AS (SELECT ch, sum(t * t) AS e, avg(t) AS m, sqrt(avg(t * t)) AS r FROM tp GROUP BY ch), best AS (SELECT arg_max(ch, struct_pack(e := e, c := -ch)) AS ch FROM te), un AS (SELECT w, (t - avg(t) OVER ()) AS t FROM tp JOIN best USING (ch)), one AS (SELECT i, v - avg(v) OVER () AS v FROM s JOIN best USING (ch)),
st AS (SELECT unnest(range(0, {_N} - 31)) AS a), pj AS (SELECT a, abs(sum(v * t)) AS p FROM st JOIN one ON i >= a AND i < a + 32 JOIN un ON w = i - a GROUP BY a), lm AS (SELECT avg(p) + 1.25 * stddev_pop(p) AS lim FROM pj), lo AS (SELECT a, p, row_number() OVER (ORDER BY p DESC, a) AS k FROM (SELECT *, lag(p) OVER (ORDER BY a) AS b, lead(p) OVER (ORDER BY a) AS c FROM pj), lm WHERE p >= b AND p > c AND p >= lim),
gr AS (SELECT k, [a] AS kept FROM lo WHERE k = 1 UNION ALL SELECT lo.k, CASE WHEN len(list_filter(kept, lambda z: abs(z - lo.a) < 10)) > 0 THEN kept ELSE list_append(kept, lo.a) END FROM gr JOIN lo ON lo.k = gr.k + 1), ks AS (SELECT arg_max(kept, k) AS kept FROM gr), cs AS (SELECT unnest(CASE WHEN len(kept) >= 12 THEN kept ELSE range(0, {_N} - 31, 8) END) AS a FROM ks), fine AS (SELECT DISTINCT greatest(0, least({_N} - 32, a + d)) AS a FROM cs, (SELECT unnest(range(-4, 5)) AS d)),
rr AS (SELECT a, s.ch, corr(v, t) AS r FROM fine JOIN s ON i >= a AND i < a + 32 JOIN tp ON tp.ch = s.ch AND w = i - a GROUP BY ALL), sc AS (SELECT a, sum(rr.r * te.r) / (SELECT sum(r) FROM te) AS v FROM rr JOIN te USING (ch) GROUP BY a), p AS (SELECT a AS i, v, row_number() OVER (ORDER BY a) AS k FROM sc WHERE v >= 0.2),
f AS (SELECT k, i AS ki, v AS kv, NULL::BIGINT AS oi, NULL::DOUBLE AS ov FROM p WHERE k = 1 UNION ALL SELECT p.k, CASE WHEN p.i - ki > 16 OR p.v > kv THEN p.i ELSE ki END, CASE WHEN p.i - ki > 16 OR p.v > kv THEN p.v ELSE kv END, CASE WHEN p.i - ki > 16 THEN ki END, CASE WHEN p.i - ki > 16 THEN kv END FROM f JOIN p ON p.k = f.k + 1) SELECT oi + 16 AS sample_index, round(ov, 5) AS score FROM f WHERE oi IS NOT NULL UNION ALL SELECT arg_max(ki, k) + 16, round(arg_max(kv, k), 5) FROM f""",
    True,
)
for _method in ("trajectory", "wavelet"):
    _q(f"template_{_method}", lambda s, d, m=_method: kernels.template_events(traces(s, d), 100, 32, 0.2, m))
_TIMES = [0.2 * k for k in range(1, 9)]
_q(
    "cleaned_by_template",
    lambda s, d: _samples(kernels.artifact_cleaned(traces(s, d), [{"method": "template", "times": _TIMES, "width": 40}], RATE)),
    f"""WITH {SIGNAL}, n AS (SELECT max(i) + 1 AS n FROM s), st AS (SELECT k, k * 50 - 20 AS a FROM (SELECT unnest(range(1, 9)) AS k), n WHERE k * 50 + 20 <= n), w AS (SELECT ch, k, i, i - a AS rel, v FROM s JOIN st ON i >= a AND i < a + 40), e AS (SELECT *, v - (first_value(v) OVER z + (last_value(v) OVER z - first_value(v) OVER z) * rel / 39.0) AS x FROM w WINDOW z AS (PARTITION BY ch, k ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT ch, rel, avg(x) AS t FROM e GROUP BY ALL), g AS (SELECT ch, sum(t * t) AS g FROM t GROUP BY ch), p AS (SELECT ch, k, sum(x * t) AS p FROM e JOIN t USING (ch, rel) GROUP BY ALL), c AS (SELECT e.ch, e.i, p / g * t AS c FROM e JOIN t USING (ch, rel) JOIN g USING (ch) JOIN p USING (ch, k)) SELECT s.ch::BIGINT AS channel_index, s.i AS sample_index, round(v - coalesce(c, 0), 5) + 0.0 AS value FROM s LEFT JOIN c ON c.ch = s.ch AND c.i = s.i""",
    True,
)
for _method in ("obs", "ssp"):
    _q(f"cleaned_by_{_method}", lambda s, d, m=_method: to_samples(kernels.artifact_cleaned(traces(s, d), [{"method": m, "times": _TIMES, "width": 40}], RATE), "recording_id", "channel_index"))
_STARTS = list(range(30, 460, 50))
_STARTS_SQL = f"st AS (SELECT unnest({_STARTS}) AS a)"


def starts(spark):
    return spark.createDataFrame([(a,) for a in _STARTS], "start long")


def named_starts(spark, x):
    """The same starts for each recording of ``x``."""
    return starts(spark).crossJoin(F.broadcast(x.select(*ids(x)).distinct())) if ids(x) else starts(spark)  # two names


def _at_starts(f):
    def run(spark, d):
        x = signal(spark, d)
        return f(x, named_starts(spark, x))

    return run


_q("obs_variance", _at_starts(lambda x, s: subspaces.obs_variance(x, s, 40)))
_q(
    "window_variance",
    _at_starts(lambda x, s: out(subspaces.window_components(subspaces.window_grams(subspaces.event_windows(x, s, 40), 40), 40, 1), F.col("channel_index").cast("long").alias("channel_index"), r("all", 4).alias("variance"))),
    f"WITH {SIGNAL}, {_STARTS_SQL}, w AS (SELECT ch, a, i - a AS j, v FROM s JOIN st ON i >= a AND i < a + 40) SELECT ch::BIGINT AS channel_index, round(sum(q), 4) AS variance FROM (SELECT ch, j, var_pop(v) * count(*) AS q FROM w GROUP BY ALL) GROUP BY ch",
    True,
)
_q(
    "mean_map_projected_out",
    _at_starts(lambda x, s: out(subspaces.projected_out(x, _mean_map(x, s)), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value", 5).alias("value"))),
    f"WITH {SIGNAL}, {_STARTS_SQL}, m AS (SELECT ch, avg(v) AS m FROM s JOIN st ON i = a GROUP BY ch), u AS (SELECT ch, m / sqrt(sum(m * m) OVER ()) AS u FROM m), p AS (SELECT i, sum(v * u) AS p FROM s JOIN u USING (ch) GROUP BY i) SELECT s.ch::BIGINT AS channel_index, s.i AS sample_index, round(v - p * u, 5) + 0.0 AS value FROM s JOIN u USING (ch) JOIN p USING (i)",
    True,
)


def _mean_map(x, s):
    """The mean map at the starts, of unit length, as the one direction of its recording."""
    means = x.join(s.withColumnRenamed("start", "sample_index"), [*ids(x), "sample_index"]).groupBy(*ids(x), "channel_index").agg(F.avg("value").alias("m"))
    size = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*(ids(x) or [F.lit(0)]))))
    return means.select(*ids(x), F.lit(0).alias("component"), "channel_index", (F.col("m") / size).alias("weight"))


def shaped(spark, d):
    """Windows of one shape a channel, each scaled by a value of the table: decompositions of rank one with a known answer."""
    x = signal(spark, d).where("channel_index < 8")
    amplitude = x.join(named_starts(spark, x).withColumnRenamed("start", "sample_index"), [*ids(x), "sample_index"]).select(*ids(x), "channel_index", F.col("sample_index").alias("start"), F.col("value").alias("amp"))
    j = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j")
    shape = F.sin((F.col("j") + 1) * (F.col("channel_index") + 1) * 0.05)
    return amplitude.select("*", j).select(*ids(x), "channel_index", (F.col("start") + F.col("j")).alias("sample_index"), (F.col("amp") * shape).alias("value"))


@query(f"""WITH {SIGNAL}, {_STARTS_SQL}, am AS (SELECT ch, sum(v * v) AS e FROM s JOIN st ON i = a WHERE ch < 8 GROUP BY ch), sh AS (SELECT ch, j, sin((j + 1) * (ch + 1) * 0.05) AS x FROM (SELECT unnest(range(8)) AS ch), (SELECT unnest(range(40)) AS j)), n AS (SELECT ch, sum(x * x) AS n, sign(arg_max(x, abs(x))) AS sg FROM sh GROUP BY ch)
SELECT ch::BIGINT AS channel_index, j::BIGINT AS at, round(e * n, 4) AS eigenvalue, round(sg * x / sqrt(n), 5) + 0.0 AS value FROM sh JOIN n USING (ch) JOIN am USING (ch)""", two=True)
def window_shapes(spark, d):
    x = shaped(spark, d)
    found = subspaces.window_components(subspaces.window_grams(subspaces.event_windows(x, named_starts(spark, x), 40), 40), 40, 1, centred=False)
    each = found.select(*ids(found), F.col("channel_index").cast("long").alias("channel_index"), r("eigenvalue", 4).alias("eigenvalue"), F.posexplode("vector").alias("at", "v"))
    return out(each, "channel_index", F.col("at").cast("long").alias("at"), "eigenvalue", r("v", 5).alias("value"))
for _scheme in ("neighbour", "farm", "moosmann"):
    _q(f"gradient_{_scheme}", lambda s, d, m=_scheme: to_samples(kernels.gradient_corrected(traces(s, d), RATE, list(range(0, n_samples(s, d) // 25 * 25, 25)), 25, factor=4, scheme=m), "recording_id", "channel_index"))


def _positions() -> np.ndarray:
    return np.array([(x, y) for _, x, y in circle(CHANNELS)])


def _layout(spark):
    return spark.createDataFrame(circle(CHANNELS), "channel_index int, x double, y double")


@query()
def ica_components(spark, d):
    samples = written(to_samples(traces(spark, d), "recording_id", "channel_index"))
    return components.label_components(samples, components.fit_components(samples), _layout(spark), RATE)


_q("ica_cleaned", lambda s, d: to_samples(kernels.ica_cleaned(traces(s, d), RATE, _positions()), "recording_id", "channel_index"))

#: Mixtures with a known answer: over 500 samples the three sources take every combination of their levels once, so they are exactly independent.
_MIXED = {"a": ((4.0, 1.0, 0.5), (1.0, 3.0, 0.2), (0.3, 0.5, 2.0), (1.0, 1.0, 0.0)), "b": ((-1.0, 5.0, 0.1), (0.4, 0.2, 1.5), (6.0, -0.5, 0.3))}
_SOURCES_SQL = "src AS (SELECT vec_id AS i, unnest([0, 1, 2]) AS k, unnest([vec_id % 5, vec_id // 5 % 10, vec_id // 50 % 10])::DOUBLE AS s FROM embeddings), z AS (SELECT i, k, (s - avg(s) OVER (PARTITION BY k)) / stddev_samp(s) OVER (PARTITION BY k) AS z FROM src)"
_MIXING_SQL = "mix(rec, ch, k, w) AS (VALUES " + ", ".join(f"('{name}', {c}, {k}, {w!r}::DOUBLE)" for name, rows in _MIXED.items() for c, row in enumerate(rows) for k, w in enumerate(row)) + ")"
_MIXTURE_SQL = f"{_SOURCES_SQL}, {_MIXING_SQL}, x AS (SELECT rec, ch, i, x + 10 * ch AS x FROM (SELECT rec, ch, i, sum(w * s) AS x FROM src JOIN mix USING (k) GROUP BY rec, ch, i))"
_RANKS_SQL = "a AS (SELECT rec, ch, k, w * sd AS a FROM mix JOIN (SELECT k, stddev_samp(s) AS sd FROM src GROUP BY k) USING (k)), p AS (SELECT rec, k, sum(a * a) AS p, sign(arg_max(a, abs(a))) AS sg FROM a GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p DESC) - 1 AS component FROM p)"


def mixture(spark, d):
    """LONG samples of both mixtures."""
    i = F.col("vec_id")
    sources = [i % 5, F.floor(i / 5) % 10, F.floor(i / 50) % 10]
    rows = [(name, c, list(map(float, row))) for name, mixing in _MIXED.items() for c, row in enumerate(mixing)]
    weights = F.broadcast(spark.createDataFrame(rows, "recording_id string, channel_index int, w array<double>"))  # seven rows
    return table(spark, d, "embeddings").select(i.alias("sample_index"), *(x.cast("double").alias(f"s{k}") for k, x in enumerate(sources))).crossJoin(weights).select("recording_id", "channel_index", "sample_index", (sum((F.get("w", F.lit(k)) * F.col(f"s{k}") for k in range(3)), F.lit(0.0)) + 10 * F.col("channel_index")).alias("value"))


def _fitted(spark, d, method="picard"):
    x = mixture(spark, d)
    return x, components.fit_components(x, method, 0.999999, size=128)


for _method in ("picard", "fastica"):
    _q(
        f"recovered_sources_{_method}",
        lambda s, d, m=_method: components.component_sources(*_fitted(s, d, m), size=128).select("recording_id", F.col("component").cast("long").alias("component"), "sample_index", r("value", 3).alias("value")),
        f"WITH {_MIXTURE_SQL}, {_RANKS_SQL} SELECT rec AS recording_id, component::BIGINT AS component, i AS sample_index, round(z * sg, 3) + 0.0 AS value FROM o JOIN z USING (k)",
    )


@query(f"""WITH {_MIXTURE_SQL}, {_RANKS_SQL}, y AS (SELECT rec, component, i, z * sg AS y FROM o JOIN z USING (k)), st AS (SELECT rec, component, sum(y * y) AS s2, sum(y * y * y * y) AS s4, count(*) AS n FROM y GROUP BY ALL),
df AS (SELECT a.rec, a.component, sum((a.y - b.y) * (a.y - b.y)) AS d2 FROM y a JOIN y b ON b.rec = a.rec AND b.component = a.component AND b.i = a.i - 1 GROUP BY ALL), lg AS (SELECT rec, component, max(c) AS c FROM (SELECT a.rec, a.component, l, sum(a.y * b.y) AS c FROM y a, (SELECT unnest([125, 150, 175, 200, 225, 250, 275, 300]) AS l) JOIN y b ON b.rec = a.rec AND b.component = a.component AND b.i = a.i - l GROUP BY ALL) GROUP BY ALL),
ln AS (SELECT rec, component, max(q) AS q FROM (SELECT rec, component, f, pow(sum(y * cos(2 * pi() * f / 250 * i)), 2) + pow(sum(y * sin(2 * pi() * f / 250 * i)), 2) AS q FROM y, (SELECT unnest([50.0, 60.0]) AS f) GROUP BY ALL) GROUP BY ALL), tt AS (SELECT *, d2 / (4 * s2) AS rough, greatest(n * s4 / (s2 * s2) - 3, 0) AS ku FROM st JOIN df USING (rec, component) JOIN lg USING (rec, component) JOIN ln USING (rec, component))
SELECT rec AS recording_id, component::BIGINT AS component, round(exp(-60 * rough), 4) AS slow, round(least(2 * rough, 1), 4) AS fast, round(ku / (ku + 6), 4) + 0.0 AS spiky, round(least(2 * q / (n * s2), 1), 4) + 0.0 AS line, round(least(greatest(c / s2, 0), 1) * ku / (ku + 6), 4) + 0.0 AS pulses FROM tt""")
def component_traits(spark, d):
    x, models = _fitted(spark, d)
    traits = components.source_traits(components.source_sums(x, models, RATE, size=128))
    return traits.select("recording_id", F.col("component").cast("long").alias("component"), *(r(c, 4).alias(c) for c in ("slow", "fast", "spiky", "line", "pulses")))


@query(f"WITH {_MIXTURE_SQL}, {_RANKS_SQL}, gone AS (SELECT o.rec, ch, i, a.a * z.z AS v FROM o JOIN a ON a.rec = o.rec AND a.k = o.k JOIN z ON z.k = o.k WHERE component = 1) SELECT x.rec AS recording_id, x.ch::BIGINT AS channel_index, x.i AS sample_index, round(x.x - gone.v, 3) + 0.0 AS value FROM x JOIN gone ON gone.rec = x.rec AND gone.ch = x.ch AND gone.i = x.i")
def component_removed(spark, d):
    x, models = _fitted(spark, d)
    left = components.without_components(x, models, models.where("component = 1"), size=128)
    return left.select("recording_id", F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value", 3).alias("value"))


_DOME = [(k, x, y, max(0.0, 1 - x * x - y * y) ** 0.5) for k, x, y in circle(CHANNELS)]
_GOOD = [g for g in _DOME if g[0] not in (3, 10)]


def _weight_rows() -> str:
    """The spline weights (a sensor table, computed once) as SQL values."""
    rows = []
    for target in (3, 10):
        w = dsp.spline_weights(np.array([g[1:] for g in _GOOD]), np.array(_DOME[target][1:]))
        rows += [f"({target}, {g[0]}, {float(v)!r}::DOUBLE)" for g, v in zip(_GOOD, w, strict=True)]
    return ", ".join(rows)


@query(f"WITH {SIGNAL}, wt AS (SELECT * FROM (VALUES {_weight_rows()}) t(target, ch, w)) SELECT target::BIGINT AS channel_index, i AS sample_index, round(sum(w * v), 6) + 0.0 AS value FROM s JOIN wt USING (ch) GROUP BY ALL", two=True)
def interpolated_channels(spark, d):
    found = kernels.interpolated_channels(signal(spark, d), _DOME, [3, 10])
    return out(found, F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value").alias("value"))


@query(f"WITH RECURSIVE {SIGNAL}, {_zero_phase(_BAND, 1.0)}, z AS (SELECT i, list_transform(v, lambda x: x - (list_sum(v) - v[4]) / 63) AS v FROM y4) {_FLAT.format(v='v', t='z')}", two=True)
def replayed_script(spark, d):
    steps = Pipeline().add("filter", highPassHz=1, lowPassHz=40).add("segment", replayable=False).add("reference", bad="3")
    return _samples(Pipeline.from_xml(steps.to_xml()).run(traces(spark, d), RATE))


#: Half-second segments that aren't poor, and in each its two windows of 64 samples.
_KEPT = f"kept AS (SELECT start_sample AS a FROM ({SEGMENT_HEALTH_SQL.replace('i // 63', 'i // 125')}) WHERE grade <> 'poor'), wins AS (SELECT a + o AS a FROM kept, (SELECT unnest([0, 32]) AS o))"


@query(_result_sql(_spectra_sql(_KEPT, 64).replace("250.0 / 256", "250.0 / 64")).replace("bin * 250.0 / 256", "bin * 250.0 / 64"), two=True)
def resting_analysis(spark, d):
    from voltlake.plans.resting import resting_analysis as analyse

    return _result_table(analyse(signal(spark, d), RATE, n_samples(spark, d), CHANNELS, 0.5)["rows"])


@query(
    f"WITH {SIGNAL} SELECT ch::BIGINT AS channel_index, i AS sample_index, round(v::FLOAT::DOUBLE, 5) + 0.0 AS value FROM s WHERE ch IN (3, 10) AND i >= 128 AND i < 320",
    two=True,
)
def packages_by_blocks(spark, d):
    """Recordings written as packages, and two channels of three blocks read back."""
    samples, folder = signal(spark, d), new_folder(spark)
    packages.write_packages(samples, folder, RATE, block=64)
    wanted = packages.read_blocks(spark, folder, blocks=1).where(F.col("channel_index").isin(3, 10) & (F.col("first_sample") >= 128) & (F.col("first_sample") < 320))
    named = packages.block_samples(wanted).withColumn("recording_id", F.regexp_extract("recording_id", r"([^/]+)\.mff$", 1))
    return out(named, F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value", 5).alias("value"))


def _by_precision(spark, d):
    """Four filters on both sides of the limits: a slow one, a steep slow one, one near half the rate, and a plain one; channels 16 of each."""
    t = traces(spark, d)
    settings = ({"high": 0.0120}, {"high": 0.03, "slope": 48}, {"low": 123.0, "slope": 12}, {"high": 10.0, "low": 40.0})
    parts = [kernels.filtered_by_precision(t.where(F.col("channel_index") % 4 == k), RATE, **options) for k, options in enumerate(settings)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


_q(
    "filter_precisions",
    lambda s, d: out(_by_precision(s, d), F.col("channel_index").cast("long").alias("channel_index"), "precision"),
    f"WITH {SIGNAL} SELECT DISTINCT ch::BIGINT AS channel_index, CASE ch % 4 WHEN 0 THEN CASE WHEN 0.0120 / 250.0 < 0.00005 THEN 'double' ELSE 'single' END WHEN 1 THEN CASE WHEN 0.03 / 250.0 < 0.0002 THEN 'double' ELSE 'single' END WHEN 2 THEN CASE WHEN (125.0 - 123.0) / 125.0 < 0.02 THEN 'double' ELSE 'single' END ELSE 'single' END AS precision FROM s",
    True,
)
_q(
    "filtered_in_single_precision",
    lambda s, d: out(to_samples(kernels.filtered_by_precision(traces(s, d), RATE, high=10.0, low=40.0, notch=60.0).drop("precision")), F.col("channel_index").cast("long").alias("channel_index"), "sample_index", r("value", 2).alias("value")),
    f"WITH RECURSIVE {SIGNAL}, {_zero_phase([*_LOWER, dsp.biquad('notch', 60.0, RATE, dsp.NOTCH_Q)], 10.0)} {_FLAT.format(v='v', t='y5').replace('5) + 0.0', '2) + 0.0')}",
    True,
)
