"""What the findings of round 3 were about."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import long
from voltlake.functions import cardiac, ica, templates
from voltlake.operators import blocks, components, kernels, layout, matched, sets, stats, windows


@pytest.mark.parametrize("factor", [2, 3, 4])
def test_upsampled_by_centres(spark, factor):
    values = [3.0, -1.0, 4.0, 4.0, 10.0]
    n = 5 * factor - 1
    samples = spark.createDataFrame([(c, i, v * (c + 1)) for c in range(2) for i, v in enumerate(values)], "channel_index int, sample_index long, value double")
    found = layout.linear_upsample(samples, factor, n)
    wanted = np.interp((np.arange(n) - (factor - 1) / 2) / factor, np.arange(5), values)
    for c in range(2):
        assert [r.value for r in found.where(F.col("channel_index") == c).orderBy("sample_index").collect()] == pytest.approx((wanted * (c + 1)).tolist())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # samples are made after the joins, not joined


def test_steps_over_block_edges(spark):
    rows = [(r, 3 * k, float((k * k) % 11)) for r in ("a", "b") for k in range(40)]
    motion = spark.createDataFrame(rows, "recording_id string, volume long, d_s double").select("*", *(F.lit(0.0).alias(c) for c in ("roll", "pitch", "yaw", "d_l", "d_p")))
    found = windows.framewise_displacement(motion, size=10)
    assert "__block" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.recording_id, r.volume): r.fd for r in found.collect()}
    assert got == {(r, v): 0.0 if v == 0 else abs(x - float(((v // 3 - 1) ** 2) % 11)) for r, v, x in rows}


def test_channels_meet_without_a_join(spark):
    a, b = (spark.range(1000).select((F.col("id") % 7 + k).alias("channel_index")) for k in (0, 3))
    found = sets.channel_intersection(a, b)
    assert sorted(r.channel_index for r in found.collect()) == [3, 4, 5, 6]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    some = spark.createDataFrame([(None,), (1,)], "channel_index long")
    assert sets.channel_intersection(some, some).count() == 2


def test_levels_of_all_samples():
    x = np.zeros(80_000)
    x[1::4] = 8.0  # one in four, none at the places that a stride of four looks at
    assert cardiac.robust_level(x)[1] > 1


def test_median_of_positive_values_is_stated_in_sql(spark):
    import duckdb
    from voltlake.plans.queries import ORACLE_SQL

    rows = [(k, 1, f"2024-01-0{k + 1}", v) for k, v in enumerate((0.0, 0.0, 0.0, 2.0, 6.0))]
    frame = spark.createDataFrame([(1, r[3]) for r in rows], "ch int, value double")
    c = duckdb.connect()
    c.execute("CREATE TABLE events(event_id BIGINT, user_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", rows)
    assert frame.agg(stats.median_interpolated(F.col("value"))).first()[0] == c.execute(f"SELECT interpolated FROM ({ORACLE_SQL['median_rules']})").fetchall()[0][0] == 4.0


def test_template_scores_window_by_window(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, 400))
    template, starts = x[:, 100:132], np.arange(0, 360)
    whole = templates.waveform_scores(x, template, starts)
    views = np.lib.stride_tricks.sliding_window_view(x, 32, 1)[:, starts]
    weight = np.sqrt((template**2).mean(1))
    assert whole == pytest.approx(weight / weight.sum() @ np.einsum("csw,cw->cs", templates.unit(views), templates.unit(template)))
    most = []
    real = templates.unit
    monkeypatch.setattr(templates, "WINDOWS", 16)
    monkeypatch.setattr(templates, "unit", lambda v: (most.append(v.size), real(v))[1])
    assert templates.waveform_scores(x, template, starts) == pytest.approx(whole)
    assert templates.wavelet_matches(x, template, 0.2)
    assert max(most) <= 3 * 5 * 32 * 16  # never all windows of a recording at once


def test_spaced_is_best_first():
    order = np.random.default_rng(1).permutation(500)
    kept = []
    for a in order.tolist():
        if all(abs(a - k) >= 7 for k in kept):
            kept.append(a)
    assert templates.spaced(order, 7) == kept


def test_rounds_of_a_fit_read_bytes(spark):
    x = np.random.default_rng(2).standard_normal((3, 1_000))
    x[1, 7] = np.nan
    df = long(spark, dict(enumerate(x))).unionByName(long(spark, {0: np.full(200, np.nan)}, "b"))
    pieces = components.fit_pieces(components.recording_blocks(df, 256), 100).cache()
    assert dict(pieces.dtypes)["data"] == "binary"  # no arrays of arrays, which every round would rebuild value by value
    assert pieces.agg(F.max(F.length("data"))).first()[0] == 3 * 100 * 8
    assert pieces.where("recording_id = 'b'").count() == 1  # one block without finite samples
    w, z = ica._start(3), x[:, np.isfinite(x).all(0)]
    found = components.summed(pieces, lambda name, channels, part: ica.moment_sums(w, part))
    assert list(found) == ["a"] and found["a"] == pytest.approx(ica.moment_sums(w, z))


def test_blocks_of_recordings_without_id(spark):
    df = long(spark, {0: np.arange(50.0)}).withColumn("recording_id", F.lit(None).cast("string"))
    for halo in (0, 3):
        assert blocks.halo_blocks(df, 20, halo, halo).count() == 3
    assert "Join" not in blocks.halo_blocks(df, 20, 0, 0)._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_taken_once_for_removal(spark, monkeypatch):
    x = np.random.default_rng(3).laplace(size=(3, 600)).cumsum(1)
    traces = layout.to_traces(long(spark, dict(enumerate(x))))
    real, plans = components.without_components, []
    monkeypatch.setattr(components, "without_components", lambda s, m, chosen, **o: (plans.append(chosen._jdf.queryExecution().optimizedPlan().toString()), real(s, m, chosen, **o))[1])
    found = kernels.ica_cleaned(traces, 250.0, np.array([(0.1, 0.2), (0.5, -0.4), (-0.3, 0.6)]), ("Brain", "Eye", "Other"))
    assert found.count() == 3 and "MapInArrow" not in plans[0]


def test_wavelet_template_over_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3, 2_000))
    for s in range(60, 1_900, 130):
        x[:, s : s + 32] += 4 * np.hanning(32) * np.array([[1.0], [-2.0], [0.5]])
    want = templates.wavelet_matches(x, x[:, 60:92], 0.4)
    assert len(want) > 5
    df = long(spark, dict(enumerate(x)))
    found = matched.wavelet_matches(df, 60, 32, 0.4, size=256).orderBy("sample_index").collect()
    assert [r.sample_index for r in found] == [w[0] for w in want] and np.allclose([r.score for r in found], [w[1] for w in want])
    longer = layout.to_traces(df).withColumn("recording_id", F.lit(None).cast("string")).withColumn("values", F.when(F.col("channel_index") == 1, F.concat("values", F.array(F.lit(9.0), F.lit(9.0)))).otherwise(F.col("values")))
    events = kernels.template_events(longer, 60, 32, 0.4, "wavelet")
    assert "FlatMapGroupsInPandas" not in events._jdf.queryExecution().optimizedPlan().toString()  # no recording in one task
    rows = events.orderBy("sample_index").collect()
    assert {r.recording_id for r in rows} == {None} and np.allclose([(r.sample_index, r.score) for r in rows], want)


@pytest.mark.parametrize("name", ["r_waves_christov_two_recordings", "r_waves_hamilton", "r_waves_hamilton_two_recordings", "r_waves_pan_tompkins", "r_waves_pan_tompkins_two_recordings", "r_waves_simple", "r_waves_simple_two_recordings", "r_waves_wavelet", "r_waves_wavelet_two_recordings", "r_waves_wfdb"])
def test_long_r_waves_as_their_sql(name):
    import duckdb
    from voltlake.plans.queries import ORACLE_SQL

    rng = np.random.default_rng(5)
    x = np.cumsum(rng.standard_normal((2, 41_000)), 1) * 0.02 + rng.standard_normal((2, 41_000)) * 0.1
    x[:, 100::190] += 3 + rng.standard_normal((2, len(range(100, 41_000, 190))))
    x = x.astype(np.float32)
    c = duckdb.connect()
    c.register("rows", pa.table({"vec_id": np.arange(41_000), "embedding": pa.array(x.T.tolist(), pa.list_(pa.float32()))}))
    c.execute("CREATE TABLE embeddings AS SELECT * FROM rows")
    wanted = {tuple(r) for r in c.execute(ORACLE_SQL[name]).fetchall()}
    x = x.astype(float)
    algorithm = name.removeprefix("r_waves_").removesuffix("_two_recordings")
    if name.endswith("_two_recordings"):
        other = x * 1.5 + (63 - np.arange(2))[:, None] * 0.01
        found = {(k, p, round(s, 5)) for k, y in (("a", x), ("b", other)) for p, s in cardiac.r_waves(y, 250.0, algorithm)}
    else:
        found = {(p, round(s, 5)) for p, s in cardiac.r_waves(x, 250.0, algorithm)}
    assert found == wanted and len(found) > 50


@pytest.mark.parametrize("name", ["baseline_corrected_average_two_recordings", "preview_average", "preview_average_two_recordings", "template_regression", "template_regression_two_recordings", "measurement_error_two_recordings"])
def test_events_of_one_window_are_counted_first(spark, tmp_path, name):
    from voltlake.plans.queries import QUERIES

    rng = np.random.default_rng(2)
    vectors = pa.table({"vec_id": np.arange(400), "embedding": pa.array(rng.standard_normal((400, 64)).tolist(), pa.list_(pa.float32()))})
    at = np.datetime64("2024-01-01", "us") + np.arange(300) * np.timedelta64(700_000, "us")
    for copies in (1, 3):
        events = pa.table({"event_id": np.arange(300 * copies), "ts": np.tile(at, copies), "user_id": np.arange(300 * copies), "event_type": ["x", "y"] * 150 * copies, "value": np.ones(300 * copies)})
        (tmp_path / str(copies)).mkdir()
        pq.write_table(events, tmp_path / str(copies) / "events.parquet")
        pq.write_table(vectors, tmp_path / str(copies) / "embeddings.parquet")
    one, three = (QUERIES[name](spark, str(tmp_path / k)) for k in "13")
    plan = one._jdf.queryExecution().analyzed().toString()
    assert "times#" in plan[plan.index("explode(sequence(") :]  # windows with their number of trials, not trials, are spread to samples
    if "regression" in name:
        assert "event_id" not in plan and three.count() == 3 * one.count() > 0
    elif "error" not in name:
        assert sorted(map(str, one.collect())) == sorted(map(str, three.collect())) != []
