"""Operators on small tables with values worked out by hand, readers and streams on Spark."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.functions import formats
from voltlake.functions import scoring as sc
from voltlake.operators import correct, detect, epochs, health, joins, select, sets, stats, topk, windows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def long(spark, channels):
    return spark.createDataFrame([(c, i, float(v)) for c, x in enumerate(channels) for i, v in enumerate(x)], "channel_index int, sample_index long, value double")


def test_scores(spark):
    df = spark.createDataFrame([(4.0,), (float("nan"),), (None,), (1.0,)], "v double")
    got = [r[0] for r in df.select(sc.score_upper_ratio(F.col("v"), 2, 6)).collect()]
    assert got == [0.5, 0.0, 0.0, 1.0]
    assert [r[0] for r in spark.createDataFrame([(0.78,), (0.5,), (0.1,)], "s double").select(sc.grade(F.col("s"))).collect()] == ["good", "watch", "poor"]
    v = spark.createDataFrame([("5.4.1.2 (r2)",), ("5.1",), ("6",), (None,)], "v string").select(sc.version_at_least(F.col("v"), 5, 2)).collect()
    assert [r[0] for r in v] == [True, False, True, False]
    assert spark.range(1).select(sc.downsample_factor(1000, 250), sc.format_microvolts(F.lit(123.4))).first()[:] == (4, "123 µV")


def test_framewise_displacement(spark):
    m = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0)], "volume int, roll double, pitch double, yaw double, d_s double, d_l double, d_p double")
    fd = windows.framewise_displacement(m)
    assert [r.fd for r in fd.orderBy("volume").collect()] == pytest.approx([0, math.pi / 180 * 50, 2])
    assert rows(select.volumes_exceeding(fd, 1.0), "volume") == [(2,)] and rows(select.volumes_exceeding(fd, 0.5), "volume") == [(1,), (2,)]


def test_differences_reset_or_carry(spark):
    s = long(spark, [[1, float("nan"), 4, 6]])
    assert [r.diff for r in windows.first_difference(s, True).orderBy("sample_index").collect()] == [None, None, 3.0, 2.0]
    assert [r.diff for r in windows.first_difference(s, False).orderBy("sample_index").collect()] == [None, None, None, 2.0]


def test_clipping_and_degenerate_statistics(spark):
    s = long(spark, [[100] * 4 + [1, 2, 3, 4], [10] * 8, [50, 50, 50]])
    assert rows(stats.clipping_fraction(s, "value", "channel_index"), "channel_index", "clipping") == [(0, 0.5), (1, 0.0), (2, 0.0)]
    one = s.where("channel_index = 1").groupBy("channel_index").agg(stats.excess_kurtosis(F.col("value")), stats.pearson(F.col("value"), F.col("value")), stats.variance_sample(F.col("value"))).first()
    assert one[1:] == (0.0, 0.0, 0.0)


def test_overlap_counts_each_pair_once(spark):
    seg = spark.createDataFrame([(0, 0, 4999), (1, 5000, 9999), (2, 20000, 20001)], "segment_id int, start_sample long, end_sample long")
    art = spark.createDataFrame([(0, 100, 7000), (1, 4990, 5005), (2, 0, 9999)], "artifact_id int, start_sample long, end_sample long")
    assert rows(joins.artifact_overlap(seg, art), "segment_id", "overlap_samples", "n_intervals") == [(0, 5000, 3), (1, 5000, 3), (2, 0, 0)]
    assert rows(select.without_artifacts(seg, art), "segment_id") == [(2,)]


def test_greedy_picks(spark):
    c = spark.createDataFrame([(0, 1, 0.5), (0, 3, 0.9), (0, 7, 0.95), (0, 30, 0.4)], "k int, start long, score double")
    assert rows(topk.merge_nearby(c, 5, "k"), "start") == [(7,), (30,)]
    assert rows(topk.strongest_non_overlapping(c, 5, "k"), "start") == [(1,), (7,), (30,)]
    assert rows(topk.clustered_peaks(c, 5, "k"), "start") == [(3,), (7,), (30,)]
    s = long(spark, [[0] * 40 + [10, 0, 0, 0, 0, 12] + [0] * 34 + [9] + [0] * 30])
    assert rows(topk.find_peaks(s, 1.0, 20, "channel_index"), "start") == [(45,), (80,)]


def test_split_and_lock(spark):
    e = spark.createDataFrame([("A", 0.1, 1.0), ("B", 0.5, None), ("C", 0.9, 0.05)], "code string, begin_s double, duration_s double")
    assert rows(select.split_events(e, 0.0, 0.5), "code", "begin_s", "duration_s") == [("A", 0.1, 0.4)]
    assert [(c, pytest.approx(t)) for c, t in rows(select.split_events(e, 0.5, 1.0), "code", "begin_s")] == [("B", 0.0), ("C", 0.4)]
    q = spark.createDataFrame([(0.1,), (1.0,), (5.0,), (9.95,)], "begin_s double")
    assert [r[0] for r in rows(detect.locked_events(q, 0.3, 10.0), "begin_s")] == pytest.approx([0.4, 1.3, 5.3])
    left, right = select.split_samples(long(spark, [range(10)]), 0, 10)
    assert (left.count(), right.count()) == (1, 9)


def test_combine(spark):
    files = spark.createDataFrame([("a", 0, 100, 2), ("b", 1, 60, 3)], "file_id string, file_order int, n_samples long, n_channels int")
    s = spark.createDataFrame([("a", 0, 99, 1.0), ("b", 0, 0, 2.0), ("b", 2, 0, 9.0)], "file_id string, channel_index int, sample_index long, value double")
    seg = spark.createDataFrame([("a", 30, 79), ("b", 30, 59)], "file_id string, start_sample long, end_sample long")
    joined, moved = sets.append_recordings(s, seg, files)
    assert rows(joined, "sample_index", "value") == [(99, 1.0), (100, 2.0)] and rows(moved, "start_sample") == [(30,), (130,)]
    avg = spark.createDataFrame([("c", 0, 0, 1.0, 1, 0), ("c", 0, 0, 3.0, 1, 1), ("c", 1, 0, 2.0, 1, 0), ("c", 1, 0, 6.0, 1, 1)], "category string, channel_index int, rel int, value double, n_trials int, file_order int")
    assert rows(epochs.grand_average(avg, "equalPerFile"), "channel_index", "value", "n_trials") == [(0, 2.0, 2), (1, 4.0, 2)]
    assert epochs.residual_noise_curve(avg).first().noise == pytest.approx(math.sqrt((1 + 4) / 2))
    w = spark.createDataFrame([(2.0, None, 5), (None, None, 0)], "n double, b double, t int").select(epochs.inverse_variance_weight(F.col("n"), F.col("b"), F.col("t"))).collect()
    assert [r[0] for r in w] == [0.25, 1.0]


def test_fuzzy_categories_first_seen_first(spark):
    names = spark.createDataFrame([(0, "Target"), (1, "target"), (2, "Targets"), (3, "Tgt")], "order_no int, name string")
    assert rows(joins.fuzzy_clusters(names), "name", "cluster") == [("Target", "target"), ("Targets", "target"), ("Tgt", "tgt"), ("target", "target")]


def test_coordinates_fall_back_to_position(spark):
    ch = spark.createDataFrame([(0, "E1-REF"), (1, "E 2")], "channel_index int, channel_name string")
    s = spark.createDataFrame([(0, "e1", 1.0, 0.0, 0.0), (1, "E2", 0.0, 1.0, 0.0)], "sensor_index int, label string, x double, y double, z double")
    assert rows(joins.matched_coordinates(ch, s), "channel_index", "x") == [(0, 1.0), (1, 0.0)]
    assert rows(joins.matched_coordinates(ch, s.withColumn("label", F.concat(F.lit("q"), "label"))), "channel_index", "x") == [(0, 1.0), (1, 0.0)]


def test_ocular_blink(spark):
    x = [5.0] * 300
    x[100:130] = [200.0] * 30
    found = detect.ocular_events(long(spark, [x, [5.0] * 300]), (0, 1), 250.0, rise_s=None)
    assert rows(found, "start_sample", "end_sample", "peak") == [(100, 129, 200.0)]


def test_gradient_template_leaves_physiology(spark):
    n, spacing = 20, 100
    rng = np.random.default_rng(0)
    brain, template = rng.standard_normal(n * spacing), 50 * np.sin(2 * np.pi * 3 * np.arange(spacing) / spacing)
    s = long(spark, [brain + np.tile(template, n)])
    y = np.array([r.value for r in correct.gradient_removed(s, 0, spacing, n).orderBy("sample_index").collect()])
    assert ((y - brain) ** 2).mean() < 0.2 * (template**2).mean()


def test_segment_health_flags_a_burst(spark):
    rng = np.random.default_rng(1)
    x = [20 * np.sin(2 * np.pi * 10 * np.arange(2000) / 250) + rng.standard_normal(2000) for _ in range(4)]
    for c in x:
        c[500:1000] += 4000
    h = health.segment_health(long(spark, x), 500, 2000, 4, 250.0)
    scores = {r.segment_id: r.score for r in h.collect()}
    assert scores[1] < min(scores[0], scores[2], scores[3])


def test_snr_needs_trials(spark):
    t = spark.createDataFrame([("a", 0, 0, r, float(r)) for r in range(4)], "category string, trial int, channel_index int, rel int, value double")
    m = epochs.snr_metrics(t, 2).first()
    assert m.trial_count == 1 and m.plus_minus_noise is None and m.split_half is None and m.baseline_noise == pytest.approx(math.sqrt(0.5))
    many = spark.createDataFrame([("a", k, 0, r, float(r + k % 2)) for k in range(8) for r in range(4)], "category string, trial int, channel_index int, rel int, value double")
    assert epochs.measurement_error(many, 2).first().sme > 0


def test_readers_on_spark(spark, tmp_path):
    from voltlake.sinks.writers import package_files, write_package
    from voltlake.sources import readers

    x = np.arange(24, dtype=float).reshape(2, 12)
    write_package(str(tmp_path / "in" / "one.mff"), x, 100, events=[{"code": "s", "begin_s": 0.02}])
    (tmp_path / "in" / "bad.edf").write_bytes(b"short")
    t = readers.read_traces(spark, str(tmp_path / "in"))
    good, bad = t.where("error IS NULL").collect(), t.where("error IS NOT NULL").collect()
    assert len(good) == 2 and len(bad) == 1 and sorted(sum((list(r["values"]) for r in good), [])) == x.ravel().tolist()
    assert rows(readers.read_events(spark, str(tmp_path / "in")), "code") == [("s",)]
    assert readers.read_package_values(spark, str(tmp_path / "in")).count() > 3
    files = {r.file: bytes(r.content) for r in package_files(t.where("error IS NULL"), 100.0).collect()}
    assert (formats.package(files)["data"] == x).all()
    (tmp_path / "m.1D").write_text("# x\n1 2 3 4 5 6\n0 1 2 3 4 5 6 7 8\n1 2\n")
    m = readers.read_motion(spark, str(tmp_path / "m.1D")).orderBy("volume").collect()
    assert [r.roll for r in m] == [1.0, 1.0, None] and m[2].error
    (tmp_path / "n.json").write_text('{"A": [1.0, 2.0]}')
    assert readers.read_noise(spark, str(tmp_path / "n.json")).first().curve == [1.0, 2.0]


def test_streams_equal_batches(spark, tmp_path):
    from voltlake.streaming import live

    t = pd.date_range("2024-01-01", periods=400, freq="10ms")
    v = np.abs(np.sin(np.arange(400) / 8)) ** 9
    spark.createDataFrame(pd.DataFrame({"ts": t, "channel_index": np.zeros(400, int), "value": v})).coalesce(1).write.parquet(str(tmp_path / "s"))
    batch = spark.read.parquet(str(tmp_path / "s"))
    for k, f in enumerate((live.segment_statistics, live.sliding_statistics, lambda s: live.burst_sessions(s, 0.5), live.adaptive_peaks)):
        stream = f(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "s")))
        mode = "append" if k == 3 else "complete" if k < 2 else "append"
        q = stream.writeStream.outputMode(mode).format("memory").queryName(f"live{k}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.sql(f"SELECT * FROM live{k}")
        if k < 2:
            assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))
        elif k == 3:
            assert 8 <= got.count() <= 17


def test_causal_streams_equal_one_pass(spark, tmp_path):
    from voltlake.functions import dsp
    from voltlake.streaming import live

    rng = np.random.default_rng(2)
    t = pd.date_range("2024-01-01", periods=300, freq="10ms")
    parts = [pd.DataFrame({"recording_id": r, "ts": t, "channel_index": c, "value": rng.standard_normal(300), "reference": rng.standard_normal(300)}) for r in ("a", "b") for c in (0, 1)]
    for k in range(3):
        cut = pd.concat([p.iloc[k * 100 : (k + 1) * 100] for p in parts])
        spark.createDataFrame(cut).coalesce(1).write.parquet(str(tmp_path / "s" / f"{k}"))
    schema = spark.read.parquet(str(tmp_path / "s" / "0")).schema
    sections = [dsp.biquad("low", 10, 100, 0.7), dsp.biquad("high", 1, 100, 0.7)]
    for name, f in (("causal", lambda s: live.causal_filter(s.drop("reference"), sections)), ("adaptive", lambda s: live.adaptive_cancelling(s, 4, 0.01))):
        stream = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s" / "*")))
        stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(180)
        got = spark.sql(f"SELECT * FROM {name}").toPandas()
        assert len(got) == 1200
        for p in parts:
            mine = got[(got.recording_id == p.recording_id.iloc[0]) & (got.channel_index == p.channel_index.iloc[0])].sort_values("t")["value"].to_numpy()
            if name == "causal":
                want = p["value"].to_numpy()
                for b, a in sections:
                    want = dsp._recursive(b, a, want)
            else:
                want = p["value"].to_numpy() - dsp.lms(p["reference"].to_numpy(), p["value"].to_numpy(), 4, 0.01)
            assert np.allclose(mine, want)


def test_sql_functions(spark):
    from voltlake.functions import dsp, udfs

    assert "band_pass" in udfs.register(spark)
    x = np.sin(np.arange(400) / 3) + 2
    spark.createDataFrame([(0, x.tolist()), (1, None)], "channel_index int, values array<double>").createOrReplaceTempView("udf_traces")
    got = {r.channel_index: r.y for r in spark.sql("SELECT channel_index, band_pass(values, 250.0, 1.0, 40.0) AS y FROM udf_traces").collect()}
    assert np.allclose(got[0], dsp.band_pass(x, 250.0, high=1.0, low=40.0)) and got[1] is None
    assert spark.sql("SELECT wavelet_reduced(values) AS y, r_wave_samples(values, 250.0) AS b FROM udf_traces").count() == 2


def test_package_round_trip_with_companions(spark, tmp_path):
    from voltlake.sinks import writers
    from voltlake.sources import readers

    rng = np.random.default_rng(3)
    x, pns = rng.standard_normal((3, 40)).astype("f4").astype(float), rng.standard_normal((2, 40)).astype("f4").astype(float)
    gains = lambda kind: f"<calibration><beginTime>0</beginTime><type>{kind}</type><channels><ch n='1'>2.0</ch></channels></calibration>"
    sensors = "".join(f"<sensor><name>E{k}</name><number>{k}</number><type>{int(k == 3)}</type><x>{k}</x><y>0</y></sensor>" for k in (1, 2, 3))
    source = {"info.xml": b"<fileInfo><recordTime>2020-05-01T10:00:00.000000+00:00</recordTime><note>kept</note></fileInfo>", "info1.xml": f"<dataInfo><generalInformation><fileDataType><EEG><sensorLayoutName>net</sensorLayoutName></EEG></fileDataType></generalInformation><calibrations>{gains('GCAL')}{gains('ICAL')}</calibrations></dataInfo>".encode(), "sensorLayout.xml": f"<sensorLayout><sensors>{sensors}</sensors></sensorLayout>".encode(), "subject.xml": b"<patient/>", "montage1.xml": b"<m/>", "signal1.bin": b"old"}
    files = formats.write_package(x, 100, [{"category": "c", "start_sample": 0, "end_sample": 19}, {"category": "d", "start_sample": 20, "end_sample": 39}], pns=pns, pns_names=["ECG"], source=source)
    eeg, other = formats.package(files), formats.package(files, "pns")
    assert (eeg["data"] == x).all() and (other["data"] == pns).all() and other["names"] == ["ECG", "PNS 2"] and len(eeg["segments"]) == 2
    assert b"GCAL" not in files["info1.xml"] and eeg["impedance"][0] == 2.0 and files["info.xml"] == source["info.xml"] and files["subject.xml"] == b"<patient/>" and "montage1.xml" in files
    assert "sensorLayout.xml" in files and "sensorLayout.xml" not in formats.write_package(x[:2], 100, source=source)
    with pytest.raises(formats.FormatError):
        formats.write_package(x, 100, pns=pns[:, :5])

    writers.write_package(str(tmp_path / "in" / "one.mff"), x, 100, events=[{"code": "s", "begin_s": 0.02, "duration_s": 0.1}], pns=pns, pns_names=["ECG", "Resp"], source=source)
    found = readers.read_traces(spark, str(tmp_path / "in"), "pns")
    assert rows(found, "channel_index", "channel_name") == [(0, "ECG"), (1, "Resp")]
    assert [r.duration_s for r in readers.read_events(spark, str(tmp_path / "in")).collect()] == [0.1]
    again = writers.package_files(readers.read_traces(spark, str(tmp_path / "in")), 100.0, pns=found, events=readers.read_events(spark, str(tmp_path / "in")), source=readers.recording_files(spark, str(tmp_path / "in")))
    assert writers.write_files(again, str(tmp_path / "out")).count() >= 7
    back = readers.read_traces(spark, str(tmp_path / "out"), "pns").orderBy("channel_index").collect()
    assert (np.array([r["values"] for r in back]) == pns).all() and [r.channel_name for r in back] == ["ECG", "Resp"]
    (tmp_path / "in" / "one.mff" / "subject.xml").write_bytes(b"<broken")
    assert readers.read_package_values(spark, str(tmp_path / "in")).where("error IS NOT NULL").count() == 1


def test_snapshots_and_models(spark, tmp_path):
    import json

    from voltlake.operators import layout, views
    from voltlake.plans.script import Pipeline
    from voltlake.sinks import writers

    rng = np.random.default_rng(4)
    s = long(spark, rng.standard_normal((3, 500)))
    h = health.channel_health(s, 250.0)
    labels, flags = spark.createDataFrame([(0, "bad")], "channel_index int, label string"), spark.createDataFrame([(k, k == 1, False) for k in range(3)], "channel_index int, is_bad boolean, is_hidden boolean")
    got = {r.channel_index: r for r in writers.channel_training_rows(h, labels, flags).collect()}
    assert got[0].human_label == "bad" and got[1].flags.is_bad and got[2].human_label is None and set(got[0].features) == {"finite", "rms", "p95", "p99", "top", "d_rms", "kurtosis", "flat", "clipping", "drift", "line"}
    assert got[0].health.score == {r.channel_index: r.score for r in h.collect()}[0]
    seg = health.segment_health(s, 100, 500, 3, 250.0)
    decided = select.segment_decisions(seg.withColumn("overlap_fraction", F.lit(0.0)), ("good",), 0.1)
    kept = writers.segment_training_rows(seg, decided).collect()
    assert len(kept) == 5 and all(r.human_label is None and r.kept is not None and "gfp_p95" in r.features for r in kept)
    parts = spark.createDataFrame([("r", 1, 0.4, "Eye", 0.9, [1.0], [2.0]), ("r", 0, 0.6, "Brain", 0.5, [3.0], [4.0])], "recording_id string, component int, contribution double, label string, score double, mixing array<double>, unmixing array<double>")
    saved = json.loads(writers.saved_components(parts, "ica", "picard").first().json)
    assert [c["label"] for c in saved["components"]] == ["Brain", "Eye"] and saved["method"] == "picard"
    avg = spark.createDataFrame([("c", 0, 1, 2.0), ("c", 0, 0, 1.0)], "category string, channel_index int, rel int, value double")
    assert json.loads(writers.saved_template(avg, "blink", 250).first().json)["channels"] == [{"channel_index": 0, "waveform": [1.0, 2.0]}]
    from datetime import datetime

    files = writers.combined_package(rng.standard_normal((2, 30)), 100, [{"category": "a", "start_sample": 0, "end_sample": 29, "contributing": 3}], Pipeline().add("combine").steps, [(datetime(2024, 1, 2), "made")], {"a": [1.0]})
    assert formats.package(files)["is_averaged"] and b"made" in files["process.log"] and json.loads(files["noise.json"]) == {"a": [1.0]} and b"combine" in files["script.xml"]
    g = layout.unit_geometry(spark.createDataFrame([(0, 3.0, 0.0, 4.0), (1, 0.0, 0.0, 0.0)], "channel_index int, x double, y double, z double"))
    assert rows(g, "channel_index", "x", "z") == [(0, 0.6, 0.8)]
    assert rows(views.shown(h, 2, "channel_index"), "channel_index") == [(0,), (1,)]
    with pytest.raises(ValueError, match="markBad"):
        Pipeline().add("markBad", channels="1").run(spark.createDataFrame([], "channel_index int, values array<double>"), 250.0)


def test_two_recordings_stay_apart(spark):
    from voltlake.operators import spectra
    from voltlake.operators.layout import to_traces

    rng = np.random.default_rng(5)
    one, other = long(spark, rng.standard_normal((3, 512))), long(spark, 5 * rng.standard_normal((3, 512)))
    both = one.withColumn("recording_id", F.lit("a")).unionByName(other.withColumn("recording_id", F.lit("b")))
    for f in (lambda s: windows.gfp(s), lambda s: windows.average_reference(s), lambda s: spectra.band_powers(spectra.pooled_spectra(to_traces(s), [(0, 512)], 128.0)), lambda s: health.channel_health(s, 128.0), lambda s: health.segment_health(s, 128, 512, 3, 128.0), lambda s: stats.covariance(s, 3)):
        together = f(both)
        for name, alone in (("a", one), ("b", other)):
            want = f(alone)
            got = together.where(F.col("recording_id") == name).select(*want.columns)
            for x, y in zip(sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str), strict=True):
                assert [v for v in x if isinstance(v, str)] == [v for v in y if isinstance(v, str)]
                assert np.allclose([v for v in x if isinstance(v, (int, float))], [v for v in y if isinstance(v, (int, float))])


def test_spread_percentiles_are_exact(spark):
    rng = np.random.default_rng(8)
    data = [(k, float(v)) for k in range(3) for v in np.concatenate([np.exp(rng.standard_normal(400 * k + 7) * 3), np.zeros(k), [5.0] * 20 * k])]
    got = stats.spread_percentiles(spark.createDataFrame(data + [(1, None)], "k int, v double"), "v", {"a": 0.0, "b": 0.37, "c": 0.99, "d": 1.0}, "k", per_octave=4)
    for r in got.collect():
        assert r[1:] == pytest.approx(np.percentile([v for k, v in data if k == r.k], [0, 37, 99, 100]))
    assert stats.spread_percentiles(spark.createDataFrame([(v,) for _, v in data], "v double"), "v", {"m": 0.5}).first().m == pytest.approx(np.median([v for _, v in data]))


def test_islands_change_no_pick(spark):
    rng = np.random.default_rng(9)
    picks = [(k, int(a), float(rng.random())) for k in range(3) for a in sorted(rng.choice(400, 90, replace=False))]
    df = spark.createDataFrame(picks, "k int, start long, score double")
    got = rows(topk.strongest_non_overlapping(df, 7, "k"), "k", "start")
    want = []
    for k in range(3):
        kept: list[int] = []
        for _, a, _ in sorted((p for p in picks if p[0] == k), key=lambda p: (-p[2], p[1])):
            if all(abs(a - q) >= 7 for q in kept):
                kept.append(a)
        want += [(k, a) for a in kept]
    assert got == sorted(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 100
