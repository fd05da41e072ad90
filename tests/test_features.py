"""Table functions, filter precision, natural order, gates and short correlations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import long
from voltlake.functions import dsp, formats, tables
from voltlake.operators import detect, health, kernels, topk


def test_table_functions(spark):
    layout = b"<sensorLayout><sensors><sensor><name>Cz</name><number>1</number><type>0</type><x>1.5</x><y>2</y></sensor></sensors></sensorLayout>"
    script = formats.write_script([{"op": "filter", "parameters": {"highPassHz": "1"}}, {"op": "reference", "parameters": {}}])
    spark.createDataFrame([("a", bytearray(layout)), ("b", bytearray(b"<broken")), ("c", None), ("d", bytearray(script))], "path string, content binary").createOrReplaceTempView("files")
    assert set(tables.register_tables(spark)) == {"xml_values", "layout_sensors", "script_steps"}
    rows = spark.sql("SELECT f.path AS file, v.* FROM files f, LATERAL xml_values(f.content) v").collect()
    assert {(r.path, r.value) for r in rows if r.file == "a"} == set(formats.flattened(layout).items())
    assert [(r.path, bool(r.error)) for r in rows if r.file == "b"] == [(None, True)] and not [r for r in rows if r.file == "c"]
    assert [tuple(r)[:5] for r in spark.sql("SELECT v.* FROM files f, LATERAL layout_sensors(f.content) v WHERE f.path = 'a'").collect()] == [(1, 0, "Cz", 1.5, 2.0)]
    steps = spark.sql("SELECT v.seq, v.op, v.parameters FROM files f, LATERAL script_steps(f.content) v WHERE f.path = 'd' ORDER BY seq").collect()
    assert [(s.op, s.parameters) for s in steps] == [("filter", {"highPassHz": "1"}), ("reference", {})]
    with pytest.raises(Exception, match="bytes of a file"):
        spark.sql("SELECT * FROM xml_values('text')").collect()


def test_precision(spark):
    assert dsp.precision(1_000, high=0.04) == "double" and dsp.precision(1_000, high=0.06) == "single"
    assert dsp.precision(1_000, high=0.1, slope=48) == "double" and dsp.precision(1_000, high=0.3, slope=48) == "single"
    assert dsp.precision(1_000, low=491.0) == "double" and dsp.precision(1_000, low=480.0) == "single" and dsp.precision(1_000, low=480.0, slope=48) == "double" and dsp.precision(0) == "double"
    x = np.random.default_rng(3).standard_normal(2_000)
    y, used = dsp.band_pass_by_precision(x, 250.0, high=1.0, low=40.0)
    want = dsp.band_pass(x, 250.0, high=1.0, low=40.0)
    assert used == "single" and 0 < np.abs(y - want).max() < 1e-2 and np.allclose(y, y.astype(np.float32))
    big = x * 3e38  # leaves the range of single precision
    again, used = dsp.band_pass_by_precision(big, 250.0, high=1.0)
    assert used == "double" and np.allclose(again, dsp.band_pass(big, 250.0, high=1.0))
    rows = [("a", 0, x.tolist()), ("a", 1, []), ("a", 2, None)]
    got = kernels.filtered_by_precision(spark.createDataFrame(rows, "recording_id string, channel_index int, values array<double>"), 250.0, high=1.0, low=40.0).orderBy("channel_index").collect()
    assert [r.precision for r in got] == ["single", None, None] and got[1]["values"] == [] and got[2]["values"] is None


def test_natural_order(spark):
    names = ["a2", "a10", "a1b10", "a1b9", "A3", "b", "a007", "a" + "9" * 30, "a1" + "0" * 30, "", "10", "9"]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    got = [r.name for r in topk.numbered(df, topk.natural_key(F.col("name")), F.col("name")).orderBy("place").collect()]
    assert got == ["", "9", "10", "a1b9", "a1b10", "a2", "A3", "a007", "a10", "a" + "9" * 30, "a1" + "0" * 30, "b"]
    many = topk.numbered(spark.range(5_000).repartition(7), F.col("id")).where("place != id + 1").count()
    assert many == 0 and topk.numbered(df.where("false"), F.col("name")).count() == 0


def test_ocular_gates(spark):
    x = np.zeros(400)
    x[50:60] = np.array([40, 120, 200, 240, 250, 240, 200, 160, 155, 151.0])  # fast rise
    x[200:300] = 160 + 40 * np.sin(np.linspace(0, np.pi, 100))  # slow
    df = long(spark, {0: x})
    find = lambda **o: sorted(r.start_sample for r in detect.ocular_events(df, (0,), 250.0, min_s=0.004, max_s=1.0, rise_s=None, **o).collect())
    assert find() == [52, 200] and find(velocity=15.0) == [52, 200] and find(velocity=45.0) == []
    x[199], x[300] = 150.0 - 1e-9, 150.0 - 1e-9
    df = long(spark, {0: x})
    assert find(velocity=15.0) == [52] and find(acceleration=1.0) == [52] and find(acceleration=100.0) == []


def test_short_recordings_have_one_correlation(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(60)
    near = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "channel_index int, neighbour int, d2 double")
    df = long(spark, {0: base, 1: base + 0.1 * rng.standard_normal(60)})
    got = {r.channel_index: r.prediction for r in health.neighbour_prediction(df, near, 100).collect()}
    assert got[0] == pytest.approx(np.corrcoef(*np.stack([[r.value for r in df.where(f"channel_index = {c}").orderBy("sample_index").collect()] for c in (0, 1)]))[0, 1])
    assert health.neighbour_prediction(df.where("sample_index < 8"), near, 100).count() == 0
    assert health.neighbour_prediction(df, near, 20).count() == 2
