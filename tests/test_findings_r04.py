"""What the findings of round 4 were about."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voltlake.functions import dsp


def vectors(folder, n):
    """A table ``embeddings`` of n vectors, and its view in DuckDB."""
    import duckdb

    values = np.random.default_rng(3).standard_normal((n, 64)) / 8
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(values), pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32())}), folder / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return c


def equals_sql(spark, folder, c, name):
    from voltlake.plans.queries import ORACLE_SQL, QUERIES

    wanted = sorted(c.execute(ORACLE_SQL[name]).fetchall(), key=repr)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).collect()), key=repr)
    assert len(got) == len(wanted) and [r[:-1] for r in got] == [r[:-1] for r in wanted]
    assert np.allclose([r[-1] for r in got], [r[-1] for r in wanted], atol=2e-5)


def test_resting_last_segment_is_short(spark, tmp_path):
    equals_sql(spark, tmp_path, vectors(tmp_path, 2 * 125 + 40), "resting_analysis")


def test_windows_of_a_short_segment():
    x = np.random.default_rng(1).standard_normal(70)
    assert len(dsp.window_spectra(x, 250.0, 64)[1]) == 1
    full, cut = dsp.window_spectra(x, 250.0, 64, whole=125)[1]
    assert np.allclose(full, dsp.window_spectra(x, 250.0, 64)[1][0])
    rest = x[32:] - x[32:].mean()
    assert np.allclose(cut, np.fft.rfft(rest * dsp.hann(64, True)[:38], 64)[:32])
    assert len(dsp.window_spectra(x[:32], 250.0, 64, whole=125)[1]) == 1


def test_resting_health_is_of_all_samples(spark):
    from voltlake.plans.resting import resting_analysis

    n = 120_005
    samples = spark.range(n).select(F.lit(0).alias("channel_index"), F.col("id").alias("sample_index"), F.sin(F.col("id") * 0.3).alias("value"))
    assert resting_analysis(samples, 250.0, n, 1)["decisions"].agg(F.sum("points")).first()[0] == n


def test_resting_last_segments_of_two_recordings_are_short(spark, tmp_path):
    equals_sql(spark, tmp_path, vectors(tmp_path, 125 + 6), "resting_analysis_two_recordings")


def turn_left(x, unmixing, means):
    """The largest element of the gradient by rotations, where the fit ended."""
    y = np.array(unmixing) @ (x - np.array(means)[:, None])
    t = np.tanh(y)
    side = np.where(np.log(np.cosh(y)).mean(1) > 0.374567207491438, -1, 1)
    g = side[:, None] * (t @ y.T) / (x.shape[1] - 1)
    return np.abs(g - g.T).max() / 2


def test_cleaning_removes_components_of_a_converged_fit(spark, monkeypatch):
    from voltlake.operators import components, kernels

    x = np.random.default_rng(6).standard_normal((12, 700))  # 60 rounds don't converge on channels without structure
    traces = spark.createDataFrame([("a", c, v.tolist()) for c, v in enumerate(x)], "recording_id string, channel_index int, values array<double>")
    used, real = [], components.without_components
    monkeypatch.setattr(components, "without_components", lambda samples, models, *rest: (used.append(models), real(samples, models, *rest))[1])
    cleaned = kernels.ica_cleaned(traces, 250.0, np.array([(np.cos(k), np.sin(k)) for k in range(12)]))
    assert cleaned.count() == 12
    models = used[0].orderBy("component").collect()
    assert len(models) == 12 and turn_left(x, [r.unmixing for r in models], models[0].means) < 1e-6


def test_components_of_a_converged_fit(spark, tmp_path):
    from voltlake.plans.queries import QUERIES

    c = vectors(tmp_path, 300)
    x = np.array(c.execute("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall(), float)[:, 0].T
    found = QUERIES["ica_components"](spark, str(tmp_path)).orderBy("component").collect()
    assert len(found) == 64 and turn_left(x, [r.unmixing for r in found], found[0].means) < 1e-6


@pytest.mark.parametrize("held", [0, 2**20])
def test_rounds_over_blocks_converge(spark, monkeypatch, held):
    from tests.test_blocks import long
    from voltlake.operators import components

    monkeypatch.setattr(components, "HELD", held)  # tasks' sums are added up by Spark, or by the driver
    x, short = np.random.default_rng(8).standard_normal((5, 600)), np.random.default_rng(9).standard_normal((4, 90))
    df = long(spark, dict(enumerate(x))).unionByName(long(spark, dict(enumerate(short)), "b"))
    rows = components.fit_components(df, size=100).orderBy("recording_id", "component").collect()
    assert [r.recording_id for r in rows] == ["a"] * 5 + ["b"] * 4
    for data, part in ((x, rows[:5]), (short, rows[5:])):  # by passes, and in a task
        assert turn_left(data, [r.unmixing for r in part], part[0].means) < 1e-6
