"""Operators over blocks of long traces against the whole traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.functions import dsp
from voltlake.operators import blocks, recursive


def long(spark, traces, name="a"):
    """LONG samples of {channel: values}."""
    rows = [(name, c, i, float(v)) for c, x in traces.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, channel_index int, sample_index long, value double").repartition(6)


def traces_of(df, name="a"):
    out = {}
    for r in sorted(df.where(F.col("recording_id") == name).collect(), key=lambda r: (r.channel_index, r.sample_index)):
        out.setdefault(r.channel_index, []).append(r.value)
    return {c: np.array(v) for c, v in out.items()}


def test_filters_over_blocks_equal_whole_traces(spark):
    rng = np.random.default_rng(3)
    x = {c: rng.standard_normal(n).cumsum() for c, n in enumerate((1_000, 131, 130, 65, 7, 6, 1))}
    df = long(spark, x).unionByName(long(spark, {0: x[0] * 2 + 1}, "b"))
    for options in ({"high": 8.0, "low": 30.0, "notch": 50.0, "slope": 24}, {"low": 20.0, "slope": 12}, {"high": 12.0, "slope": 48}):
        got = recursive.band_pass_blocks(df, 200.0, size=64, **options)
        assert set(got.columns) == {"recording_id", "channel_index", "sample_index", "value"}
        for c, y in traces_of(got).items():
            assert np.allclose(y, dsp.band_pass(x[c], 200.0, **options), atol=1e-9), (options, c)
        assert np.allclose(traces_of(got, "b")[0], dsp.band_pass(x[0] * 2 + 1, 200.0, **options), atol=1e-9)


def test_slow_filters_carry_their_state_over_many_blocks(spark):
    """A high-pass at 0.05 Hz remembers thousands of samples: one pass from rest, in blocks of 16."""
    x = np.random.default_rng(4).standard_normal(2_000) + 50
    sections = dsp.butterworth("high", 0.05, 200.0, 24)
    got = traces_of(recursive.filtered_blocks(long(spark, {0: x}), sections, 0, 16, both=False))[0]
    want = x
    for b, a in sections:
        want = dsp._recursive(b, a, want)
    assert np.allclose(got, want, atol=1e-8)


def test_one_trace_is_spread_over_tasks(spark):
    df = long(spark, {0: np.arange(4_000.0)})
    cut = blocks.channel_blocks(df, 128)
    assert cut.count() == 31 and cut.agg(F.max(F.size("values"))).first()[0] == 160
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({r.p for r in cut.select(F.spark_partition_id().alias("p")).collect()}) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert recursive.filtered_blocks(df.where("false"), dsp.butterworth("low", 20.0, 200.0, 24), 30).count() == 0
    assert recursive.filtered_blocks(df, [], 30).count() == 4_000


@pytest.mark.parametrize(("before", "after"), [(0, 0), (5, 9), (40, 70)])
def test_halos(spark, before, after):
    x = np.arange(100.0)
    for r in blocks.halo_blocks(long(spark, {2: x}), 32, before, after).collect():
        low, high = max(0, r.block * 32 - before), min(100, r.block * 32 + 32 + after)
        assert r.first == low and r["values"] == x[low:high].tolist()
    whole = blocks.matrix_blocks(long(spark, {2: x, 0: x + 1}), 64).orderBy("block").collect()
    assert [r.channels for r in whole] == [[0, 2]] * 2 and whole[1].rows[0] == (x[64:] + 1).tolist()


def test_islands_over_block_edges(spark):
    from voltlake.operators import topk

    rng = np.random.default_rng(9)
    rows = [(k, int(v), float(rng.integers(0, 5))) for k in "ab" for v in rng.integers(0, 900, 160)] + [("c", 5, 1.0)]
    df = spark.createDataFrame(rows, "key string, start long, score double")
    for fold in (topk.merge_nearby, topk.strongest_non_overlapping):
        for size in (1, 7, 64, 10_000):
            assert sorted(map(tuple, fold(df, 6, "key", size=size).collect())) == sorted(map(tuple, fold(df, 6, "key").collect())), (fold, size)


@pytest.mark.parametrize("size", [40, 64, 5_000])
def test_matched_filters_over_blocks(spark, size):
    from voltlake.functions import templates
    from voltlake.operators import matched

    rng = np.random.default_rng(12)
    shape = np.sin(np.arange(32) / 3) * np.hanning(32)
    x = rng.standard_normal((3, 1_500)) * 0.2
    for s in range(60, 1_400, 90):
        x[:, s : s + 32] += np.array([1.0, -2.0, 0.5])[:, None] * shape
    df = long(spark, dict(enumerate(x))).unionByName(long(spark, {0: x[0, :20]}, "short"))
    for polarity in ("same", "both"):
        got = [(r.sample_index, r.score) for r in matched.waveform_matches(df, 60, 32, 0.6, polarity, size=size).orderBy("sample_index").collect()]
        want = templates.waveform_matches(x, x[:, 60:92], 0.6, polarity)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    assert len(got) >= 15 and matched.waveform_matches(df.where("false"), 60, 32, 0.6).count() == 0
    assert matched.waveform_matches(df.drop("recording_id").where("channel_index = 1"), 60, 32, 0.6, size=size).count() >= 15


def test_subspaces_of_windows(spark):
    from voltlake.functions import cleaning
    from voltlake.operators import subspaces

    rng = np.random.default_rng(13)
    x = rng.standard_normal((3, 800)).cumsum(1)
    at = np.arange(20, 740, 60)
    df = long(spark, dict(enumerate(x)))
    starts = spark.createDataFrame([("a", int(s)) for s in [*at, 790, -5]], "recording_id string, start long")
    got = [tuple(r)[1:] for r in subspaces.obs_variance(df, starts, 40, 5).orderBy("component").collect()]
    want = cleaning.obs_variance(x, at, 40, 5)
    assert np.allclose(np.array(got, float), np.array(want))
    left = np.stack(list(traces_of(subspaces.spatial_projection(df, starts.where("start BETWEEN 0 AND 750"), 40, 2)).values()))
    assert np.allclose(left, cleaning.ssp_removed(x, at, 40, 2, 40), atol=1e-9)
    clean = np.stack(list(traces_of(subspaces.basis_removed(df, starts, 40, 12)).values()))
    for s in at:  # as many components as windows explain them whole: the line is left
        w = x[:, s : s + 40]
        assert np.allclose(clean[:, s : s + 40], cleaning.boundary_line(w), atol=1e-6)
    assert np.allclose(clean[:, :20], x[:, :20])
    alone = df.drop("recording_id")
    assert subspaces.obs_variance(alone, starts.drop("recording_id"), 40, 5).count() == 5
    assert subspaces.obs_variance(df.where("false"), starts, 40).count() == 0 == subspaces.spatial_projection(df.where("false"), starts, 40).count()
