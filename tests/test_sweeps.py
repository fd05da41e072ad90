"""Sweeps over intervals of any length against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from voltlake.operators import joins


@pytest.mark.parametrize("size", [3, 50, 100_000])
def test_swept_overlap_equals_all_pairs(spark, size):
    rng = random.Random(4)
    segments = [(r, k, a, a + rng.randint(0, 90)) for r in "ab" for k in range(40) for a in [rng.randint(0, 400)]] + [("c", 0, 5, 9)]
    intervals = [(r, a, a + rng.choice([0, 3, 30, 5_000])) for r in "ab" for _ in range(25) for a in [rng.randint(-50, 450)]] + [("a", 20, 10), ("a", 0, 99), ("a", 0, 99), ("d", 1, 2)]
    got = {(r.recording_id, r.segment_id): (r.overlap_samples, r.n_intervals) for r in joins.swept_overlap(spark.createDataFrame(segments, "recording_id string, segment_id int, start_sample long, end_sample long").withColumn("a", F.lit("clash")), spark.createDataFrame(intervals, "recording_id string, start_sample long, end_sample long"), size=size).collect()}
    for r, k, a, z in segments:
        parts = [min(z, y) - max(a, x) + 1 for q, x, y in intervals if q == r and x <= z and y >= a and y >= x]
        assert got[r, k] == (min(sum(parts), z - a + 1), len(parts)), (r, k)
    alone = spark.createDataFrame([(0, 10, 19)], "segment_id int, start_sample long, end_sample long")
    assert joins.swept_overlap(alone, spark.createDataFrame([(15, 3_000_000_000)], "start_sample long, end_sample long")).first().overlap_samples == 5
    assert joins.swept_overlap(alone.where("false"), alone).count() == 0 and joins.swept_overlap(alone, alone.where("false")).first().n_intervals == 0


@pytest.mark.parametrize("size", [4, 64, 10_000])
def test_samples_find_their_segment(spark, size):
    segments = [("a", 0, 3, 5), ("a", 1, 6, 6), ("a", 2, 10, 700), ("b", 0, 0, 0), ("b", 1, 900, 901)]
    samples = [(r, c, i, 0.0) for r in "abc" for c in (0, 1) for i in range(0, 300, 3)]
    found = joins.in_segments(spark.createDataFrame(samples, "recording_id string, channel_index int, sample_index long, value double"), spark.createDataFrame(segments, "recording_id string, segment_id int, start_sample long, end_sample long"), size)
    rows = found.collect()
    assert len(rows) == len(samples)
    for r in rows:
        want = next((k for q, k, a, z in segments if q == r.recording_id and a <= r.sample_index <= z), None)
        assert r.segment_id == want, r
