"""Trials by window: the same measures as by trial, from rows that don't grow with the events."""

import random

from pyspark.sql import functions as F

from voltlake.operators import correct, epochs


def close(a, b, *keys):
    left, right = ({tuple(r[k] for k in keys): r.asDict() for r in x.collect()} for x in (a, b))
    assert left.keys() == right.keys() and left
    for key, row in left.items():
        for name, x in row.items():
            y = right[key][name]
            assert (x is None) == (y is None) and (x == y or isinstance(x, float) and abs(x - y) < 1e-9), (key, name, x, y)


def recording(spark):
    rng = random.Random(3)
    samples = [(r, c, i, None if (c, i) == (1, 7) else rng.gauss(0, 1)) for r in "ab" for c in range(3) for i in range(60) if (c, i) != (2, 20)]
    events = [(r, k, rng.choice(["x", "y"]), rng.randrange(60) / 10) for r in "ab" for k in range(300)]
    return spark.createDataFrame(samples, "recording_id string, channel_index int, sample_index long, value double"), spark.createDataFrame(events, "recording_id string, event_id long, code string, begin_s double")


def test_windows_measure_as_trials(spark):
    samples, events = recording(spark)
    trials = epochs.epoch(events, samples, 10.0, 4, 6, 60).cache()
    placed = epochs.placed_trials(events, 10.0, 4, 6, 60)
    once = epochs.windows(placed, samples, 10).cache()
    assert once.count() <= 2 * 2 * 51 * 3 * 10 < trials.count()  # categories x windows, however many events
    at = ("recording_id", "category", "channel_index", "rel")
    close(epochs.average_trials(trials), epochs.average_trials(once), *at)
    close(epochs.average_trials(epochs.baseline_corrected(trials, 4)), epochs.average_trials(epochs.baseline_corrected(once, 4)), *at)
    close(epochs.linear_baseline_average(trials, 10, 10.0), epochs.linear_baseline_average(once, 10, 10.0), *at)
    close(epochs.snr_metrics(trials, 4).drop("trial_count", "root_n"), epochs.snr_metrics(once, 4).drop("trial_count", "root_n"), "recording_id", "category")
    close(epochs.measurement_error(trials, 4, draws=20), epochs.measurement_error(once, 4, draws=20), "recording_id", "category")
    whole = correct.template_regressed(trials).where("rel = 0").select("recording_id", "category", "channel_index", "trial", "scale")
    close(whole, correct.regression_scales(once, placed).select(*whole.columns), "recording_id", "category", "channel_index", "trial")


def test_numbers_within_keys(spark):
    from voltlake.operators.topk import numbered_within

    rows = spark.createDataFrame([(None if k % 5 == 0 else f"k{k % 3}", (k * 7) % 100) for k in range(100)], "key string, at int")
    wanted = {}
    for key, at in sorted(((r.key, r.at) for r in rows.collect()), key=lambda x: (x[0] or "", x[1])):
        wanted[key, at] = sum(1 for k, _ in wanted if k == key)
    assert {(r.key, r.at): r.place for r in numbered_within(rows, ["key"], "at").collect()} == wanted


def test_counts_of_windows_number_trials(spark):
    samples, events = recording(spark)
    odd = spark.createDataFrame([("a", 900 + k, code, t) for k, (code, t) in enumerate([("x", None), ("y", -3.0), ("x", 0.0), (None, 2.0), (None, 2.0), ("x", 99.0)])], events.schema)
    events = events.unionByName(odd)
    placed = epochs.placed_trials(events, 10.0, 4, 6, 60)
    counted = epochs.counted_windows(events, 10.0, 4, 6, 60)
    key = ("recording_id", "category", "window")
    of = lambda rows: {tuple(r[k] for k in key): (r.first, r.times) for r in rows.collect()}
    wanted = of(placed.groupBy(*key).agg(F.min("trial").alias("first"), F.count("*").alias("times"), F.max("trial").alias("last")))
    assert of(counted) == wanted and ("a", None, 16) in wanted
    assert placed.groupBy(*key).agg((F.max("trial") - F.min("trial") + 1 - F.count("*")).alias("gap")).where("gap <> 0").isEmpty()
    evens = ("recording_id", "category", "trial", "channel_index", "rel")
    close(epochs.windows(placed, samples, 10).where("category IS NOT NULL"), epochs.windows(counted, samples, 10).where("category IS NOT NULL"), *evens)
    scales = ("recording_id", "category", "channel_index", "trial")
    close(correct.regression_scales(epochs.windows(placed, samples, 10), placed), correct.regression_scales(epochs.windows(counted, samples, 10), counted), *scales)
    assert "event_id" not in counted._jdf.queryExecution().analyzed().toString()  # no events are sorted or joined


def test_pieces_of_a_window(spark, monkeypatch):
    monkeypatch.setattr(correct, "PIECE", 3)
    samples, events = recording(spark)
    placed = epochs.placed_trials(events, 10.0, 4, 6, 60)
    once = epochs.windows(placed, samples, 10)
    found = correct.regression_scales(once, placed)
    whole = correct.template_regressed(epochs.epoch(events, samples, 10.0, 4, 6, 60)).where("rel = 0").select("recording_id", "category", "channel_index", "trial", "scale")
    close(whole, found.select(*whole.columns), "recording_id", "category", "channel_index", "trial")
    assert found.count() == whole.count()


def test_totals_over_block_edges(spark):
    from voltlake.operators.topk import totals_before

    rows = spark.createDataFrame([(k, at, at % 7) for k in ("a", None) for at in range(-30, 100, 3)], "key string, at long, n long")
    got = {(r.key, r.at): r.before for r in totals_before(rows, ["key"], "at", "n", size=10).collect()}
    assert got == {(k, at): sum(x % 7 for x in range(-30, at, 3)) for k in ("a", None) for at in range(-30, 100, 3)}
