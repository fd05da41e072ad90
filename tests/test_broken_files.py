"""Traces of unreadable, empty and ragged recordings pass every kind of kernel."""

import numpy as np

from voltlake.operators import kernels
from voltlake.plans.script import Pipeline
from voltlake.sinks import writers
from voltlake.sources.readers import read_traces


def test_a_folder_with_a_broken_file(spark, tmp_path):
    """The example of the README over a folder in which one file can't be read."""
    x = np.random.default_rng(1).standard_normal((3, 400)) * 20
    writers.write_package(str(tmp_path / "good.mff"), x, 250)
    (tmp_path / "broken.edf").write_bytes(b"not a recording")
    traces = read_traces(spark, str(tmp_path))
    rows = Pipeline().add("filter", highPassHz=1, lowPassHz=40).add("reference").run(traces, 250.0).collect()
    broken = [r for r in rows if r["values"] is None]
    assert len(rows) == 4 and len(broken) == 1 and "broken" in broken[0].recording_id and broken[0].error
    good = np.stack([r["values"] for r in sorted(rows, key=lambda r: r.channel_index or 0) if r["values"] is not None])
    assert good.shape == (3, 400) and np.abs(good.mean(0)).max() < 1e-9
    assert kernels.r_wave_events(traces, 250.0).where("recording_id LIKE '%/broken'").count() == 0


def test_empty_null_and_ragged_channels(spark):
    schema = "recording_id string, channel_index int, error string, values array<float>"
    rows = [("a", 0, None, [1.0, 2.0, 4.0]), ("a", 1, None, [3.0, 0.0]), ("b", 0, None, []), ("b", 1, None, None), ("c", 0, "bad", None), ("d", 0, None, [1.0, 2.0]), ("d", 1, None, [3.0, 4.0]), ("d", 2, None, [])]
    df = spark.createDataFrame(rows, schema)
    got = {(r.recording_id, r.channel_index): (r.error, r["values"]) for r in Pipeline().add("reference").run(df, 250.0).collect()}
    assert got["a", 0][1] == [1.0, 2.0, 4.0] and got["a", 1][1] == [3.0, 0.0]  # ragged: unchanged
    assert got["b", 0][1] == [] and got["b", 1][1] is None and got["c", 0] == ("bad", None) and got["d", 0][1] == [-1.0, -1.0] and got["d", 2][1] == []
    filtered = {(r.recording_id, r.channel_index): r["values"] for r in kernels.filtered(df, 250.0, low=40.0).collect()}
    assert len(filtered) == len(rows) and filtered["b", 0] == [] and filtered["c", 0] is None
    sizes = kernels.by_recording(df, lambda x, c: __import__("pandas").DataFrame({"n": [x.shape[1]], "channels": [len(c)]}), "n int, channels int")
    assert sorted(tuple(r) for r in sizes.collect()) == [("a", 2, 2), ("d", 2, 2)]
