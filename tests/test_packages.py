"""The package source and sink: round trips, ranges of blocks, pushed filters, failures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import long, traces_of
from voltlake.functions import formats
from voltlake.sources import packages, readers


def two(spark, n=1_000):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5, n)).astype(np.float32).astype(float)
    return x, long(spark, dict(enumerate(x)), "/one/x.mff").unionByName(long(spark, dict(enumerate(x[:2] * 2)), "/other/x.mff"))


def test_round_trip_by_ranges_of_blocks(spark, tmp_path):
    x, df = two(spark)
    packages.write_packages(df, str(tmp_path), 250.0, block=64)
    assert len([d for d in os.listdir(tmp_path) if d.endswith(".mff")]) == 2 and not os.path.exists(tmp_path / "_temporary")  # equal base names
    blocks = packages.read_blocks(spark, str(tmp_path), blocks=3)
    assert blocks.rdd.getNumPartitions() == 12 and {r.sampling_rate for r in blocks.collect()} == {250.0}
    name = str(tmp_path / packages.package_folder("/one/x.mff"))
    got = traces_of(packages.block_samples(blocks), name)
    assert np.array_equal(np.stack([got[c] for c in range(5)]), x)
    assert sorted(r.recording_id for r in packages.read_blocks(spark, f"file://{tmp_path}").select("recording_id").distinct().collect()) == sorted({name, str(tmp_path / packages.package_folder("/other/x.mff"))})
    # the reader of whole files agrees
    whole = {r.channel_index: np.array(r["values"]) for r in readers.read_traces(spark, name).collect()}
    assert all(np.allclose(whole[c], x[c]) for c in range(5))


def test_filters_reach_the_files(spark, tmp_path):
    x, df = two(spark)
    packages.write_packages(df, str(tmp_path), 250.0, block=64)
    name = str(tmp_path / packages.package_folder("/one/x.mff"))
    one = packages.read_blocks(spark, str(tmp_path), blocks=1).where((F.col("recording_id") == name) & F.col("channel_index").isin(1, 3) & (F.col("first_sample") >= 128) & (F.col("first_sample") < 320))
    assert one.rdd.getNumPartitions() == 3  # of 32 blocks in two files
    rows = one.collect()
    assert {(r.channel_index, r.first_sample) for r in rows} == {(c, s) for c in (1, 3) for s in (128, 192, 256)}
    assert all(np.array_equal(r["values"], x[r.channel_index, r.first_sample : r.first_sample + 64].astype(np.float32)) for r in rows)
    wanted = packages.Wanted()
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull

    assert wanted.take(EqualTo(("channel_index",), 3)) and wanted.take(In(("channel_index",), (3, 4))) and wanted.channels == {3}
    assert wanted.take(GreaterThan(("first_sample",), 5)) and wanted.low == 6 and not wanted.take(IsNull(("channel_index",))) and not wanted.take(EqualTo(("channel_name",), "a"))


def test_peripheral_signals_gains_and_damaged_packages(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, pns = rng.standard_normal((3, 40)), rng.standard_normal((2, 40))
    source = {"info1.xml": b"<dataInfo><generalInformation><fileDataType><EEG/></fileDataType></generalInformation><calibrations><calibration><beginTime>0</beginTime><type>GCAL</type><channels><ch n='2'>3.0</ch></channels></calibration></calibrations></dataInfo>"}
    files = formats.write_package(x, 100, pns=pns, pns_names=["ECG", "Resp"]) | source
    for name, change in (("good", {}), ("cut", {"signal1.bin": files["signal1.bin"][:-3]}), ("bad", {"signal1.bin": b"\x07\0\0\0"}), ("none", None)):
        os.makedirs(tmp_path / f"{name}.mff")
        for k, v in (files | change if change is not None else {}).items():
            (tmp_path / f"{name}.mff" / k).write_bytes(v)
    rows = packages.read_blocks(spark, str(tmp_path)).collect()
    good = [r for r in rows if r.error is None]
    assert {os.path.basename(r.recording_id) for r in rows if r.error} == {"cut.mff", "bad.mff", "none.mff"}
    assert np.allclose(np.stack([r["values"] for r in good]), x * np.array([[1], [3], [1]]), atol=1e-5)
    other = [r for r in packages.read_blocks(spark, str(tmp_path), "pns").collect() if "good" in r.recording_id]
    assert [r.channel_name for r in other] == ["ECG", "Resp"] and np.allclose(np.stack([r["values"] for r in other]), pns, atol=1e-6)


def test_failed_writes_leave_nothing(spark, tmp_path):
    _, df = two(spark, 200)
    from pyspark.sql.functions import udf

    @udf("double")
    def broken(v, c, i):
        if c == 1 and i == 150:
            raise RuntimeError("lost")
        return v

    with pytest.raises(Exception, match="lost"):
        packages.write_packages(df.withColumn("value", broken("value", "channel_index", "sample_index")), str(tmp_path), 100.0, block=32)
    assert not [d for d in os.listdir(tmp_path) if d.endswith(".mff")] if os.path.exists(tmp_path) else True
    packages.write_packages(df, str(tmp_path), 100.0)
    with pytest.raises(Exception, match="FileExists|exists|mff"):
        packages.write_packages(df, str(tmp_path), 100.0)
    assert packages.read_blocks(spark, str(tmp_path)).count() == 7
    packages.write_packages(df.where("channel_index = 0"), str(tmp_path), 100.0, mode="overwrite")
    assert packages.read_blocks(spark, str(tmp_path)).count() == 2 and not os.path.exists(tmp_path / "_temporary")
    packages.write_packages(df.where("false"), str(tmp_path), 100.0)
    with pytest.raises(Exception, match="two tasks"):
        spread = packages.matrix_blocks(df, 50).repartition(5, "block").sortWithinPartitions("recording_id", "block")
        spread.select("recording_id", "block", "channels", "rows").write.format("signal_package").option("rate", "100").mode("append").save(str(tmp_path / "b"))
