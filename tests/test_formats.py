"""Readers against bytes made here, and round trips."""

import json
import struct
from datetime import datetime, timezone

import numpy as np
import pytest

from voltlake.functions import formats as f

VHDR = b"""Brain Vision Data Exchange Header File Version 1.0
; comment
[Common Infos]
NumberOfChannels=2
SamplingInterval=1000
DataOrientation=MULTIPLEXED
[Binary Infos]
BinaryFormat=INT_16
[Channel Infos]
Ch1=Fp1,,0.5,\xc2\xb5V
Ch2=C\\1z,,2,mV
[Coordinates]
Ch1=1,90,0
"""
VMRK = b"[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,Face\\1Happy,2,3,0\nMk10=Response,R1,4,1,0\n"


def test_brainvision():
    rec = f.read_recording({"a.vhdr": VHDR, "a.eeg": np.array([[2, 1], [4, 3]], "<i2").tobytes(), "a.vmrk": VMRK}, "a.vhdr")
    assert rec["rate"] == 1000 and rec["names"] == ["Fp1", "C,z"]
    assert rec["data"].tolist() == [[1, 2], [2000, 6000]]
    assert rec["events"] == [{"code": "Stimulus/Face,Happy", "begin_s": 0.001, "duration_s": 0.003}, {"code": "Response/R1", "begin_s": 0.003, "duration_s": None}]
    assert rec["positions"][0] == pytest.approx((95, 0, 0))


def edf_bytes(per=(4, 4), names=("Fp1", "Cz")):
    n = len(names)
    pad = lambda v, w: str(v).ljust(w)[:w]
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(2, 8) + pad(1, 8) + pad(n, 4)
    head += "".join(pad(x, 16) for x in names) + pad("", 80) * n + pad("uV", 8) * n + pad(-100, 8) * n + pad(100, 8) * n + pad(-32768, 8) * n + pad(32767, 8) * n + pad("", 80) * n + "".join(pad(p, 8) for p in per) + pad("", 32) * n
    return head.encode() + np.arange(2 * sum(per), dtype="<i2").tobytes()


def test_edf():
    rec = f.edf(edf_bytes())
    assert rec["data"].shape == (2, 8) and rec["rate"] == 4 and rec["events"] == []
    assert rec["data"][0, 0] == pytest.approx(32768 * 200 / 65535 - 100)
    with pytest.raises(f.FormatError, match="mixed"):
        f.edf(edf_bytes((4, 2)))
    assert f.edf(edf_bytes((4, 2), ("Fp1", "EDF Annotations")))["data"].shape == (1, 8)


def test_persyst_and_besa():
    lay = b"[FileInfo]\nWaveformCount=2\nSamplingRate=100\nCalibration=0.5\nDataType=0\n[ChannelMap]\nA=1\nB=2\n[Comments]\n0.5,0,0,1,late\n0.1,0.2,0,1,early\n"
    rec = f.persyst(lay, np.array([2, 4, 6, 8], "<i2").tobytes())
    assert rec["data"].tolist() == [[1, 3], [2, 4]] and [e["code"] for e in rec["events"]] == ["early", "late"]
    avr = f.besa_ascii(b"Npts= 3 TSB= 0 DI= 2 SB= 2\nA B\n2 4 6\n8 10 12\n", "avr")
    assert avr["data"].tolist() == [[1, 2, 3], [4, 5, 6]] and avr["rate"] == 500 and avr["names"] == ["A", "B"]
    mul = f.besa_ascii(b"TimePoints=2 Channels=2 SamplingInterval[ms]=4 Bins/uV=2\nA B\n2 4\n6 8\n", "mul")
    assert mul["data"].tolist() == [[1, 3], [2, 4]] and mul["rate"] == 250


def test_sidecars_and_layout():
    assert f.sensors(b"Fp1 1 2 3\nbad\n", "sfp") == [("Fp1", 1.0, 2.0, 3.0)]
    assert f.sensors(b"EEG Cz 0 0\n", "elp")[0][3] == pytest.approx(1)
    assert f.sensors(b"1 90 0.5 T8\n", "loc")[0][1] == pytest.approx(0.5)
    got = f.inferred_layout(["Fp1", "EEG T3-REF", "Cz", "EOG left", "PO10"])
    assert sorted(got) == [0, 1, 2, 4] and got[1] == (-0.95, 0.0) and got[2] == (0.0, 0.0)
    assert got[0] == pytest.approx((-0.28 * 0.98 / np.hypot(0.28, 0.95), 0.95 * 0.98 / np.hypot(0.28, 0.95))) and np.hypot(*got[4]) == pytest.approx(0.98)
    assert [f.standard_position(n) for n in ("O3", "X1", "Q", "")] == [None] * 4 and f.standard_position("Nz") == (0.0, 0.98)
    assert f.inferred_layout(["A", "B", "Cz"]) is None
    p = f.projected([(0, 0), (2, 0), (1, 3)], True)
    assert max(np.hypot(*q) for q in p) == pytest.approx(1)


def test_motion():
    assert f.motion(b"# c\n1 2 3 4 5 6\n\nx\n0 1 2 3 4 5 6 7 8\n") == [(1, 2, 3, 4, 5, 6), (1, 2, 3, 4, 5, 6)]
    for bad in (b"1 2 3\n", b"# only\n"):
        with pytest.raises(f.FormatError):
            f.motion(bad)


def test_package_round_trip():
    x = np.arange(40, dtype=float).reshape(2, 20)
    start = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    rec = f.package(f.write_package(x, 100, events=[{"code": "a&b", "begin_s": 0.05}], start=start))
    assert (rec["data"] == x).all() and rec["rate"] == 100 and rec["start"] == start
    assert rec["events"][0]["code"] == "a&b" and rec["events"][0]["begin_s"] == pytest.approx(0.05) and not rec["segments"]
    segs = [{"category": "B", "start_sample": 10, "end_sample": 13, "stimulus_offset": 1, "contributing": 7}, {"category": "A", "start_sample": 0, "end_sample": 3, "stimulus_offset": 1, "contributing": 10}]
    rec = f.package(f.write_package(x, 1000, segs, averaged=True))
    assert rec["is_averaged"] and [(s["category"], s["start_sample"], s["end_sample"], s["stimulus_offset"], s["contributing"]) for s in rec["segments"]] == [("A", 0, 3, 1, 10), ("B", 4, 7, 1, 7)]
    assert rec["data"].tolist() == np.concatenate([x[:, :4], x[:, 10:14]], 1).tolist() and len(rec["events"]) == 2
    with pytest.raises(f.FormatError):
        f.write_package(x, 100, [{"category": "A", "start_sample": 15, "end_sample": 25}])
    with pytest.raises(f.FormatError):
        f.write_blocks([x], 99.5)


def test_blocks_reuse_headers_and_reject_changes():
    x = np.arange(8, dtype=float).reshape(2, 4)
    raw = f.write_blocks([x], 250) + struct.pack("<i", 0) + np.ascontiguousarray(x, "<f4").tobytes()
    y, rate, sizes = f.signal_blocks(raw)
    assert sizes == [4, 4] and rate == 250 and (y == np.concatenate([x, x], 1)).all()
    with pytest.raises(f.FormatError):
        f.signal_blocks(f.write_blocks([x], 250) + f.write_blocks([x], 500))
    for bad in (b"", raw[:-3], b"\x07\0\0\0"):
        with pytest.raises(f.FormatError):
            f.signal_blocks(bad)


def test_calibration():
    cal = b"<dataInfo xmlns='x'><calibrations><calibration><beginTime>0</beginTime><type>GCAL</type><channels><ch n='1'>2</ch><ch n='2'>0.5</ch></channels></calibration><calibration><beginTime>9</beginTime><type>GCAL</type><channels><ch n='1'>9</ch></channels></calibration></calibrations></dataInfo>"
    g = f.calibrations(cal, "GCAL", 3)
    assert g.tolist() == [2, 0.5, 1] and np.isnan(f.calibrations(cal, "ICAL", 3)).all()
    assert f.calibrated(np.array([[1.0, 2, 3], [10, 20, 30], [1, 1, 1]]), g).tolist() == [[2, 4, 6], [5, 10, 15], [1, 1, 1]]


def test_xml_values_times_and_versions():
    assert f.flattened(b"<a x='1'><b>1</b><b>2</b><c>3</c></a>") == {"a.@x": "1", "a.b[0]": "1", "a.b[1]": "2", "a.c": "3"}
    t = f.parse_time("2024-01-02T03:04:05.123456789+02:00")
    assert t.microsecond == 123456 and f.parse_time(f.format_time(t)) == t and f.parse_time("x") is None
    assert f.begin_seconds("2000000", None) == 2 and f.begin_seconds("2", None) == 2
    assert f.timing_correction({"fileInfo.acquisitionVersion": "5.4.1.2 (r28337)"})[0] and not f.timing_correction({"fileInfo.acquisitionVersion": "5.1"})[0]


def test_script_sets_and_dispatch():
    steps = [{"op": "filter", "parameters": {"b": "2", "a": "1"}, "replayable": True, "note": None}, {"op": "mystery", "parameters": {}, "replayable": False}]
    steps[0]["rejections"] = [{"category": "A", "total": 9, "included": 7, "reasons": {"blink": 2}}]
    got = f.read_script(f.write_script(steps), frozenset({"filter"}))
    assert len(got) == 1 and got[0]["parameters"] == {"a": "1", "b": "2"} and got[0]["rejections"] == steps[0]["rejections"]
    assert f.channel_sets(json.dumps({"sets": [{"id": 1, "name": "x", "channels": [1, 2]}]}).encode())[0]["channels"] == [1, 2]
    for name in ("a.set", "a.xyz"):
        with pytest.raises(f.FormatError):
            f.read_recording({name: b""}, name)
