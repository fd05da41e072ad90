"""Parsers and writers of recording formats, bytes in and plain values out. Samples are channels x samples in microvolts."""

from __future__ import annotations

import json
import math
import re
import struct
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta, timezone

import numpy as np


class FormatError(ValueError):
    pass


#: Factors to microvolts, and files that are recognised but not read.
UNITS = {"v": 1e6, "mv": 1e3, "µv": 1.0, "μv": 1.0, "uv": 1.0, "": 1.0, "nv": 1e-3}
UNSUPPORTED = ("set", "fdt", "generic", "foc", "fsg")


def decode_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def unit_scale(unit: str) -> float:
    return UNITS.get(unit.strip().lower(), 1.0)


def ini(text: str) -> dict[str, dict[str, str]]:
    """Sections and keys in lower case; lines that open with #, ; or // are comments."""
    out: dict[str, dict[str, str]] = {}
    section = ""
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("#", ";", "//")):
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip().lower()
            out.setdefault(section, {})
        elif "=" in line:
            key, value = line.split("=", 1)
            out.setdefault(section, {})[key.strip().lower()] = value.strip()
    return out


def natural_key(name: str) -> list:
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", name)]


# BrainVision


def brainvision(header: bytes, data: bytes) -> dict:
    h = ini(decode_text(header))
    common = h.get("common infos", {})
    n = int(common.get("numberofchannels", 0))
    interval = float(common.get("samplinginterval", 0))
    if n < 1 or interval <= 0:
        raise FormatError("the header lacks channels or a sampling interval")
    names, scales = [], []
    for k in range(1, n + 1):
        parts = h.get("channel infos", {}).get(f"ch{k}", "").split(",")
        parts += [""] * (4 - len(parts))
        names.append(parts[0].replace("\\1", ",") or f"Ch {k}")
        scales.append((float(parts[2]) if parts[2].strip() else 1.0) * unit_scale(parts[3]))
    order = common.get("dataorientation", "MULTIPLEXED").upper()
    if common.get("dataformat", "BINARY").upper() == "ASCII":
        if order != "MULTIPLEXED":
            raise FormatError("ASCII data must be multiplexed")
        rows = [line.replace(",", ".").split() for line in decode_text(data).splitlines() if line.strip()]
        rows = [r[-n:] for r in rows if _numeric(r[-1])]
        x = np.array(rows, float).T
    else:
        kind = h.get("binary infos", {}).get("binaryformat", "INT_16").upper()
        types = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}
        if kind not in types:
            raise FormatError(f"binary format {kind} isn't supported")
        flat = np.frombuffer(data, types[kind], len(data) // np.dtype(types[kind]).itemsize)
        flat = flat[: len(flat) // n * n]
        x = (flat.reshape(-1, n).T if order == "MULTIPLEXED" else flat.reshape(n, -1)).astype(float)
    positions = {}
    for key, value in h.get("coordinates", {}).items():
        r, theta, phi = (float(v) for v in value.split(",")[:3])
        r = 95.0 if r == 1 else r
        t, p = math.radians(theta), math.radians(phi)
        positions[int(key[2:]) - 1] = (r * math.sin(t) * math.cos(p), r * math.sin(t) * math.sin(p), r * math.cos(t))
    return {"data": x * np.array(scales)[:, None], "rate": 1e6 / interval, "names": names, "events": [], "positions": positions}


def _numeric(s: str) -> bool:
    try:
        float(s)
        return True
    except ValueError:
        return False


def brainvision_markers(raw: bytes, rate: float) -> list[dict]:
    """Markers in natural order of their keys, New Segment left out; onset (position - 1) / rate, duration if longer than a sample."""
    out = []
    marks = ini(decode_text(raw)).get("marker infos", {})
    for key in sorted((k for k in marks if k.startswith("mk")), key=natural_key):
        kind, description, position, size = [p.replace("\\1", ",").strip() for p in (marks[key].split(",") + [""] * 4)[:4]]
        if kind == "New Segment":
            continue
        length = int(size or 0)
        out.append({"code": f"{kind}/{description}" if description else kind, "begin_s": max(int(position or 1) - 1, 0) / rate, "duration_s": length / rate if length > 1 else None})
    return out


# EDF


def edf(raw: bytes) -> dict:
    """Header and records; annotation channels are skipped, all others must share one rate; digital to physical is linear."""
    if len(raw) < 256:
        raise FormatError("the file is shorter than a header")
    text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
    head, records, seconds, n = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    field = lambda start, width: [text(256 + n * start + k * width, width) for k in range(n)]
    names, units = field(0, 16), field(96, 8)
    pmin, pmax, dmin, dmax = (np.array([float(v) for v in field(s, 8)]) for s in (104, 112, 120, 128))
    per = [int(v) for v in field(216, 8)]
    use = [k for k in range(n) if names[k] != "EDF Annotations"]
    if not use or seconds <= 0:
        raise FormatError("there are no data channels")
    if len({per[k] for k in use}) > 1:
        raise FormatError("mixed EDF sample rates")
    body = np.frombuffer(raw, "<i2", (len(raw) - head) // 2, head)
    whole = len(body) // sum(per) if records < 0 else min(records, len(body) // sum(per))
    body = body[: whole * sum(per)].reshape(whole, -1)
    starts = np.cumsum([0, *per])
    gain = (pmax - pmin) / np.where(dmax == dmin, 1, dmax - dmin)
    x = np.stack([(body[:, starts[k] : starts[k + 1]].ravel() - dmin[k]) * gain[k] + pmin[k] for k in use]) * np.array([unit_scale(units[k]) for k in use])[:, None]
    return {"data": x, "rate": per[use[0]] / seconds, "names": [names[k] for k in use], "events": []}


# Persyst


def persyst(layout: bytes, data: bytes) -> dict:
    h = ini(decode_text(layout))
    info = h.get("fileinfo", {})
    n, rate = int(info.get("waveformcount", 0)), float(info.get("samplingrate", 0))
    if n < 1 or rate <= 0:
        raise FormatError("the layout lacks channels or a rate")
    kinds = {"0": "<i2", "7": "<i4"}
    if info.get("datatype", "0") not in kinds:
        raise FormatError("the data type isn't supported")
    x = np.frombuffer(data, kinds[info.get("datatype", "0")])
    x = x[: len(x) // n * n].reshape(-1, n).T * float(info.get("calibration", 1))
    channels = sorted(h.get("channelmap", {}).items(), key=lambda kv: int(kv[1]))
    names = [k for k, _ in channels][:n] or [f"Ch {k + 1}" for k in range(n)]
    events, in_comments = [], False
    for line in decode_text(layout).splitlines():
        if line.strip().startswith("["):
            in_comments = line.strip().lower() == "[comments]"
        elif in_comments and line.count(",") >= 4:
            parts = line.split(",", 4)
            events.append({"code": parts[4].strip(), "begin_s": float(parts[0]), "duration_s": float(parts[1]) or None})
    return {"data": x, "rate": rate, "names": names, "events": sorted(events, key=lambda e: (e["begin_s"], e["code"]))}


# BESA


def besa_ascii(raw: bytes, kind: str) -> dict:
    """avr: a row a channel, divided by SB, rate 1000 / DI. mul: a row a sample, divided by Bins/uV."""
    lines = [line for line in decode_text(raw).splitlines() if line.strip()]
    head = {k.lower(): float(v) for k, v in re.findall(r"([A-Za-z/]+(?:\([^)]*\)|\[[^\]]*\])?)\s*=\s*([-+.\d]+)", lines[0])}
    interval = next((v for k, v in head.items() if k in ("di", "samplinginterval[ms]") or k.startswith("samplinginterval")), 0.0)
    if interval <= 0:
        raise FormatError("the header lacks a sampling interval")
    body, names = lines[1:], None
    if not _numeric(body[0].split()[0]):
        names, body = body[0].split(), body[1:]
    rows = np.array([[float(v) for v in line.split()] for line in body])
    scale = head.get("sb", 1.0) if kind == "avr" else head.get("bins/uv", 1.0)
    x = (rows if kind == "avr" else rows.T) / (scale or 1.0)
    return {"data": x, "rate": 1000.0 / interval, "names": names or [f"Ch {k + 1}" for k in range(len(x))], "events": []}


# electrode sidecars


def sensors(raw: bytes, kind: str) -> list[tuple[str, float, float, float]]:
    """sfp: label x y z; elp: [type] label theta phi; loc: number angle radius label."""
    out = []
    for line in decode_text(raw).splitlines():
        p = line.split()
        if kind == "sfp" and len(p) >= 4 and all(map(_numeric, p[1:4])):
            out.append((p[0], *(float(v) for v in p[1:4])))
        elif kind == "elp" and len(p) >= 3 and _numeric(p[-1]) and _numeric(p[-2]):
            t, f = math.radians(float(p[-2])), math.radians(float(p[-1]))
            out.append((p[-3], math.sin(t) * math.cos(f), math.sin(t) * math.sin(f), math.cos(t)))
        elif kind == "loc" and len(p) >= 4 and all(map(_numeric, p[:3])):
            a, r = math.radians(float(p[1])), float(p[2])
            out.append((p[3].rstrip("."), r * math.sin(a), r * math.cos(a), math.cos(min(r, 1) * math.pi / 2)))
    return out


#: Rows of the 10-20 and 10-10 systems by their height (nose up), distances from the midline by pair of
#: numbers, distances that hold for a whole row, older names, and beginnings of names that aren't on the scalp.
ROW_HEIGHT = {"FP": 0.95, "AF": 0.78, "F": 0.56, "FC": 0.30, "FT": 0.30, "C": 0.0, "T": 0.0, "TP": -0.30, "CP": -0.30, "P": -0.56, "PO": -0.78, "O": -0.95, "I": -1.03}
PAIR_DISTANCE = (0.22, 0.42, 0.62, 0.84, 1.02)
ROW_DISTANCE = {"FP": 0.28, "O": 0.28, "A": 1.04, "M": 1.04}
TEMPORAL_DISTANCE, NASION_HEIGHT, RIM = 0.95, 1.03, 0.98
OLD_NAMES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
NON_SCALP = ("ECG", "EKG", "EOG", "HEOG", "VEOG", "EMG", "GSR", "RESP", "PULSE", "TRIG", "TRIGGER", "STATUS", "STI", "AUX", "DC", "SYNC", "REF", "VREF", "CMS", "DRL", "GND", "GROUND")


def standard_position(name: str) -> tuple[float, float] | None:
    """Place of a standard label on the unit circle, x to the right; None if it isn't one."""
    key = re.sub(r"-?REF|[\s_.]", "", name.upper())
    for label in (key, key.removeprefix("EEG")):
        m = re.fullmatch(r"([A-Z]+?)(Z|10|[1-9])", OLD_NAMES.get(label, label))
        if not m:
            continue
        row, place = m[1], m[2]
        if place == "Z":
            if row != "N" and row not in ROW_HEIGHT:
                continue
            x, y = 0.0, NASION_HEIGHT if row == "N" else ROW_HEIGHT[row]
        else:
            k = int(place)
            if row not in (*ROW_HEIGHT, "A", "M") or (row in ROW_DISTANCE and k > 2):
                continue
            far = ROW_DISTANCE.get(row) or (TEMPORAL_DISTANCE if row == "T" and k in (7, 8) else PAIR_DISTANCE[(k - 1) // 2])
            x, y = far if k % 2 == 0 else -far, ROW_HEIGHT.get(row, 0.0)
        shrink = min(1.0, RIM / math.hypot(x, y)) if x or y else 1.0
        return x * shrink, y * shrink
    return None


def inferred_layout(names: list[str]) -> dict[int, tuple[float, float]] | None:
    """Positions of standard labels by channel; None unless max(3, half) of the scalp channels have one."""
    plain = [re.sub(r"[\s_]", "", n.upper()) for n in names]
    scalp = [i for i, n in enumerate(plain) if n and not n.startswith(NON_SCALP)]
    found = {i: p for i in scalp if (p := standard_position(names[i]))}
    return found if len(found) >= max(3, math.ceil(len(scalp) / 2)) else None


def projected(points: list[tuple[float, float]], flip: bool) -> list[tuple[float, float]]:
    """Centred on the mean and divided by the largest radius."""
    p = np.array(points, float)
    p = p - p.mean(0)
    p = p / max(1e-12, np.hypot(*p.T).max())
    return [(float(x), float(-y if flip else y)) for x, y in p]


# motion parameters


def motion(raw: bytes) -> list[tuple[float, ...]]:
    """Six columns, or nine of which the second to seventh count."""
    rows = []
    for line in decode_text(raw).splitlines():
        p = line.split()
        if not p or p[0].startswith("#") or not all(map(_numeric, p)):
            continue
        if len(p) not in (6, 9):
            raise FormatError(f"{len(p)} columns; 6 or 9 are expected")
        rows.append(tuple(float(v) for v in (p if len(p) == 6 else p[1:7])))
    if not rows:
        raise FormatError("there are no motion rows")
    return rows


# the package format: XML files and block streams


def _plain(raw: bytes) -> ET.Element:
    root = ET.fromstring(raw)
    for e in root.iter():
        e.tag = e.tag.split("}")[-1]
    return root


def flattened(raw: bytes) -> dict[str, str]:
    """Path to text of an XML file: dots between names, [i] for repeated siblings, .@name for attributes."""
    out: dict[str, str] = {}

    def walk(e: ET.Element, path: str) -> None:
        for k, v in e.attrib.items():
            out[f"{path}.@{k.split('}')[-1]}"] = v
        if e.text and e.text.strip():
            out[path] = e.text.strip()
        tags = [c.tag for c in e]
        seen: dict[str, int] = {}
        for c in e:
            i = seen.get(c.tag, 0)
            seen[c.tag] = i + 1
            walk(c, f"{path}.{c.tag}[{i}]" if tags.count(c.tag) > 1 else f"{path}.{c.tag}")

    root = _plain(raw)
    walk(root, root.tag)
    return out


def signal_blocks(raw: bytes) -> tuple[np.ndarray, float, list[int]]:
    """Samples, rate and block sizes of a block stream: a flag 1 opens a new header, 0 repeats the last one."""
    at, blocks, sizes, header = 0, [], [], None
    while at + 4 <= len(raw):
        flag = struct.unpack_from("<i", raw, at)[0]
        if flag == 1:
            head, size, n = struct.unpack_from("<iii", raw, at + 4)
            offsets = np.frombuffer(raw, "<i4", n, at + 16)
            rates = np.frombuffer(raw, "<i4", n, at + 16 + 4 * n)
            if n and (set(rates.tolist()) != {int(rates[0])} or int(rates[0]) & 255 != 32):
                raise FormatError("channels must share one rate and 32-bit samples")
            now = (n, int(rates[0]) >> 8 if n else 0, size, offsets)
            if header and (header[0], header[1]) != (now[0], now[1]):
                raise FormatError("channels or rate change within the file")
            header, at = now, at + head
        elif flag == 0 and header:
            at += 4
        else:
            raise FormatError("the block stream is damaged")
        n, _, size, _ = header
        if at + size > len(raw):
            raise FormatError("a block is cut off")
        per = size // 4 // max(1, n)
        blocks.append(np.frombuffer(raw, "<f4", n * per, at).reshape(n, per).astype(float))
        sizes.append(per)
        at += size
    if not header:
        raise FormatError("there is no block")
    return np.concatenate(blocks, 1), float(header[1]), sizes


def write_blocks(blocks: list[np.ndarray], rate: float) -> bytes:
    """A block stream with a header for each block; the rate must be a whole number below 2^24."""
    if rate != int(rate) or not 0 < rate < 2**24:
        raise FormatError("the rate must be a whole number below 2^24")
    out = []
    for x in blocks:
        n, per = x.shape
        head = struct.pack("<iiii", 1, 20 + 8 * n, 4 * n * per, n) + (np.arange(n, dtype="<i4") * 4 * per).tobytes() + np.full(n, (int(rate) << 8) + 32, "<i4").tobytes() + struct.pack("<i", 0)
        out.append(head + np.ascontiguousarray(x, "<f4").tobytes())
    return b"".join(out)


def calibrations(raw: bytes, kind: str, n: int) -> np.ndarray:
    """Factors of GCAL (default 1) or ICAL (default NaN), of blocks that begin at 0; by channel number, else by place."""
    out = np.full(n, 1.0 if kind == "GCAL" else np.nan)
    for c in _plain(raw).iter("calibration"):
        if (c.findtext("type") or "").strip().upper() != kind or float(c.findtext("beginTime") or 0) != 0:
            continue
        for i, ch in enumerate(c.iter("ch")):
            number = next((ch.attrib[k] for k in ("n", "number", "channel") if k in ch.attrib), None)
            k = int(number) - 1 if number else i
            if 0 <= k < n and ch.text and _numeric(ch.text):
                out[k] = float(ch.text)
    return out


def calibrated(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    ok = np.isfinite(factors) & (factors != 1)
    out = x.copy()
    out[ok] *= factors[ok, None]
    return out


def parse_time(text: str) -> datetime | None:
    """ISO 8601 with up to nine fractional digits and an optional zone."""
    m = re.match(r"^\s*(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d{1,9}))?\s*(Z|[+-]\d\d:?\d\d)?\s*$", text or "")
    if not m:
        return None
    zone = (m[4] or "Z").replace("Z", "+00:00")
    base = datetime.fromisoformat(f"{m[1]}T{m[2]}{zone if ':' in zone else zone[:3] + ':' + zone[3:]}")
    return base + timedelta(microseconds=int((m[3] or "0").ljust(9, "0")[:6]))


def format_time(t: datetime) -> str:
    z = t.astimezone(t.tzinfo or timezone.utc)
    return z.strftime("%Y-%m-%dT%H:%M:%S.%f") + z.strftime("%z")[:3] + ":" + z.strftime("%z")[3:]


def begin_seconds(text: str, start: datetime | None) -> float:
    """Numbers above a million are microseconds, smaller ones seconds; dates count from the recording's start."""
    if _numeric(text):
        v = float(text)
        return v / 1e6 if v > 1_000_000 else v
    t = parse_time(text)
    return (t - start).total_seconds() if t and start else 0.0


def package_events(files: dict[str, bytes], start: datetime | None) -> list[dict]:
    """Events of all event files, each (file, code, begin) once, by time."""
    seen, out = set(), []
    for name in sorted((f for f in files if re.match(r"(?i)^events.*\.xml$", f)), key=natural_key):
        for e in _plain(files[name]).iter("event"):
            get = lambda k: (e.findtext(k) or "").strip()  # noqa: E731, B023
            key = (name, get("code"), get("beginTime"))
            if key in seen:
                continue
            seen.add(key)
            cell = next(((k.findtext("data") or "").strip() for k in e.iter("key") if (k.findtext("keyCode") or "").strip() in ("cel#", "#cel", "cell")), None)
            duration = get("duration")
            length = float(duration) / 1e6 if duration and _numeric(duration) and float(duration) > 0 else None
            out.append({"code": get("code"), "label": get("label") or None, "description": get("description") or None, "cell": cell or None, "begin_s": begin_seconds(get("beginTime"), start), "raw_begin": get("beginTime"), "source_file": name, "duration_s": length})
    return sorted(out, key=lambda e: (e["begin_s"], e["code"]))


def package_epochs(files: dict[str, bytes], sizes: list[int], rate: float) -> dict | None:
    """Segments of categories.xml placed in the epochs of epochs.xml by their midpoints; None if there is one plain segment."""
    if "epochs.xml" not in files or "categories.xml" not in files:
        return None
    ends = np.cumsum(sizes)
    epochs = []
    for e in _plain(files["epochs.xml"]).iter("epoch"):
        a, b, first, last = (int(float(e.findtext(k) or 0)) for k in ("beginTime", "endTime", "firstBlock", "lastBlock"))
        epochs.append((a, b, int(ends[first - 2]) if first > 1 else 0, int(ends[min(last, len(ends)) - 1])))
    out = []
    place = lambda us, base: int(math.floor(us / 1e6 * rate + 0.5)) + base
    for c in _plain(files["categories.xml"]).iter("cat"):
        name = (c.findtext("name") or "").strip()
        for s in c.iter("seg"):
            a, b, t = (float(s.findtext(k) or 0) for k in ("beginTime", "endTime", "evtBegin"))
            home = next((e for e in epochs if e[0] <= (a + b) / 2 < e[1]), None)
            if home is None:
                continue
            first = min(max(place(a - home[0], home[2]), home[2]), home[3] - 1)
            last = min(max(place(b - home[0], home[2]) - 1, first), home[3] - 1)
            count = next((int(k.findtext("data") or 1) for k in s.iter("key") if (k.findtext("keyCode") or "").strip() == "#seg" and _numeric(k.findtext("data") or "")), 1)
            out.append({"category": name, "start_sample": first, "end_sample": last, "stimulus_offset": max(0, place(t - a, 0)), "contributing": count})
    if len(out) < 2 and not any(s["contributing"] > 1 for s in out):
        return None
    return {"segments": sorted(out, key=lambda s: s["start_sample"]), "is_averaged": all(s["contributing"] > 1 for s in out)}


def timing_correction(values: dict[str, str]) -> tuple[bool, float, str | None]:
    """Evidence for an anti-alias shift: acquisition version 5.2 or later, or hardware filters adjusted (with the shift in microseconds)."""
    version = next((v for k, v in values.items() if k.endswith("acquisitionVersion")), None)
    parts = [int(m[0]) if (m := re.match(r"\s*\d+", p)) else 0 for p in (version or "").split(".")][:2]
    new = tuple(parts + [0] * (2 - len(parts))) >= (5, 2)
    shift = next((float(v) for k, v in values.items() if k.endswith("hardwareFilterShift") and _numeric(v)), 0.0)
    adjusted = next((v.lower() == "true" for k, v in values.items() if k.endswith("hardwareFilterAdjusted")), False)
    return new or adjusted, shift, version


def layout_sensors(raw: bytes) -> list[dict]:
    out = []
    for s in _plain(raw).iter("sensor"):
        if all(s.findtext(k) is not None for k in ("number", "type", "x", "y")):
            out.append({"number": int(s.findtext("number")), "type": int(s.findtext("type")), "name": (s.findtext("name") or "").strip(), "x": float(s.findtext("x")), "y": float(s.findtext("y")), "z": float(s.findtext("z") or 0)})
    return out


def _signal_info(files: dict[str, bytes], signal: str) -> bytes:
    number = re.search(r"(\d+)", signal)
    return files.get(f"info{number[1] if number else 1}.xml", b"")


def chosen_signal(names: list[str], texts: dict[str, bytes], role: str = "eeg") -> str:
    """The first signal file of the role (or the first of all for eeg)."""
    binaries = sorted((f for f in names if re.match(r"(?i)^signal\d*\.bin$", f)), key=natural_key)
    kinds = {}
    for b in binaries:
        info = _signal_info(texts, b)
        kind = next(_plain(info).iter("fileDataType"), None) if info else None
        kinds[b] = "EEG" if kind is None else kind[0].tag if len(kind) else (kind.text or "EEG").strip()
    eeg = [b for b in binaries if kinds[b].upper() == "EEG"] or binaries
    found = [b for b in binaries if "pns" in kinds[b].lower()] if role == "pns" else eeg
    if not found:
        raise FormatError("the package has no such signal")
    return found[0]


def signal_gains(texts: dict[str, bytes], signal: str, n: int) -> list[float]:
    info = _signal_info(texts, signal)
    return calibrations(info, "GCAL", n).tolist() if info else [1.0] * n


def channel_names(texts: dict[str, bytes], n: int, role: str = "eeg") -> list[str]:
    """Names of the layout's sensors of type 0, or of the peripheral set; numbers elsewhere."""
    placed = layout_sensors(texts["sensorLayout.xml"]) if "sensorLayout.xml" in texts else []
    named = {s["number"]: s["name"] for s in placed if s["type"] == 0}
    names = [named.get(k + 1) or f"Ch {k + 1}" for k in range(n)]
    if role == "pns" and "pnsSet.xml" in texts:
        own = [(s.findtext("name") or "").strip() for s in _plain(texts["pnsSet.xml"]).iter("sensor")]
        names = (own + names[len(own) :])[:n]
    return names


def companion_files(rate: float, samples: int, blocks: int, start: datetime | None = None) -> dict[str, bytes]:
    """What goes beside the signal of a continuous package: its time, kind and one epoch of all blocks."""
    files = write_package(np.zeros((1, 1)), rate, start=start)
    end = round(samples * 1e6 / rate)
    return {"info.xml": files["info.xml"], "info1.xml": files["info1.xml"], "epochs.xml": f"<epochs><epoch><beginTime>0</beginTime><endTime>{end}</endTime><firstBlock>1</firstBlock><lastBlock>{blocks}</lastBlock></epoch></epochs>".encode()}


def package(files: dict[str, bytes], role: str = "eeg") -> dict:
    """A recording from a package's files: the first signal of the role (or the first of all for eeg)."""
    chosen = chosen_signal(list(files), files, role)
    x, rate, sizes = signal_blocks(files[chosen])
    info = _signal_info(files, chosen)
    impedance = None
    if info:
        x = calibrated(x, np.array(signal_gains(files, chosen, len(x))))
        z = calibrations(info, "ICAL", len(x))
        impedance = z.tolist() if np.isfinite(z).any() else None
    values = flattened(files["info.xml"]) if "info.xml" in files else {}
    start = parse_time(next((v for k, v in values.items() if k.endswith("recordTime")), ""))
    names = channel_names(files, len(x), role)
    epochs = package_epochs(files, sizes, rate)
    events = package_events(files, start)
    if epochs:
        events = [{"code": s["category"], "label": None, "description": None, "cell": None, "begin_s": (s["start_sample"] + s["stimulus_offset"]) / rate, "raw_begin": "", "source_file": "categories.xml", "duration_s": None} for s in epochs["segments"]]
    return {"data": x, "rate": rate, "names": names, "events": events, "impedance": impedance, "start": start, "segments": epochs["segments"] if epochs else [], "is_averaged": bool(epochs and epochs["is_averaged"]), "block_sizes": sizes, "timing": timing_correction(values)}


def without_gain_calibration(raw: bytes) -> bytes:
    """A signal's info file less its GCAL tables (written samples are calibrated); others, like ICAL, stay."""
    return re.sub(rb"(?s)<calibration\b.*?</calibration>", lambda m: b"" if re.search(rb"(?i)<type>\s*GCAL\s*</type>", m[0]) else m[0], raw)


#: Files of a source package that go on unchanged.
COMPANIONS = re.compile(r"(?i)^(info|subject|montage\w*|coordinates|dipoleSet)\.xml$")


def kept_companions(source: dict[str, bytes], n_channels: int) -> dict[str, bytes]:
    """What a written package keeps of its source: info, subject, montage and coordinates; the layout if its sensors (types 0 and 1) are as many as the channels; the signal's info less gains."""
    kept = {name: raw for name, raw in source.items() if COMPANIONS.match(name)}
    layout = source.get("sensorLayout.xml")
    if layout and sum(s["type"] in (0, 1) for s in layout_sensors(layout)) == n_channels:
        kept["sensorLayout.xml"] = layout
    if "info1.xml" in source:
        kept["info1.xml"] = without_gain_calibration(source["info1.xml"])
    return kept


def write_package(x: np.ndarray, rate: float, segments: list[dict] | None = None, events: list[dict] | None = None, start: datetime | None = None, averaged: bool = False, pns: np.ndarray | None = None, pns_names: list[str] | None = None, source: dict[str, bytes] | None = None) -> dict[str, bytes]:
    """Files of a package: one block for continuous data, one for each segment (by start) otherwise.

    Peripheral channels (``pns``, as many samples) become a second signal cut in the
    same blocks. Files of a ``source`` package are kept as ``kept_companions`` says.
    """
    if start is None and source and "info.xml" in source:
        start = parse_time(next((v for k, v in flattened(source["info.xml"]).items() if k.endswith("recordTime")), ""))
    start = start or datetime(2000, 1, 1, tzinfo=timezone.utc)
    ordered = sorted(segments or [], key=lambda s: s["start_sample"])
    for s in ordered:
        if not 0 <= s["start_sample"] <= s["end_sample"] < x.shape[1]:
            raise FormatError("a segment lies outside the recording")
    if pns is not None and pns.shape[1] != x.shape[1]:
        raise FormatError("both signals must have as many samples")
    cut = lambda signal: [signal[:, s["start_sample"] : s["end_sample"] + 1] for s in ordered] or [signal]
    blocks = cut(x)
    us = lambda n, per_s=rate: round(n * 1e6 / per_s)
    cursor, epochs, cats = 0, [], {}
    for k, b in enumerate(blocks):
        end = cursor + b.shape[1]
        epochs.append(f"<epoch><beginTime>{us(cursor)}</beginTime><endTime>{us(end)}</endTime><firstBlock>{k + 1}</firstBlock><lastBlock>{k + 1}</lastBlock></epoch>")
        if ordered:
            s = ordered[k]
            count = f"<keys><key><keyCode>#seg</keyCode><data>{s.get('contributing', 1)}</data></key></keys>" if averaged else ""
            cats.setdefault(s["category"], []).append(f"<seg><beginTime>{us(cursor)}</beginTime><endTime>{us(end)}</endTime><evtBegin>{us(cursor + s.get('stimulus_offset', 0))}</evtBegin>{count}</seg>")
        cursor = end
    esc = lambda t: str(t).replace("&", "&amp;").replace("<", "&lt;")
    listed = "".join(f"<event><beginTime>{format_time(start + timedelta(seconds=e['begin_s']))}</beginTime><duration>{us(e.get('duration_s') or 0, 1)}</duration><code>{esc(e['code'])}</code></event>" for e in events or [])
    files = {
        "signal1.bin": write_blocks(blocks, rate),
        "info.xml": f"<fileInfo><recordTime>{format_time(start)}</recordTime></fileInfo>".encode(),
        "info1.xml": b"<dataInfo><generalInformation><fileDataType><EEG><sensorLayoutName/></EEG></fileDataType></generalInformation></dataInfo>",
        "epochs.xml": f"<epochs>{''.join(epochs)}</epochs>".encode(),
        "Events_export.xml": f"<eventTrack>{listed}</eventTrack>".encode(),
    }
    files |= kept_companions(source or {}, len(x))
    if pns is not None and len(pns):
        named = [*(pns_names or []), *(f"PNS {k + 1}" for k in range(len(pns_names or []), len(pns)))][: len(pns)]
        files["signal2.bin"] = write_blocks(cut(pns), rate)
        files["info2.xml"] = without_gain_calibration((source or {}).get("info2.xml") or b"<dataInfo><generalInformation><fileDataType><PNSData><sensorLayoutName/></PNSData></fileDataType></generalInformation></dataInfo>")
        files["pnsSet.xml"] = f"<PNSSet><sensors>{''.join(f'<sensor><number>{k}</number><name>{esc(v)}</name></sensor>' for k, v in enumerate(named))}</sensors></PNSSet>".encode()
    if ordered:
        files["categories.xml"] = f"<categories>{''.join(f'<cat><name>{esc(c)}</name><segments>{chr(10).join(v)}</segments></cat>' for c, v in cats.items())}</categories>".encode()
    return files


# processing scripts, noise curves, channel sets


def read_script(raw: bytes, known: frozenset[str]) -> list[dict]:
    """Steps in order with their parameters and rejections by category; unknown ops are skipped."""
    whole = lambda e, k: int(e.get(k)) if (e.get(k) or "").lstrip("-").isdigit() else 0
    out = []
    for s in _plain(raw).findall("step"):
        if s.get("op") not in known:
            continue
        rejected = [{"category": c.get("name"), "total": whole(c, "total"), "included": whole(c, "included"), "reasons": {r.get("code"): whole(r, "count") for r in c.findall("reason") if r.get("code")}} for c in s.findall("category") if c.get("name")]
        out.append({"seq": len(out), "op": s.get("op"), "parameters": {p.get("key"): p.text or "" for p in s.findall("param") if p.get("key")}, "replayable": s.get("replayable", "true") == "true", "note": s.findtext("note"), "rejections": rejected})
    return out


def write_script(steps: list[dict], root_name: str = "processing") -> bytes:
    root = ET.Element(root_name, version="1")
    for s in steps:
        e = ET.SubElement(root, "step", op=s["op"], replayable=str(bool(s.get("replayable", True))).lower())
        for k in sorted(s.get("parameters") or {}):
            ET.SubElement(e, "param", key=k).text = str(s["parameters"][k])
        if s.get("note"):
            ET.SubElement(e, "note").text = s["note"]
        for c in s.get("rejections") or []:
            found = ET.SubElement(e, "category", name=c["category"], total=str(c["total"]), included=str(c["included"]))
            for code in sorted(c["reasons"]):
                ET.SubElement(found, "reason", code=code, count=str(c["reasons"][code]))
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def channel_sets(raw: bytes) -> list[dict]:
    found = json.loads(raw)
    return [{"set_id": str(s["id"]), "name": s["name"], "channels": [int(c) for c in s["channels"]], "net": s.get("net")} for s in (found["sets"] if isinstance(found, dict) else found)]


def read_recording(files: dict[str, bytes], name: str, role: str = "eeg") -> dict:
    """Dispatch on the lower-case extension of ``name``; ``files`` holds it and its companions. Only packages have other roles than eeg (pns)."""
    ext = name.rsplit(".", 1)[-1].lower()
    other = lambda *exts: next((files[f] for f in sorted(files) if f.rsplit(".", 1)[-1].lower() in exts), None)
    if ext in UNSUPPORTED:
        raise FormatError(f"files of type {ext} aren't supported")
    if ext == "mff":
        return package(files, role)
    if role != "eeg":
        raise FormatError("the recording has no such signal")
    if ext in ("vhdr", "vmrk", "eeg"):
        header, data, marks = other("vhdr"), other("eeg", "dat"), other("vmrk")
        if header is None or data is None:
            raise FormatError("the header or data file is missing")
        out = brainvision(header, data)
        return out | {"events": brainvision_markers(marks, out["rate"]) if marks else []}
    if ext == "edf":
        return edf(other("edf"))
    if ext in ("lay", "dat"):
        return persyst(other("lay"), other("dat"))
    if ext in ("avr", "mul"):
        return besa_ascii(other(ext), ext)
    raise FormatError(f"unknown type {ext}")
