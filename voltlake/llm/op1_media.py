"""ISO media containers: walk nested boxes, decode sample tables, list keyframe byte ranges.

``probe`` reads boxes and sample tables only; payload bytes are touched by
``track_bytes`` alone, which follows the sample table. ``mux`` writes a lossless
container with one track of 8-bit PCM. Samples of fragments (moof, traf, trun, with
the defaults of trex and tfhd) follow those of the sample table. Tables are checked
against the file's size before anything of the size they claim is made.

Edge cases: a null payload counts as empty; bytes that aren't a container, or
that end inside a box, give a row whose ``error`` says so and no tracks; equal
payloads give equal files (no clock, no random ids); repeated rows give repeated
results; extra columns of the input are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes, and the bytes before their children.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
MAX_DEPTH = 16
UNIT, SAMPLES_PER_CHUNK, SYNC_EVERY, RATE = 64, 16, 16, 8_000


class MediaError(ValueError):
    pass


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of each box, depth first. Handles 64-bit sizes and size 0 (to the end)."""
    end = len(data) if end is None else end
    if len(path) > MAX_DEPTH:
        raise MediaError("boxes are nested too deeply")
    while start < end:
        if end - start < 8:
            raise MediaError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind.decode('latin-1')} ends beyond its parent")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS and start + head + CONTAINERS[kind] <= start + size:
            yield from walk(data, start + head + CONTAINERS[kind], start + size, here)
        start += size


def _table(data, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    n = struct.unpack_from(">I", data, at)[0]
    width = np.dtype(kind).itemsize * columns
    if at + 4 + n * width > end:
        raise MediaError("a sample table is cut off")
    found = np.frombuffer(data, kind, n * columns, at + 4)
    return found.reshape(n, columns) if columns > 1 else found


def _sample_offsets(t: dict) -> np.ndarray:
    """Byte offset of each sample: its chunk's offset and the sizes before it in the chunk."""
    sizes, chunks, runs = t["sizes"], t["chunks"], t["runs"]
    if not len(sizes):
        return np.zeros(0, np.int64)
    if not len(runs) or not len(chunks):
        raise MediaError("samples without chunks")
    first = np.append(runs[:, 0].astype(np.int64) - 1, len(chunks))
    if first[0] != 0 or (np.diff(first) < 0).any():
        raise MediaError("runs of chunks are out of order")
    ends = np.cumsum(np.repeat(np.minimum(runs[:, 1].astype(np.int64), len(sizes)), np.diff(first)))
    if ends[-1] < len(sizes):
        raise MediaError("the chunks hold fewer samples than stsz lists")
    chunk = np.searchsorted(ends, np.arange(len(sizes)), side="right")
    starts = np.append(0, ends[:-1])
    before = np.cumsum(sizes) - sizes
    return chunks[chunk].astype(np.int64) + before - before[starts[chunk]]


def _equal_sizes(n: int, size: int, data: bytes) -> np.ndarray:
    """Sizes of n samples of one size, if the file can hold them."""
    if n * max(1, size) > len(data):
        raise MediaError("more samples than the file can hold")
    return np.full(n, size, np.int64)


def _packed_sizes(data: bytes, at: int, end: int, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data[at:end], np.uint8)
    if bits not in (4, 8, 16) or -(-n * bits // 8) > len(raw):
        raise MediaError("a table of sizes is cut off")
    if bits == 4:
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    return raw[: n * bits // 8].view(">u2" if bits == 16 else np.uint8).astype(np.int64)


def _fragment_header(data: bytes, at: int, moof: int, extends: dict[int, dict]) -> dict:
    """A track fragment's id, base offset and defaults (tfhd)."""
    flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
    out = {"track_id": struct.unpack_from(">I", data, at + 4)[0], "base": moof, "duration": 0, "size": 0, "flags": 0}
    out |= extends.get(out["track_id"], {})
    at += 8
    for bit, name, kind in ((0x1, "base", ">Q"), (0x2, "", ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
        if flags & bit:
            if name:
                out[name] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return out | {"next": out["base"]}


def _run_samples(data: bytes, at: int, end: int, head: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes, sync flags and ticks of a run of fragment samples (trun); its data go on where the run before ended, if it names no offset."""
    flags, n = struct.unpack_from(">II", data, at)
    at += 8
    start, first_flags = head["next"], None
    if flags & 0x1:
        start = head["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 0x4:
        first_flags = struct.unpack_from(">I", data, at)[0]
        at += 4
    names = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if names and at + 4 * len(names) * n > end:
        raise MediaError("a run of samples is cut off")
    listed = np.frombuffer(data, ">u4", n * len(names), at).reshape(n, len(names)).astype(np.int64) if names else np.zeros((0, 0), np.int64)
    sizes = listed[:, names.index("size")] if "size" in names else _equal_sizes(n, head["size"], data)
    marks = listed[:, names.index("flags")].copy() if "flags" in names else np.full(n, head["flags"], np.int64)
    if first_flags is not None and n:
        marks[0] = first_flags
    ticks = int(listed[:, names.index("duration")].sum()) if "duration" in names else n * head["duration"]
    offsets = start + np.cumsum(sizes) - sizes
    head["next"] = start + int(sizes.sum())
    return offsets, sizes, (marks & 0x10000) == 0, ticks


def probe(data: bytes) -> dict:
    """Brand, movie duration and the tracks' codec, times, sample table and keyframe byte ranges."""
    out: dict = {"brand": None, "duration_s": None, "fragments": 0, "tracks": []}
    track: dict = {}
    extends: dict[int, dict] = {}
    runs: list[tuple[int, tuple]] = []
    moof, head = 0, {}
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"ftyp" and end - at >= 4:
            out["brand"] = bytes(data[at : at + 4]).decode("latin-1")
        elif kind == b"moof":
            out["fragments"] += 1
            moof = at - 8
        elif kind == b"trex":
            which, _, duration, size, flags = struct.unpack_from(">IIIII", data, at + 4)
            extends[which] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"tfhd":
            head = _fragment_header(data, at, moof, extends)
        elif kind == b"trun":
            if not head:
                raise MediaError("a run of samples without its header")
            runs.append((head["track_id"], _run_samples(data, at, end, head)))
        elif kind in (b"mvhd", b"mdhd"):
            long = data[at : at + 1] == b"\1"
            scale, ticks = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
            if kind == b"mvhd":
                out["duration_s"] = ticks / scale if scale else None
            else:
                track |= {"timescale": scale, "duration": ticks}
        elif kind == b"trak":
            track = {"track_id": 0, "handler": "", "codec": "", "timescale": 0, "duration": 0, "sizes": np.zeros(0, np.int64), "chunks": np.zeros(0, np.int64), "runs": np.zeros((0, 3), np.int64), "sync": None, "ticks": 0}
            out["tracks"].append(track)
        elif kind == b"tkhd":
            track["track_id"] = struct.unpack_from(">I", data, at + (20 if data[at : at + 1] == b"\1" else 12))[0]
        elif kind == b"hdlr" and b"mdia" in path:
            track["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and end - at >= 16:
            track["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            times = _table(data, at + 4, end, ">u4", 2).astype(np.int64)
            track["ticks"] = int((times[:, 0] * times[:, 1]).sum())
        elif kind == b"stss":
            track["sync"] = _table(data, at + 4, end, ">u4").astype(np.int64) - 1
        elif kind == b"stsc":
            track["runs"] = _table(data, at + 4, end, ">u4", 3)
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, at + 4)
            track["sizes"] = _equal_sizes(n, fixed, data) if fixed else _table(data, at + 8, end, ">u4").astype(np.int64)
        elif kind == b"stz2":
            bits, n = struct.unpack_from(">II", data, at + 4)
            track["sizes"] = _packed_sizes(data, at + 12, end, bits & 255, n)
        elif kind in (b"stco", b"co64"):
            track["chunks"] = _table(data, at + 4, end, ">u4" if kind == b"stco" else ">u8").astype(np.int64)
    for t in out["tracks"]:
        t["offsets"] = _sample_offsets(t)
        sync = np.ones(len(t["sizes"]), bool)
        if t["sync"] is not None:
            sync[:] = False
            sync[t["sync"][(t["sync"] >= 0) & (t["sync"] < len(sync))]] = True
        mine = [run for which, run in runs if which == t["track_id"]]
        if mine:
            t["offsets"], t["sizes"], sync = (np.concatenate([x, *(run[k] for run in mine)]) for k, x in enumerate((t["offsets"], t["sizes"], sync)))
            t["ticks"] += sum(run[3] for run in mine)
            t["duration"] = t["duration"] or t["ticks"]
        if len(t["offsets"]) and (int(t["offsets"].min()) < 0 or int((t["offsets"] + t["sizes"]).max()) > len(data)):
            raise MediaError("a sample lies beyond the end of the file")
        keys = np.flatnonzero(sync)
        t["keyframes"] = list(zip(t["offsets"][keys].tolist(), t["sizes"][keys].tolist(), strict=True))
        t["duration_s"] = t["duration"] / t["timescale"] if t["timescale"] else None
    return out


def track_bytes(data: bytes, track: dict) -> bytes:
    """The track's samples in order, adjoining ones joined."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = offsets[np.append(0, breaks)], (offsets + sizes)[np.append(breaks - 1, len(offsets) - 1)]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes) -> bytes:
    """A container with one mono 8-bit PCM track; each sample holds ``UNIT`` bytes."""
    if len(payload) % UNIT:
        raise MediaError(f"the payload must be a multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    full, rest = divmod(n, SAMPLES_PER_CHUNK)
    runs = [(1, SAMPLES_PER_CHUNK, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    sync = np.arange(1, n + 1, SYNC_EVERY)

    def moov(data_at: int) -> bytes:
        offsets = data_at + np.arange(full + bool(rest), dtype=np.int64) * (SAMPLES_PER_CHUNK * UNIT)
        wide = bool(len(offsets)) and int(offsets[-1]) >= 2**32
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * UNIT, 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * UNIT), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n * UNIT, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + (8 if len(payload) < 2**32 - 8 else 16)
    return ftyp + moov(head) + _box(b"mdat", payload)


RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
TRACK = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", RANGES)])
TRACK_DDL = "array<struct<track_id: long, handler: string, codec: string, timescale: long, duration: long, duration_s: double, n_samples: long, keyframes: array<struct<offset: long, length: long>>>>"


def _row(t: dict) -> dict:
    return {k: t[k] for k in ("track_id", "handler", "codec", "timescale", "duration", "duration_s")} | {"n_samples": len(t["sizes"]), "keyframes": [{"offset": o, "length": n} for o, n in t["keyframes"]]}


def scan_media(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keep`` columns, then brand, duration_s, fragments, tracks (with keyframe byte ranges) and error."""
    kept = files.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(content):
                try:
                    found = probe(data.as_py() or b"")
                    rows.append((found["brand"], found["duration_s"], found["fragments"], [_row(t) for t in found["tracks"]], None))
                except (MediaError, struct.error, ValueError, KeyError, IndexError, OverflowError) as e:
                    rows.append((None, None, 0, [], str(e) or type(e).__name__))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.list_(TRACK), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, "brand", "duration_s", "fragments", "tracks", "error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return files.select(*keep, content).mapInArrow(run, f"{ddl}, brand string, duration_s double, fragments long, tracks {TRACK_DDL}, error string")


def feature(t: dict) -> str:
    keys = t["keyframes"]
    ranges = zlib.crc32(np.array(keys, ">u8").tobytes()) if keys else 0
    return f"codec={t['codec'].strip()};handler={t['handler']};timescale={t['timescale']};duration={t['duration']};samples={len(t['sizes'])};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};ranges_crc32={ranges}" if keys else f"codec={t['codec'].strip()};samples={len(t['sizes'])};keyframes=0"


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + bytes(unit if not raw else -len(raw) % unit)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, n_keyframes long, keyframes array<struct<offset:bigint,length:bigint>>"


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text as a container, probes the stored bytes, reads the payload back, and gives digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), RANGES)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                raw = text.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                stored = mux(pad(raw))
                t = probe(stored)["tracks"][0]
                payload = track_bytes(stored, t)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(t), t["duration_s"], len(t["keyframes"]), [{"offset": o, "length": n} for o, n in t["keyframes"]]))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
