"""Packages as a Spark data source, by ranges of blocks: ``spark.read.format("signal_package")`` and ``df.write``.

Reading. A partition is a range of blocks of one signal file; planning walks the
block headers only (a few bytes a block, by seeking), and a task seeks to its first
block and reads the wanted channels of its blocks, so a file of any length is read by
many tasks and nothing is held but one block. Filters on recording_id, channel_index and first_sample
are pushed: recordings and blocks that can't match get no partition, channels that
can't match are not read. A row is a channel of a block.

Writing. ``write_packages`` brings a recording's blocks to one task in order; the task streams
them into a package below a temporary folder. The driver's commit moves whole packages to
their places; a failed job is aborted and leaves none, and a task that runs twice
writes to two folders of which one is moved. Folders are named by the whole recording
id, so equal base names don't meet.

Files are reached through ``pyarrow.fs``, by path or URI. Options: ``path``, ``role``
(eeg, or pns for peripheral signals), ``blocks`` (of a partition; 64). Edge cases: a package that
can't be planned gives one row with its error; a file that ends within a block fails its task; a recording seen
in two tasks fails the write; an empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voltlake.functions import formats
from voltlake.operators.blocks import matrix_blocks
from voltlake.operators.keys import ids

SCHEMA = "recording_id string, channel_index int, channel_name string, sampling_rate double, block int, first_sample bigint, values array<float>, error string"


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) else (arrow_fs.LocalFileSystem(), os.path.abspath(path))


def package_folder(recording_id: str) -> str:
    """A folder's name for a recording: its base name, and a hash of the whole id where that is a path."""
    base = re.sub(r"\.[^./]+$", "", os.path.basename(recording_id.rstrip("/")))
    mark = "-" + hashlib.sha1(recording_id.encode()).hexdigest()[:12] if "/" in recording_id else ""
    return f"{base or 'recording'}{mark}.mff"


@dataclass
class Blocks:
    """A block's header as far as reading needs it."""

    at: int  # of its first sample in the file
    n_channels: int
    rate: float
    samples: int
    offsets: tuple[int, ...]  # of the channels, from ``at``


def block_index(f) -> Iterator[Blocks]:
    """Headers of a block stream, by seeking from one to the next."""
    end, at, last = f.size(), 0, None
    while at + 4 <= end:
        f.seek(at)
        flag = struct.unpack("<i", f.read(4))[0]
        if flag == 1:
            head, size, n = struct.unpack("<iii", f.read(12))
            table = np.frombuffer(f.read(8 * n), "<i4")
            if n and (len(set(table[n:].tolist())) != 1 or int(table[n]) & 255 != 32):
                raise formats.FormatError("channels must share one rate and 32-bit samples")
            now = (n, float(int(table[n]) >> 8) if n else 0.0, size, tuple(table[:n].tolist()))
            if last and last[:2] != now[:2]:
                raise formats.FormatError("channels or rate change within the file")
            last, at = now, at + head
        elif flag == 0 and last:
            at += 4
        else:
            raise formats.FormatError("the block stream is damaged")
        n, rate, size, offsets = last
        if at + size > end:
            raise formats.FormatError("a block is cut off")
        yield Blocks(at, n, rate, size // 4 // max(1, n), offsets)
        at += size


@dataclass
class Range(InputPartition):
    """Blocks ``first`` to ``first + len(blocks) - 1`` of a file."""

    recording: str
    file: str
    first: int
    starts: list[int]
    blocks: list[Blocks]
    names: list[str]
    gains: list[float]
    error: str | None = None


class Wanted:
    """What pushed filters leave: recordings, channels, and bounds of first_sample."""

    def __init__(self) -> None:
        self.recordings: set[str] | None = None
        self.channels: set[int] | None = None
        self.low, self.high = -(2**62), 2**62

    def take(self, f: Filter) -> bool:
        """Narrows by the filter; False if Spark has to apply it."""
        column = f.attribute[0] if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
        if column in ("recording_id", "channel_index") and isinstance(f, EqualTo | In):
            values = set(f.value) if isinstance(f, In) else {f.value}
            name = "recordings" if column == "recording_id" else "channels"
            known = getattr(self, name)
            setattr(self, name, values if known is None else known & values)
            return True
        if column == "first_sample" and not isinstance(f, In):
            v = f.value
            low = {EqualTo: v, GreaterThan: v + 1, GreaterThanOrEqual: v}.get(type(f))
            high = {EqualTo: v, LessThan: v - 1, LessThanOrEqual: v}.get(type(f))
            self.low = self.low if low is None else max(self.low, low)
            self.high = self.high if high is None else min(self.high, high)
            return True
        return False


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.role, self.size = options["path"], options.get("role", "eeg"), int(options.get("blocks", "64"))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Range]:
        files, root = file_system(self.path)
        found = files.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if not root.endswith(".mff") else [files.get_file_info(root)]
        out: list[Range] = []
        for folder in sorted(x.path for x in found if x.path.endswith(".mff") and x.type == arrow_fs.FileType.Directory):
            if self.wanted.recordings is None or folder in self.wanted.recordings:
                try:
                    out += self._ranges(files, folder)
                except (formats.FormatError, ValueError, SyntaxError, OSError, struct.error) as e:
                    out.append(Range(folder, "", 0, [], [], [], [], str(e) or type(e).__name__))
        return out

    def _ranges(self, files: arrow_fs.FileSystem, folder: str) -> list[Range]:
        small = {os.path.basename(x.path): x.path for x in files.get_file_info(arrow_fs.FileSelector(folder)) if x.type == arrow_fs.FileType.File}
        load = lambda name: files.open_input_file(small[name]).readall() if name in small else b""
        texts = {name: load(name) for name in small if name.endswith(".xml") and not name.lower().startswith("events")}
        chosen = formats.chosen_signal(list(small), texts, self.role)
        with files.open_input_file(small[chosen]) as f:
            blocks = list(block_index(f))
        if not blocks:
            raise formats.FormatError("there is no block")
        n = blocks[0].n_channels
        names, gains = formats.channel_names(texts, n, self.role), formats.signal_gains(texts, chosen, n)
        starts = np.concatenate([[0], np.cumsum([b.samples for b in blocks])]).tolist()
        ranges = []
        for at in range(0, len(blocks), self.size):
            keep = [k for k in range(at, min(at + self.size, len(blocks))) if self.wanted.low <= starts[k] <= self.wanted.high]
            if keep:  # blocks that can match are neighbours
                ranges.append(Range(folder, small[chosen], keep[0], [starts[k] for k in keep], [blocks[k] for k in keep], names, gains))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fields = ("recording_id", "channel_index", "channel_name", "sampling_rate", "block", "first_sample", "values", "error")
        types = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string())
        if partition.error:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((partition.recording, None, None, None, None, None, None, partition.error), types, strict=True)], names=fields)
            return
        files, _ = file_system(self.path)
        with files.open_input_file(partition.file) as f:
            for k, (start, block) in enumerate(zip(partition.starts, partition.blocks, strict=True)):
                channels = [c for c in range(block.n_channels) if self.wanted.channels is None or c in self.wanted.channels]
                rows = []
                for c in channels:
                    f.seek(block.at + block.offsets[c])
                    raw = f.read(4 * block.samples)
                    if len(raw) < 4 * block.samples:
                        raise formats.FormatError("a block is cut off")
                    x = np.frombuffer(raw, "<f4")
                    gain = partition.gains[c]
                    rows.append((x.astype(float) * gain).astype(np.float32) if np.isfinite(gain) and gain != 1 else x)
                m = len(channels)
                values = (np.repeat(partition.recording, m).tolist(), channels, [partition.names[c] for c in channels], [block.rate] * m, [partition.first + k] * m, [start] * m, rows, [None] * m)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=fields)


@dataclass
class Written(WriterCommitMessage):
    folders: list[tuple[str, str]]  # where it is, where it goes


class PackageWriter(DataSourceWriter):
    """Rows recording_id, block, channels, rows (channels x samples), sorted by recording and block within a task."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.rate, self.overwrite = options["path"], float(options["rate"]), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        files, root = file_system(self.path)
        below = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        done, now, out, samples, blocks = [], None, None, 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                for name, content in formats.companion_files(self.rate, samples, blocks).items():
                    with files.open_output_stream(f"{below}/{package_folder(now)}/{name}") as f:
                        f.write(content)
                done.append((f"{below}/{package_folder(now)}", f"{root}/{package_folder(now)}"))

        seen: set[str] = set()
        for row in iterator:
            if row.recording_id != now:
                close()
                now, samples, blocks = row.recording_id, 0, 0
                if now in seen:
                    raise ValueError(f"blocks of {now} aren't together: sort by recording and block")
                seen.add(now)
                files.create_dir(f"{below}/{package_folder(now)}", recursive=True)
                out = files.open_output_stream(f"{below}/{package_folder(now)}/signal1.bin")
            x = np.array(row.rows, float)
            out.write(formats.write_blocks([x], self.rate))
            samples, blocks = samples + x.shape[1], blocks + 1
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        moves = [m for message in messages if message for m in message.folders]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a recording came in two tasks: repartition by recording_id")
        there = [to for _, to in moves if files.get_file_info(to).type != arrow_fs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(there[0])
        for to in there:
            files.delete_dir(to)
        for source, to in moves:
            files.move(source, to)
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, files: arrow_fs.FileSystem, root: str) -> None:
        for folder in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            info = files.get_file_info(folder)
            if info.type == arrow_fs.FileType.Directory and (folder.endswith(self.job) or not files.get_file_info(arrow_fs.FileSelector(folder))):
                files.delete_dir(folder)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signal_package"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        return PackageWriter(dict(self.options), overwrite)


def read_blocks(spark: SparkSession, path: str, role: str = "eeg", blocks: int = 64) -> DataFrame:
    """Rows of ``SCHEMA`` of the packages below a folder; filter them by recording, channel and first sample."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
    return spark.read.format("signal_package").option("role", role).option("blocks", str(blocks)).load(path)


def block_samples(blocks: DataFrame) -> DataFrame:
    """LONG samples of such rows."""
    return blocks.where("error IS NULL").select("recording_id", "channel_index", "first_sample", F.posexplode("values").alias("at", "value")).select("recording_id", "channel_index", (F.col("first_sample") + F.col("at")).alias("sample_index"), F.col("value").cast("double").alias("value"))


def write_packages(samples: DataFrame, path: str, rate: float, block: int = 4_096, mode: str = "append") -> None:
    """Packages of LONG samples, a folder a recording; ``mode`` append refuses a recording that is there, overwrite replaces it."""
    spark = samples.sparkSession
    spark.dataSource.register(PackageSource)
    named = samples if ids(samples) else samples.withColumn("recording_id", F.lit("recording"))
    rows = matrix_blocks(named, block).select("recording_id", "block", "channels", "rows")
    rows.repartition("recording_id").sortWithinPartitions("recording_id", "block").write.format("signal_package").option("rate", str(rate)).mode(mode).save(path)
