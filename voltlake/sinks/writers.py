"""Results to files."""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import formats
from voltlake.operators.keys import ids
from voltlake.sources.packages import package_folder


SEGMENT = "array<struct<category:string,start_sample:bigint,end_sample:bigint,stimulus_offset:int,contributing:int>>"
TRACE = "array<struct<channel_index:int,channel_name:string,values:array<double>>>"
EVENT = "array<struct<code:string,begin_s:double,duration_s:double>>"
SOURCE = "array<struct<file:string,content:binary>>"


def package_files(traces: DataFrame, rate: float, segments: DataFrame | None = None, averaged: bool = False, pns: DataFrame | None = None, events: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """(recording_id, file, content): the files of a package for every recording, made where its traces are.

    ``pns`` are traces of peripheral channels, ``source`` the files of the packages that
    the recordings came from (recording_id, file, content), whose companions are kept.
    """

    def packed(df: DataFrame | None, name: str, kind: str) -> DataFrame | None:
        if df is None:
            return None
        fields = [f.split(":")[0] for f in kind[len("array<struct<") : -2].split(",")]
        row = F.struct(*((F.col(f) if f in df.columns else F.lit(None)).alias(f) for f in fields))
        return df.groupBy("recording_id").agg(F.array_sort(F.collect_list(row)).cast(kind).alias(name))

    all_ = packed(traces, "t", TRACE)
    for df, name, kind in ((segments, "s", SEGMENT), (pns, "p", TRACE), (events, "e", EVENT), (source, "f", SOURCE)):
        found = packed(df, name, kind)
        all_ = all_.withColumn(name, F.lit(None).cast(kind)) if found is None else all_.join(found, "recording_id", "left")

    def matrix(rows) -> np.ndarray:
        return np.stack([np.asarray(r["values"], float) for r in rows])

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                options = {"segments": [dict(v) for v in row.s] if row.s is not None else None, "events": [dict(v) for v in row.e] if row.e is not None else None, "averaged": averaged}
                if row.p is not None:
                    options |= {"pns": matrix(row.p), "pns_names": [r["channel_name"] or f"PNS {k + 1}" for k, r in enumerate(row.p)]}
                if row.f is not None:
                    options["source"] = {r["file"]: bytes(r["content"]) for r in row.f}
                files = formats.write_package(matrix(row.t), rate, **options)
                yield pd.DataFrame({"recording_id": row.recording_id, "file": list(files), "content": list(files.values())})

    return all_.mapInPandas(run, "recording_id string, file string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (recording_id, file, content) below a folder that all executors share, in their tasks: recording_id, file, bytes written. Folders are named by the whole id (``package_folder``)."""

    def run(batches):
        for pdf in batches:
            done = []
            for row in pdf.itertuples():
                target = os.path.join(folder, package_folder(row.recording_id))
                os.makedirs(target, exist_ok=True)
                part = os.path.join(target, f".{row.file}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(row.content)
                os.replace(part, os.path.join(target, row.file))  # a repeated task replaces what it wrote
                done.append((row.recording_id, row.file, len(row.content)))
            yield pd.DataFrame(done, columns=["recording_id", "file", "bytes"])

    return files.mapInPandas(run, "recording_id string, file string, bytes long")


def write_package(path: str, x: np.ndarray, rate: float, **options) -> None:
    """One package on a local disk; an existing one is replaced, a failed one removed."""
    files = formats.write_package(x, rate, **options)
    shutil.rmtree(path, ignore_errors=True)
    os.makedirs(path)
    try:
        for name, content in files.items():
            with open(os.path.join(path, name), "wb") as f:
                f.write(content)
    except OSError:
        shutil.rmtree(path, ignore_errors=True)
        raise


def write_rows_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_rows_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def pruned(rows: DataFrame, channels: bool = True, pairs: bool = True) -> DataFrame:
    """The long result without the detail that was switched off."""
    out = ([] if channels else ["channel"]) + ([] if pairs else ["pair"])
    return rows.where(~F.col("scope").isin(*out)) if out else rows


def _features(df: DataFrame, keys: list[str], skip: tuple[str, ...]) -> Column:
    """Numeric columns as a map of name to value."""
    named = [f.name for f in df.schema.fields if f.name not in (*keys, *skip) and f.dataType.typeName() in ("double", "float", "integer", "long")]
    return F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*(F.col(c).cast("double") for c in named)))


RESULT = ("score", "percent", "grade", "weakest")


def channel_training_rows(health: DataFrame, labels: DataFrame, flags: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Training snapshot, a row a channel: human label, flags (bad, hidden, interpolated), the automatic result and the features it came from."""
    keys = [*ids(health), "channel_index"]
    given = health.select(*keys, F.struct(*(c for c in RESULT if c in health.columns)).alias("health"), _features(health, keys, RESULT).alias("features"))
    label = labels.select(*ids(health, labels), "channel_index", F.col("label").alias("human_label"))
    marks = flags.select(*ids(health, flags), "channel_index", F.struct(*(c for c in ("is_bad", "is_hidden", "is_interpolated") if c in flags.columns)).alias("flags"))
    out = given.join(label, [*ids(health, labels), "channel_index"], "left").join(marks, [*ids(health, flags), "channel_index"], "left")
    if names is None:
        return out.withColumn("channel_name", F.concat(F.lit("Ch "), F.col("channel_index") + 1))
    return out.join(names.select(*ids(health, names), "channel_index", "channel_name"), [*ids(health, names), "channel_index"], "left")


def segment_training_rows(health: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Training snapshot, a row a segment: bounds, automatic result, features, the decision if there is one, and a label that a person has yet to give."""
    keys = [*ids(health), "segment_id"]
    bounds = ("start_sample", "end_sample")
    out = health.select(*keys, *bounds, F.struct(*(c for c in RESULT if c in health.columns)).alias("health"), _features(health, keys, (*RESULT, *bounds)).alias("features"), F.lit(None).cast("string").alias("human_label"))
    if decisions is None:
        return out
    by = [*ids(health, decisions), "segment_id"]
    return out.join(decisions.select(*by, "kept", "reasons"), by, "left")


def model_json(model: DataFrame) -> DataFrame:
    return model.select(F.to_json(F.struct("*")).alias("json"))


def saved_components(components: DataFrame, name: str, method: str) -> DataFrame:
    """(recording_id, json): a fitted decomposition of each recording as one document, components in order."""
    listed = components.groupBy(*ids(components)).agg(F.array_sort(F.collect_list(F.struct("component", "contribution", "label", "score", "mixing", "unmixing"))).alias("components"))
    return listed.select(*ids(components), F.to_json(F.struct(F.lit(name).alias("name"), F.lit(method).alias("method"), "components")).alias("json"))


def saved_template(average: DataFrame, name: str, rate: float) -> DataFrame:
    """(recording_id, category, json): an event template of every channel (an average: category, channel_index, rel, value)."""
    keys = [*ids(average), "category"]
    channel = average.groupBy(*keys, "channel_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel", "value"))), lambda x: x["value"]).alias("waveform"))
    listed = channel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("channel_index", "waveform"))).alias("channels"))
    return listed.select(*keys, F.to_json(F.struct(F.lit(name).alias("name"), F.lit(float(rate)).alias("sampling_rate"), "channels")).alias("json"))


def combined_package(x: np.ndarray, rate: float, segments: list[dict], steps: list[dict], log: list[tuple[datetime, str]], noise: dict[str, list[float]] | None = None) -> dict[str, bytes]:
    """Files of a combined package: signal and segments without peripheral channels, the script, the log, and the noise curves if any."""
    files = formats.write_package(x, rate, segments, averaged=any((s.get("contributing") or 1) > 1 for s in segments))
    files |= {"script.xml": formats.write_script(steps), "process.log": log_lines(log).encode()}
    return files | ({"noise.json": json.dumps({k: [float(v) for v in c] for k, c in sorted(noise.items())}).encode()} if noise else {})


def log_lines(entries: list[tuple[datetime, str]]) -> str:
    return "".join(f"[{t.strftime('%Y-%m-%d %H:%M:%S')}] {text}\n" for t, text in entries)


def provenance_lines(files: list[dict]) -> list[str]:
    return [f"{k + 1}. {f['name']}: {f['trials']} trials, weight {f['weight']:.3f}" for k, f in enumerate(files)]


def write_noise(path: str, curves: dict[str, list[float]]) -> None:
    with open(path, "w") as f:
        json.dump({k: [float(v) for v in c] for k, c in sorted(curves.items())}, f)


def write_channel_sets(path: str, sets: list[dict]) -> None:
    with open(path, "w") as f:
        json.dump({"sets": [{"id": s["set_id"], "name": s["name"], "channels": s["channels"], "net": s.get("net")} for s in sets]}, f, indent=2, sort_keys=True)
