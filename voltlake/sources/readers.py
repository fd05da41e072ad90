"""Recordings from files: one task a recording, any number of recordings a read.

Files come through Spark's binaryFile source, so any file system that Spark reads
will do. Companion files (header, data, markers; the files of a package) are
brought together by their common stem.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import formats

TRACES = "recording_id string, channel_index int, channel_name string, sampling_rate double, values array<float>, impedance_kohm double, error string"
EVENTS = "recording_id string, code string, label string, cell string, begin_s double, duration_s double, source_file string"


def recording_files(spark: SparkSession, path: str) -> DataFrame:
    """recording_id (path of the package or stem), file, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_extract("path", r"^(.*\.mff)/", 1)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    return raw.select(F.when(inside != "", inside).otherwise(stem).alias("recording_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")


def _load(pdf: pd.DataFrame, role: str = "eeg") -> dict:
    files = dict(zip(pdf["file"], (bytes(c) for c in pdf["content"]), strict=True))
    identity = pdf["recording_id"].iloc[0]
    known = ("vhdr", "edf", "lay", "avr", "mul", *formats.UNSUPPORTED)
    name = identity if identity.endswith(".mff") else next((f for f in sorted(files) if f.rsplit(".", 1)[-1].lower() in known), sorted(files)[0])
    return formats.read_recording(files, name, role)


def read_traces(spark: SparkSession, path: str, role: str = "eeg") -> DataFrame:
    """A row a channel of the signal of a role (eeg, or pns: peripheral channels of packages); a recording that can't be read gives one row with its error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        identity = pdf["recording_id"].iloc[0]
        try:
            rec = _load(pdf, role)
        except (formats.FormatError, ValueError, KeyError, TypeError, IndexError) as e:
            return pd.DataFrame([(identity, None, None, None, None, None, str(e) or type(e).__name__)], columns=[c.split()[0] for c in TRACES.split(", ")])
        z = rec.get("impedance") or [None] * len(rec["data"])
        return pd.DataFrame([(identity, k, rec["names"][k], rec["rate"], row.astype("float32"), z[k], None) for k, row in enumerate(rec["data"])], columns=[c.split()[0] for c in TRACES.split(", ")])

    return recording_files(spark, path).groupBy("recording_id").applyInPandas(run, TRACES)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        try:
            rec = _load(pdf)
        except (formats.FormatError, ValueError, KeyError, TypeError, IndexError):
            return pd.DataFrame(columns=names)
        return pd.DataFrame([(pdf["recording_id"].iloc[0], *(e.get(k) for k in names[1:])) for e in rec["events"]], columns=names)

    return recording_files(spark, path).groupBy("recording_id").applyInPandas(run, EVENTS)


def read_package_values(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, file, path, value, error) of every XML file; a damaged file gives one row with its error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                try:
                    rows += [(row.recording_id, row.file, k, v, None) for k, v in formats.flattened(bytes(row.content)).items()]
                except (SyntaxError, ValueError, LookupError) as e:  # a parse error is a SyntaxError
                    rows.append((row.recording_id, row.file, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["recording_id", "file", "path", "value", "error"])

    files = recording_files(spark, path).where(F.lower("file").endswith(".xml"))
    return files.mapInPandas(run, "recording_id string, file string, path string, value string, error string")


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """Motion rows by file, with text functions only: comments, blank and non-numeric rows go, other widths give an error row."""
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line_no", "line"))
    cells = F.filter(F.split(F.trim("line"), r"\s+"), lambda c: c != "")
    rows = lines.select("path", "line_no", cells.alias("c")).where((F.size("c") > 0) & ~F.get("c", 0).startswith("#") & F.forall("c", lambda c: c.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")))
    six = F.when(F.size("c") == 6, F.col("c")).when(F.size("c") == 9, F.slice("c", 2, 6))
    names = ("roll", "pitch", "yaw", "d_s", "d_l", "d_p")
    from pyspark.sql import Window

    numbered = rows.select("path", six.alias("v"), (F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).alias("volume"))
    return numbered.select("path", "volume", *(F.get("v", k).cast("double").alias(n) for k, n in enumerate(names)), F.when(F.col("v").isNull(), "6 or 9 columns are expected").alias("error"))


def read_noise(spark: SparkSession, path: str) -> DataFrame:
    """Noise curves: a JSON object of category to values."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<float>>").alias("m"))
    return whole.select(F.explode("m").alias("category", "curve"))
