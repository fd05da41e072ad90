"""Queries by name, with their SQL where SQL can express them, and the driver tables as recordings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.operators.keys import ids
from voltlake.operators.layout import events_from_table, signal_from_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The recording in ``embeddings``: 64 channels at 250 Hz.
RATE, CHANNELS = 250.0, 64

#: SQL of the same views.
SIGNAL = "s AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS ch, unnest(embedding)::DOUBLE AS v FROM embeddings)"
TRACK = "e AS (SELECT event_id, event_type AS code, user_id, value, date_diff('microsecond', min(ts) OVER (), ts) / 1e6 AS t FROM events)"
SERIES = "r AS (SELECT user_id AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"
#: SQL of a second recording: the same channels in reverse order at another scale.
SIGNAL_B = "s AS (SELECT vec_id AS i, 63 - c AS ch, v * 1.5 + (63 - c) * 0.01 AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings))"
SERIES_B = "r AS (SELECT user_id AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value * 0.5 + user_id % 7 AS v FROM events)"
LAYOUT = "l AS (SELECT DISTINCT l_linenumber AS ch FROM lineitem)"


#: Whether the recordings that queries are built on come alone or in twos, beside each other in one table.
_state = {"two": False}


def query(sql: str | None = None, two: bool = False):
    """Registers a query; with ``two`` also over two recordings in one table, where each must come out as if it were alone."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        if two:
            name = f"{f.__name__}_two_recordings"

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                _state["two"] = True
                try:
                    return f(spark, sf_dir)
                finally:
                    _state["two"] = False

            QUERIES[name] = run
            if sql:
                other = sql.replace(SIGNAL, SIGNAL_B).replace(SERIES, SERIES_B)
                ORACLE_SQL[name] = f"SELECT 'a' AS recording_id, * FROM ({sql}) UNION ALL SELECT 'b' AS recording_id, * FROM ({other})"
        return f

    return register


def both(one: DataFrame, other: DataFrame) -> DataFrame:
    """The first recording alone, or both in one table."""
    if not _state["two"]:
        return one
    return one.withColumn("recording_id", F.lit("a")).unionByName(other.withColumn("recording_id", F.lit("b")))


def out(df: DataFrame, *columns) -> DataFrame:
    """Columns of a result, after the recording's id if there are two recordings."""
    return df.select(*(ids(df) if _state["two"] else ()), *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = signal_from_vectors(table(spark, sf_dir, "embeddings"))
    channel = F.lit(CHANNELS - 1) - F.col("channel_index")
    return both(one, one.withColumn("channel_index", channel).withColumn("value", F.col("value") * 1.5 + F.col("channel_index") * 0.01))


def n_samples(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_table(table(spark, sf_dir, "events"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series: a channel a user, numbered by time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    one = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel_index"), (F.row_number().over(w) - 1).cast("long").alias("sample_index"), "value")
    return both(one, one.withColumn("value", F.col("value") * 0.5 + F.col("channel_index") % 7))


def circle(n: int):
    """A layout: n sensors on two rings."""
    import math

    return [(k, round(math.cos(2 * math.pi * k / n) * (1.0 if k % 2 else 0.55), 9), round(math.sin(2 * math.pi * k / n) * (1.0 if k % 2 else 0.55), 9)) for k in range(n)]


def r(c, digits: int = 6):
    """Rounded for comparison, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)
