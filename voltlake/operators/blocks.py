"""Samples as blocks, so that one long trace is spread over tasks.

A block is a row: a channel's values of a stretch of samples. Every stretch has
``size`` samples but the last, which also takes what is left over (so it is never short,
unless the whole trace is). Two operators that need the same blocks share the exchange that makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.operators.keys import ids


def channel_blocks(samples: DataFrame, size: int) -> DataFrame:
    """Keys, channel_index, block, n_blocks, values: one row for each channel and block. Samples are numbered from 0 without gaps."""
    keys = [*ids(samples), "channel_index"]
    lengths = samples.groupBy(*keys).agg(F.greatest(F.floor((F.max("sample_index") + 1) / size), F.lit(1)).cast("long").alias("n_blocks"))
    placed = samples.join(lengths, keys).withColumn("block", F.least(F.floor(F.col("sample_index") / size), F.col("n_blocks") - 1).cast("long"))
    packed = placed.groupBy(*keys, "block").agg(F.max("n_blocks").alias("n_blocks"), F.sort_array(F.collect_list(F.struct("sample_index", F.col("value").cast("double").alias("value")))).alias("s"))
    return packed.select(*keys, "block", "n_blocks", F.transform("s", lambda x: x["value"]).alias("values"))


def halo_blocks(samples: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Keys, channel_index, block, first (sample), values: blocks of ``size`` samples with the samples before and after them.

    A sample goes to every block whose halo holds it, so no block looks at its
    neighbours; halos are cut at the ends of the recording.
    """
    keys = [*ids(samples), "channel_index"]
    value = F.col("value").cast("double").alias("value")
    if before or after:
        low, high = F.floor((F.col("sample_index") - after) / size), F.floor((F.col("sample_index") + before) / size)
        last = samples.groupBy(*ids(samples)).agg(F.floor(F.max("sample_index") / size).alias("last"))
        named = last.withColumnsRenamed({"recording_id": "__r"})
        at = samples.join(named, F.col("recording_id").eqNullSafe(F.col("__r"))).drop("__r") if ids(samples) else samples.crossJoin(F.broadcast(last))  # one row
        spread = at.select(*keys, "sample_index", value, F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, "last"))).alias("block"))
    else:  # a sample is in one block
        spread = samples.select(*keys, "sample_index", value, F.floor(F.col("sample_index") / size).alias("block"))
    packed = spread.groupBy(*keys, "block").agg(F.min("sample_index").alias("first"), F.sort_array(F.collect_list(F.struct("sample_index", "value"))).alias("s"))
    return packed.select(*keys, "block", "first", F.transform("s", lambda x: x["value"]).alias("values"))


def matrix_blocks(samples: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Keys, block, first, channels, rows: all channels of a block as one row, in channel order."""
    keys = ids(samples)
    packed = halo_blocks(samples, size, before, after).groupBy(*keys, "block").agg(F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("channel_index", "values"))).alias("c"))
    return packed.select(*keys, "block", "first", F.transform("c", lambda c: c["channel_index"]).alias("channels"), F.transform("c", lambda c: c["values"]).alias("rows"))
