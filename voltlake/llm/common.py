"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch: Python workers hold one or two at a time.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; batches to Python are kept small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that is an error, as its machines share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="voltlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder.

    Parquet keeps the intermediate columnar and compressed, and it survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voltlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table written by ``materialise``, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def join_key(key: str):
    """Key for joining rows with an aggregate grouped by ``key``.

    The aggregate is already dealt by its grouping key, so a join on that key
    would reuse it, and a stage below an aggregate can't be split. An expression
    of the key makes the planner deal both sides for the join, where adaptive
    execution splits a hot key.
    """
    return F.col(key).bitwiseXOR(F.lit(0x5BD1E995))


#: Stands for a null id in join keys.
NULL_ID = -(2**63) + 1


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two join keys that are never null: the id and a content hash.

    Rows that repeat an id with another text stay apart; rows equal in both get
    equal results, so sharing a key is harmless.
    """
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID).cast("long")), F.xxhash64(text_of(text))
