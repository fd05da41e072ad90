"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir) and calls one operator on all that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.llm.common import materialise, table, text_of
from voltlake.llm.components import connected_components
from voltlake.llm.op2_lines import dedupe_lines
from voltlake.llm.op4_mixing import mix
from voltlake.llm.op5_toxicity import fit_toxicity, score_toxicity
from voltlake.llm.op7_jaccard import jaccard_classes, with_vertices
from voltlake.llm.op9_decontam import contaminated
from voltlake.llm.queries import TARGETS


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), tuple(docs.columns), "__score")
    return scored.where("__score < 0.5").drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks, cut by rolling hashes over line hashes, and repeated passages of two lines and more go, everywhere but at their first place; n_chars is that of the text left."""
    cleaned = dedupe_lines(docs, prefix="__", passages=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays, that of the least id; rows that share an id go only if their texts are linked.

    Copies are cut to what they changed by the stage before, so a document is judged by
    its text in ``documents`` (found by its id, where one row there has it), and by its text
    now as well where the two differ: either may link it.
    """
    marked = materialise(with_vertices(docs)[0])
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__was"))
    once = sources.groupBy("__id").agg(F.count("*").alias("n")).where("n = 1").select("__id")
    judged = marked.select(F.col("__vertex").alias("vertex"), text_of().alias("now")).join(sources.join(once, "__id", "left_semi"), F.col("vertex") == F.col("__id"), "left")
    judged = judged.withColumn("twin", F.when((F.col("__was") != F.col("now")) & (F.col("now") != ""), F.shiftrightunsigned(F.xxhash64("vertex", F.lit("now")), 2).bitwiseOR(F.lit(1 << 62))))
    judged = materialise(judged.select("vertex", "twin", F.coalesce("__was", "now").alias("was"), F.when(F.col("twin").isNotNull(), F.col("now")).alias("now")))
    twins = judged.where("twin IS NOT NULL")
    classes = materialise(jaccard_classes(judged.select("vertex", F.col("was").alias("text")).unionByName(twins.select(F.col("twin").alias("vertex"), F.col("now").alias("text")))).select("vertex", "class"))
    of = lambda name: classes.select(F.col("vertex").alias(name), F.col("class").alias(f"{name}_class")).distinct()
    links = twins.select("vertex", "twin").join(of("vertex"), "vertex").join(of("twin"), "twin").select(F.col("vertex_class").alias("u"), F.col("twin_class").alias("v"))
    merged = connected_components(links).withColumnRenamed("vertex", "class")
    mine = judged.groupBy("vertex").agg(F.count("*").alias("times")).join(of("vertex"), "vertex").withColumnRenamed("vertex_class", "class")
    grouped = materialise(mine.join(merged, "class", "left").select("vertex", "times", F.coalesce("component", "class").alias("group")))
    first = grouped.groupBy("group").agg(F.min(F.struct("vertex", "times")).alias("x")).select(F.col("x.vertex").alias("__vertex"), F.col("x.times").alias("times"))
    kept = marked.join(first.select("__vertex"), "__vertex", "left_semi")
    repeated = materialise(first.where("times > 1").select("__vertex"))  # rows equal in id and text
    nth = F.row_number().over(Window.partitionBy("__vertex").orderBy(*docs.columns))
    one = kept.join(repeated, "__vertex", "left_semi").withColumn("__nth", nth).where("__nth = 1")
    return kept.join(repeated, "__vertex", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), name="__items")
    return found.where(F.size("__items") == 0).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, domain posteriors and rate beside the columns of every document that is left."""
    return mix(docs, table(spark, sf_dir, "labels"), TARGETS, tuple(docs.columns))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the classifiers, MinHash classes and fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
