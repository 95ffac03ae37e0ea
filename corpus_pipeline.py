"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. A decision
holds for one row: rows with repeated doc_id, exact repeats too, and rows without doc_id, which come
after all others, are documents of their own. Columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.llm import packing, quality, simhash, suffixes, tiling
from marquee.llm.common import table
from marquee.llm.repair import folder
from marquee.operators.ranking import checkpointed, positions

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_name``, a number of its own for every row, in ascending order of doc_id, null last.

    It is the doc_id where each row has one of its own. Otherwise rows are numbered, those of one doc_id
    in the order of a checkpointed row number.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("_name", F.col("doc_id").cast("long"))
    rows = checkpointed(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    numbers = positions(rows.select("doc_id", "_row"), [], [F.col("doc_id").asc_nulls_last(), F.col("_row")], "_name")
    return rows.join(numbers.select("_row", F.col("_name").cast("long").alias("_name")), "_row").drop("_row")


def _as_id(rows: DataFrame, *beside) -> DataFrame:
    return rows.select(F.col("_name").alias("doc_id"), "text", *beside)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows among ``docs``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("_score >= 0.3").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every SimHash component, that of the smallest doc_id."""
    rows = named(docs)
    groups = simhash.near_duplicates(_as_id(rows)).where("doc_id = component_id").select(F.col("doc_id").alias("_name"))
    return rows.join(groups, "_name", "left_semi").select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; emptied ones stay, as empty texts."""
    # As a string, as a column of whole numbers and nulls would pass through pandas as inexact floats.
    rows = _as_id(named(docs), F.col("doc_id").cast("string").alias("own_id"), "lang", "source")
    return suffixes.kept_texts(rows, ["own_id", "lang", "source"]).select(F.col("own_id").cast("long").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item by half or more."""
    rows = named(docs)
    leaks = tiling.covered(_as_id(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_name")).distinct()
    return rows.join(leaks, "_name", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document that is left."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", suffix_stage),
    ("benchmark_leaks", leak_stage),
    ("packing", packing_stage),
]
#: The learned stage and the transforms have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
