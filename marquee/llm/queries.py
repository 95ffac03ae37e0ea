"""Registered corpus queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import embeddings, exact, fmindex, licences, merkle, packing, periodic, quality, repair, simhash, suffixes, tiling, toxicity
from marquee.llm.common import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


@query("op3_embeddings")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.covered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.folder(spark, "token-files")
    repair.write(table(spark, sf_dir, "documents"), path)
    return repair.digests(spark, path)


@query("op9_licences", licences.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.removed(table(spark, sf_dir, "documents"))


@query("op11_exact_dedup", exact.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"), repair.folder(spark, "exact"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digested(periodic.periodic(periodic.planted(table(spark, sf_dir, "documents"))))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.build(table(spark, sf_dir, "documents"), repair.folder(spark, "manifest"), merkle.tampered()).audit()
