"""Sinks: versioned publication, status and decision logs, keyed state tables.

A publication writes a new version directory and then replaces a one-row pointer, so readers
see the old or the new snapshot and never a mixture, and a lost executor only repeats tasks
inside the unpublished directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, root: str, version: str, schema_version: int, partition_by: list[str] | None = None) -> None:
    """snk_01: write version ``v=<version>``, then point to it."""
    spark = df.sparkSession
    out = df.withColumn("generated_at", F.lit(version)).withColumn("schema_version", F.lit(schema_version))
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/v={version}")
    pointer = spark.range(1).select(F.lit(version).alias("version"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_pointer/at={version}")


def current_version(spark: SparkSession, root: str) -> str | None:
    """Newest published version; versions sort as text (ISO stamps)."""
    fs, p = _fs_path(spark, f"{root}/_pointer")
    if not fs.exists(p):
        return None
    names = [s.getPath().getName()[3:] for s in fs.listStatus(p) if s.getPath().getName().startswith("at=")]
    return max(names) if names else None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/v={version}")


class Guarded:
    """grd_01, grd_02, src_02: guards that are gathered while a candidate is written.

    ``broken`` are aggregates that are TRUE where the candidate must be refused. Write what is derived from
    ``rows``, then ask ``refused()``; the input is read once. The guards see all rows, also those that a
    filter after ``rows`` drops. Derive without a shuffle in between: the guards are then part of the
    writing stage, whose finished tasks are not repeated for a lost executor.
    """

    def __init__(self, df: DataFrame, broken: dict[str, Column]):
        self._names, self._seen = list(broken), Observation()
        self.rows = df.observe(self._seen, *[F.coalesce(c, F.lit(True)).alias(n) for n, c in broken.items()])

    def refused(self) -> list[str]:
        got = self._seen.get
        return [n for n in self._names if got.get(n, True)]


def commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """snk_01: (number, version) of every commit, ascending. A file without a name is no commit yet."""
    fs, log = _fs_path(spark, f"{root}/_commits")
    if not fs.exists(log):
        return []
    files = sorted(s.getPath().getName() for s in fs.listStatus(log))
    text = spark.read.text(f"{root}/_commits", wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value") if files else None
    return sorted((int(r["f"]), r["value"]) for r in text.collect() if r["value"]) if files else []


def commit(spark: SparkSession, root: str, version: str, after: int) -> bool:
    """snk_01: make ``version`` the one that follows number ``after``; FALSE if another publisher was first."""
    fs, p = _fs_path(spark, f"{root}/_commits/{after + 1:012d}")
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception as lost:  # the file system's own "already exists"
        if not fs.exists(p):
            raise lost
        return False
    out.write(bytearray(version.encode()))
    out.close()
    return True


def publish_guarded(rows: DataFrame, guard: Guarded, root: str, version: str, after: int = 0) -> str:
    """snk_01: ``published``, ``conflict`` or the name of the first broken guard.

    The candidate version is written in the pass that gathers the guards. A refused or beaten candidate is
    removed and readers keep the version they had. ``after`` is the commit that the candidate builds on.
    """
    spark, path = rows.sparkSession, f"{root}/v={version}"
    rows.write.mode("error").parquet(path)
    refused = guard.refused()
    if not refused and commit(spark, root, version, after):
        return "published"
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)
    return refused[0] if refused else "conflict"


def read_committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The version of the last commit, or no rows."""
    known = commits(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v={known[-1][1]}") if known else spark.createDataFrame([], schema)


def expire(spark: SparkSession, root: str, keep: int) -> list[str]:
    """snk_01: remove all committed versions but the last ``keep`` (one at least); returns the removed ones."""
    known = commits(spark, root)
    kept = {v for _, v in known[-max(keep, 1):]}
    gone = [v for _, v in known if v not in kept]
    for v in gone:
        fs, p = _fs_path(spark, f"{root}/v={v}")
        fs.delete(p, True)
    return gone


def append_status(df: DataFrame, path: str) -> None:
    """snk_02: one row per run and source."""
    df.write.mode("append").parquet(path)


def append_decisions(df: DataFrame, path: str) -> None:
    """snk_03: decision ledger, partitioned for pruning by source and day."""
    df.write.mode("append").partitionBy("source_id", "run_day").parquet(path)


def save_state(df: DataFrame, root: str, step: str) -> DataFrame:
    """snk_04: state of one unit of work under its own step name; a repeated step rewrites itself.

    Returns the written state, so later steps start from the files and not from the lineage.
    """
    path = f"{root}/step={step}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
