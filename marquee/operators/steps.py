"""Intermediate tables of a long computation: written once, read by later steps, removed when no longer read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marquee.operators.ranking import ensure_checkpoint_dir


class Steps:
    """Parquet tables in a folder of their own under the session's checkpoint folder.

    As a checkpoint does, a table cuts the lineage and survives the loss of an executor; it is compressed,
    and its folder can be removed while the computation goes on.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self._kept: list[tuple[DataFrame, str]] = []
        self._written = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._written += 1
        path = f"{self.root}/{self._written}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((out, path))
        return out

    def only(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        stay, gone = [], []
        for df, path in self._kept:
            (stay if any(df is t for t in tables) else gone).append((df, path))
        self._kept = stay
        for _, path in gone:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
