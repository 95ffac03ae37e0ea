"""Dense positions for groups of any size.

``row_number() over (partition by key)`` sends a whole key to one task. Here rows are range
partitioned by (keys, order), so a hot key spreads over many partitions; each partition is
numbered on its own and shifted by the number of earlier rows of the same key.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a temporary one only where none is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="marquee-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """Exact 1-based position of every row within its key; ``order`` must be total.

    The checkpoint fixes which row lies in which partition: range boundaries come from a
    sample, so a recomputed partition could otherwise disagree with the counted one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    )
    counts = ranged.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and range partition: the window is bounded by the partition count.
    offsets = counts.select(*keys, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_pid").orderBy(*order)
    numbered = ranged.withColumn("_rn", F.row_number().over(local))
    return (
        numbered.join(offsets, [*keys, "_pid"])
        .withColumn(name, F.col("_rn") + F.col("_before"))
        .drop("_rn", "_before", "_pid")
    )


def first_per_key(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key as a map-side combined aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
