"""Exact duplicates against immutable snapshots, each screened by static binary-fuse filters.

A store is a folder of snapshots, one for each batch of documents that was committed:

``rows``     every row of the batch: its number, doc_id, 64-bit digest and SHA-256
``entries``  every distinct text of the batch and the snapshot that first held it; the text itself is
             stored only where this is the first snapshot, so these are the exact buckets
``filters``  binary-fuse filters over the digests of the texts first held here, one for each key bucket

A commit groups its own duplicates by digest and bytes. Its distinct digests are screened by the filters
of all earlier snapshots: digests (8 bytes) and filters (9 bits a key) meet by key bucket, texts don't
move. Texts of claimed digests in the exact buckets are joined with the batch's distinct texts, byte by
byte, so false claims and colliding digests end here. A text that no filter claims is new. Nothing
written is changed later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.llm import fuse
from marquee.llm.common import partitions, release

#: Most digests of a filter and of a screening group, and least for a group of its own.
KEYS = 1 << 18
LEAST_KEYS = 1 << 10


def _groups(spark: SparkSession, keys: int) -> int:
    return max(1, -(-keys // KEYS), min(partitions(spark), keys // LEAST_KEYS))


def _filter(frame: pd.DataFrame) -> pd.DataFrame:
    seed, table = fuse.build(frame["digest"].to_numpy(np.int64))
    release()
    return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "seed": [seed], "filter": [table]})


def _screen(digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(digests) or not len(filters):
        return pd.DataFrame({"digest": np.empty(0, np.int64)})
    keys = digests["digest"].to_numpy(np.int64)
    return pd.DataFrame({"digest": keys[fuse.contains(int(filters["seed"].iloc[0]), filters["filter"].iloc[0], keys)]})


class Store:
    """Snapshots in the shared folder ``path``; ``snapshots`` of them are there already."""

    def __init__(self, spark: SparkSession, path: str, snapshots: int = 0):
        self.spark, self.path, self.snapshots = spark, path, snapshots

    def _read(self, n: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{n}/{name}")

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.hash("digest"), F.lit(_groups(self.spark, self._keys(n)))).alias("bucket")

    def _keys(self, n: int) -> int:
        return self._read(n, "entries").where(F.col("entry") == n).count()

    def claimed(self, n: int, digests: DataFrame) -> DataFrame:
        """The digests that snapshot ``n``'s filters claim; distinct ``digests`` in, distinct ones out."""
        filters = self._read(n, "filters")
        buckets = filters.count()
        # A large batch meets a small snapshot in several groups for each bucket.
        slices = -(-digests.count() // (KEYS * max(1, buckets)))
        own = digests.select("digest", F.pmod(F.hash("digest"), F.lit(max(1, buckets))).alias("bucket"), F.pmod(F.xxhash64("digest"), F.lit(max(1, slices))).cast("int").alias("slice"))
        spread = filters.select("bucket", "seed", "filter", F.explode(F.sequence(F.lit(0), F.lit(max(1, slices) - 1))).alias("slice"))
        return own.groupBy("bucket", "slice").cogroup(spread.groupBy("bucket", "slice")).applyInPandas(_screen, "digest long")

    def commit(self, docs: DataFrame) -> None:
        """Add the rows of ``docs`` (doc_id, text) as the next snapshot; a null text counts as empty."""
        n, path = self.snapshots, f"{self.path}/{self.snapshots}"
        text = F.coalesce("text", F.lit(""))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.xxhash64("text"))
        texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", F.sha2("text", 256).alias("sha")).write.parquet(f"{path}/rows")
        # Copies within the batch: equal digest and equal bytes, combined before the shuffle.
        distinct = texts.select("digest", "text").distinct()
        digests = self._read(n, "rows").select("digest").distinct()
        if n:
            claims = [self.claimed(s, digests).withColumn("entry", F.lit(s)) for s in range(n)]
            for more in claims[1:]:
                claims[0] = claims[0].union(more)
            claims[0].write.parquet(f"{path}/claims")
            held = None
            for s in range(n):
                own = self._read(n, "claims").where(F.col("entry") == s).select("digest")
                bucket = self._read(s, "entries").where(F.col("entry") == s).select("digest", "text", "entry").join(own, "digest", "left_semi")
                held = bucket if held is None else held.union(bucket)
            distinct = distinct.join(held, ["digest", "text"], "left")
        else:
            distinct = distinct.withColumn("entry", F.lit(None).cast("int"))
        new = F.col("entry").isNull()
        distinct.select(
            "digest", F.sha2("text", 256).alias("sha"), F.coalesce("entry", F.lit(n)).alias("entry"), F.when(new, F.col("text")).alias("text")
        ).write.parquet(f"{path}/entries")
        keys = self._read(n, "entries").where(F.col("entry") == n).select("digest")
        keys.withColumn("bucket", self._bucket(n)).groupBy("bucket").applyInPandas(_filter, "bucket int, seed long, filter binary").write.parquet(f"{path}/filters")
        self.snapshots += 1

    def members(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every row committed so far.

        Of equal texts the row with the largest doc_id stays; rows without doc_id come before all others.
        Where the largest doc_id repeats, one of its rows stays. No rows committed: no rows.
        """
        rows = entries = None
        for n in range(self.snapshots):
            own = self._read(n, "rows").withColumn("batch", F.lit(n))
            names = self._read(n, "entries").select(F.lit(n).alias("batch"), "digest", "sha", "entry")
            rows, entries = (own, names) if rows is None else (rows.union(own), entries.union(names))
        if rows is None:
            return self.spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
        key = ["batch", "digest", "sha"]
        # Totals of a batch's text, then of the text over all batches; copies combine before each shuffle.
        own = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "batch", "row")).alias("top")).join(entries, key)
        total = own.groupBy("entry", "digest", "sha").agg(F.sum("n").alias("group_size"), F.max("top").alias("top"))
        named = own.select(*key, "entry").join(total, ["entry", "digest", "sha"]).select(*key, "group_size", "top")
        kept = (F.col("top.batch") == F.col("batch")) & (F.col("top.row") == F.col("row"))
        return rows.join(named, key).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def batches(docs: DataFrame, n: int) -> Iterator[DataFrame]:
    """``docs`` in ``n`` batches by a hash of doc_id, for a table that comes without a batch of its own."""
    for b in range(n):
        yield docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == b)


def deduplicate(docs: DataFrame, path: str, n: int = 3) -> DataFrame:
    """Members of the whole table, committed to a new store at ``path`` batch by batch.

    Columns besides doc_id and text are ignored.
    """
    store = Store(docs.sparkSession, path)
    for batch in batches(docs, n):
        store.commit(batch)
    return store.members()


#: DuckDB text of the members of ``documents`` (unique doc_ids).
SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
