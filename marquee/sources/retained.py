"""Retained state as a base and a delta for each batch (inc_01, snk_04).

A batch writes what it touches and nothing else, so the bytes written follow the batch and not the state:

``seen=<n>``  the batch's rows as merged, and the id of the row that each one was matched with
``gone=<n>``  rows that the batch no longer has and that were listed before it, and ids that are replaced
``base=<n>``  the whole state after batch ``n``, written by a compaction

A batch is committed by its ``gone`` folder, the last one written; a folder counts once its write has
ended. A batch that is committed already is not applied again. Readers take the newest base and the
newest row of every id that a later batch touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.operators.ranking import first_per_key
from marquee.operators.snapshot import matched_rows


class Retained:
    """State of listings under ``root``; ``schema`` has the columns that ``merge_listings`` keeps."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _done(self, kind: str) -> list[int]:
        fs, root = self._path("")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = [int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if fs.exists(self._path(f"{kind}={n}/_SUCCESS")[1]))

    def batches(self) -> list[int]:
        """Committed batches whose deltas are still there."""
        return self._done("gone")

    def _since(self, before: int | None) -> tuple[int | None, list[int]]:
        """(newest base, later deltas) of the state before a batch."""
        early = lambda n: before is None or n < before
        bases = [n for n in self._done("base") if early(n)]
        base = bases[-1] if bases else None
        return base, [n for n in self.batches() if early(n) and (base is None or n > base)]

    def current(self, before: int | None = None) -> DataFrame:
        """The state after the last batch, or after the last one before a batch.

        The base is only filtered: it meets the touched ids in an anti join. Ids grow with the state, so the
        joins are merges, and none of them come to the driver.
        """
        base, deltas = self._since(before)
        rows = self.spark.createDataFrame([], self.schema) if base is None else self.spark.read.schema(self.schema).parquet(f"{self.root}/base={base}")
        if not deltas:
            return rows
        newest = first_per_key(self._touched(deltas), ["id"], F.col("_n"), last=True)
        kept = rows.join(newest.select("id").hint("merge"), "id", "left_anti")
        return kept.unionByName(newest.where("not _replaced").select(*rows.columns))

    def _touched(self, deltas: list[int]) -> DataFrame:
        out = None
        for n in deltas:
            seen = self.spark.read.schema(self.schema).parquet(f"{self.root}/seen={n}").withColumn("_replaced", F.lit(False))
            gone = self.spark.read.schema(f"{self.schema}, _replaced boolean").parquet(f"{self.root}/gone={n}")
            both = seen.unionByName(gone).withColumn("_n", F.lit(n))
            out = both if out is None else out.unionByName(both)
        return out

    def apply(self, n: int, incoming: DataFrame, now: str, **merge_args) -> bool:
        """Merge batch ``n`` as ``merge_listings`` does; FALSE if it was committed before.

        Batches come in ascending order. A batch that was cut off is written anew.
        """
        bases = self._done("base")
        if n in self.batches() or (bases and bases[-1] >= n):
            return False
        before = self.current(before=n)
        matched_rows(before, incoming, now, **merge_args).write.mode("overwrite").parquet(f"{self.root}/seen={n}")
        # From the files: the merge is worked out once, and only its ids are read again.
        ids = self.spark.read.parquet(f"{self.root}/seen={n}").select("id", "_matched")
        replaced = ids.where("_matched <> id").select(F.col("_matched").alias("id")).distinct().join(ids.select("id").hint("merge"), "id", "left_anti")
        seen = ids.select("id").unionByName(replaced)
        left = before.where("not missingFromSource").join(seen.hint("merge"), "id", "left_anti").withColumn("missingFromSource", F.lit(True))
        gone = left.withColumn("_replaced", F.lit(False)).unionByName(replaced.withColumn("_replaced", F.lit(True)), allowMissingColumns=True)
        gone.write.mode("overwrite").parquet(f"{self.root}/gone={n}")
        return True

    def start(self, rows: DataFrame, n: int) -> None:
        """Take ``rows`` over as the state after batch ``n``."""
        rows.write.mode("overwrite").parquet(f"{self.root}/base={n}")

    def _bytes(self, names: list[str]) -> int:
        sizes = [self._path(name) for name in names]
        return sum(fs.getContentSummary(p).getLength() for fs, p in sizes)

    def compact(self, share: float = 0.5) -> bool:
        """Write a new base once the deltas outweigh ``share`` of the last one.

        A base is then rewritten only after deltas of a fixed part of its size were written, so all
        compactions together write a constant multiple of all deltas. Older folders stay for readers
        that hold them; ``expire`` removes them.
        """
        base, deltas = self._since(None)
        if not deltas:
            return False
        written = self._bytes([f"{kind}={n}" for n in deltas for kind in ("seen", "gone")])
        if base is not None and written <= share * self._bytes([f"base={base}"]):
            return False
        self.start(self.current(), deltas[-1])
        return True

    def expire(self) -> None:
        """Remove the folders that the newest base has taken in."""
        bases = self._done("base")
        for kind, known in (("base", bases[:-1]), ("seen", self._done("seen")), ("gone", self.batches())):
            for n in known:
                if bases and n <= bases[-1] and (kind != "base" or n < bases[-1]):
                    fs, p = self._path(f"{kind}={n}")
                    fs.delete(p, True)
