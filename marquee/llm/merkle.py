"""Merkle manifest of a table: a tree of every source's rows, and a tree of the sources' roots.

Only every ``stride``-th level is stored, as blocks of ``FAN ** stride`` consecutive nodes; a block is the
bottom of one aligned subtree. Building reads a stored level and computes the next one, level by level,
all blocks at once. Proofs go the other way: a block regenerates the missing interior nodes of its
subtree from its stored nodes, emits the siblings on the way of every node to the subtree's top, adds the
siblings from there to the root, which came down from the block above, and forgets the interior again.

All digests are lowercase hex SHA-256. Rows of a source are numbered through a range sort, so a source of
any size is spread over many blocks and tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from marquee.llm.common import partitions, release
from marquee.operators.ranking import checkpointed

FAN, STRIDE = 3, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's FIELDS: each is ``-`` where null, else its UTF-8 byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        value = (text if name == "text" and text is not None else F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def subtree(nodes: list[str], n: int, stride: int = STRIDE) -> list[list[str]]:
    """All levels above a block of a level of ``n`` nodes: ``stride`` of them, fewer where the tree ends before."""
    levels = [nodes]
    for _ in range(stride):
        if n == 1:
            break
        own = levels[-1]
        levels.append([_joined(own[i : i + FAN]) for i in range(0, len(own), FAN)])
        n = -(-n // FAN)
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """(place in the run, the run's other nodes) of node ``i`` on each level up to the top."""
    path = []
    for own in levels[:-1]:
        run = own[i - i % FAN : i - i % FAN + FAN]
        path.append((i % FAN, run[: i % FAN] + run[i % FAN + 1 :]))
        i //= FAN
    return path


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and the siblings on its way give."""
    for at, others in path:
        node = _joined(others[:at] + [node] + others[at:])
    return node


def written(path: list[tuple[int, list[str]]]) -> str:
    """A path as text: ``place:digest,digest;`` for each level."""
    return "".join(f"{at}:{','.join(others)};" for at, others in path)


def parsed(text: str) -> list[tuple[int, list[str]]]:
    levels = [part.split(":") for part in text.split(";")[:-1]]
    return [(int(at), others.split(",") if others else []) for at, others in levels]


def _top(stride: int) -> Column:
    """The node above every block."""

    @F.pandas_udf(StringType())
    def top(nodes: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([subtree(list(x), k, stride)[-1][0] for x, k in zip(nodes, n)], dtype=object)

    return top("digest", "n").alias("digest")


def grow(rows: DataFrame, path: str, stride: int = STRIDE) -> int:
    """Store the levels of all trees at ``path``; how many levels were stored.

    ``rows``: key (of the tree), i (place from 0), n (nodes of the tree), digest, name and claim.
    """
    spark, size = rows.sparkSession, FAN**stride
    most = rows.agg(F.max("n")).first()[0] or 0
    kept = 0
    while True:
        node = F.array_sort(F.collect_list(F.struct("i", "digest", "name", "claim")))
        blocks = rows.groupBy("key", F.expr(f"i DIV {size}").alias("block")).agg(F.max("n").alias("n"), node.alias("x"))
        blocks.select("key", "block", "n", "x.digest", "x.name", "x.claim").write.parquet(f"{path}/{kept}")
        kept += 1
        if most <= size:
            return kept
        stored = spark.read.parquet(f"{path}/{kept - 1}").where(F.col("n") > size)
        nothing = F.lit(None).cast("string")
        rows = stored.select("key", F.col("block").alias("i"), F.expr(f"CAST(ceil(n / {size}) AS BIGINT)").alias("n"), _top(stride), nothing.alias("name"), nothing.alias("claim"))
        most = -(-most // size)


def roots(spark: SparkSession, path: str, kept: int, stride: int = STRIDE) -> DataFrame:
    """(key, digest): the root of every tree, from the level that is one block."""
    out = None
    for k in range(kept):
        own = spark.read.parquet(f"{path}/{k}").where(F.col("n") <= FAN**stride).select("key", _top(stride))
        out = own if out is None else out.union(own)
    return out


_DOWN = "key string, i long, name string, digest string, claim string, path string, top string, root string"


def _descend(frames: Iterator[pd.DataFrame], stride: int) -> Iterator[pd.DataFrame]:
    """Nodes of blocks, each with its siblings up to the root."""
    columns = [c.split()[0] for c in _DOWN.split(", ")]
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            levels = subtree(list(r.digest), r.n, stride)
            top = levels[-1][0] if r.top is None else r.top
            for c, (digest, name, claim) in enumerate(zip(r.digest, r.name, r.claim)):
                out.append((r.key, r.block * FAN**stride + c, name, digest, claim, written(siblings(levels, c)) + r.path, top, top if r.root is None else r.root))
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)
    release()


def descend(spark: SparkSession, path: str, kept: int, above: DataFrame | None, stride: int = STRIDE) -> DataFrame:
    """Every node of the lowest level with its path: (key, i, name, digest, claim, path, top, root).

    ``above`` has key, path and root of trees that are part of a larger one; None where a tree's top is
    the root.
    """
    nothing, size = F.lit(None).cast("string"), FAN**stride
    down = None
    for k in reversed(range(kept)):
        blocks = spark.read.parquet(f"{path}/{k}")
        whole, part = blocks.where(F.col("n") <= size), blocks.where(F.col("n") > size)
        if above is None:
            rows = whole.select("*", F.lit("").alias("path"), nothing.alias("top"), nothing.alias("root"))
        else:
            rows = whole.join(above.select("key", "path", nothing.alias("top"), "root"), "key")
        if down is not None:
            rows = rows.unionByName(part.join(down.select("key", F.col("i").alias("block"), "path", "top", "root"), ["key", "block"]))
        down = rows.select("key", "block", "n", "digest", "name", "claim", "path", "top", "root").mapInPandas(lambda frames: _descend(frames, stride), _DOWN)
    return down


class Manifest:
    """A stored manifest: ``rows`` and ``sources`` levels under ``path``."""

    def __init__(self, spark: SparkSession, path: str, rows: int, sources: int, stride: int = STRIDE):
        self.spark, self.path, self.rows, self.sources, self.stride = spark, path, rows, sources, stride

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, claim, subroot, root, path) of every row.

        ``path`` holds the siblings from the leaf to the root as ``place:digest,digest;`` for each level.
        """
        above = descend(self.spark, f"{self.path}/sources", self.sources, None, self.stride).select(F.col("name").alias("key"), "path", "root")
        rows = descend(self.spark, f"{self.path}/rows", self.rows, above, self.stride)
        return rows.select(F.col("name").cast("long").alias("doc_id"), F.col("digest").alias("leaf"), "claim", F.col("top").alias("subroot"), "root", "path")

    def audit(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

        ``folded_root`` is the root that the row as claimed gives with the stored siblings.
        """
        proofs = self.proofs()
        folded = proofs.select("doc_id", "leaf", "subroot", "root", _proof("path").alias("proof_sha256"), _folded(F.coalesce("claim", "leaf"), "path").alias("folded_root"))
        return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@F.pandas_udf(StringType())
def _proof(paths: pd.Series) -> pd.Series:
    return pd.Series([_joined([x for _, others in parsed(p) for x in others]) for p in paths], dtype=object)


@F.pandas_udf(StringType())
def _folded(nodes: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([fold(x, parsed(p)) for x, p in zip(nodes, paths)], dtype=object)


def build(docs: DataFrame, path: str, claimed: Column | None = None, stride: int = STRIDE) -> Manifest:
    """Write the manifest of ``docs`` to the shared folder ``path``.

    ``claimed``: the text as it is found at the audit, where that isn't the text of the row. A source's
    leaves ascend by doc_id, null first; rows of one doc_id ascend by leaf, and equal rows have equal
    leaves, so their order doesn't matter. Null sources are a tree of their own, before all others. An
    empty table has a manifest without rows. Columns besides FIELDS are ignored.
    """
    spark = docs.sparkSession
    # Not null, and in the order of sources: null, then by bytes.
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    own = leaf()
    claim = F.lit(None).cast("string") if claimed is None else F.nullif(leaf(claimed), own)
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("name"), own.alias("digest"), claim.alias("claim"))
    kept = grow(_numbered(rows, ["key"], [F.col("name").asc_nulls_first(), F.col("digest"), F.col("claim")]), f"{path}/rows", stride)
    tops = roots(spark, f"{path}/rows", kept, stride).select(F.lit("").alias("key"), F.col("key").alias("name"), "digest", F.lit(None).cast("string").alias("claim"))
    sources = grow(_numbered(tops, ["key"], [F.col("name")]), f"{path}/sources", stride)
    return Manifest(spark, path, kept, sources, stride)


def _numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Places from 0 in each tree and the size of the tree; names as text.

    A range sort by tree and order numbers each partition; the rows of earlier partitions and of the whole
    tree are added by (tree, partition), so the rows of one large tree never meet in one task.
    """
    parts = partitions(rows.sparkSession)
    ranged = checkpointed(rows.repartitionByRange(parts, *keys, *order).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    # One row for each tree and partition.
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(*keys, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("n"))
    own = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(*order)) - 1)
    return own.join(sums, [*keys, "_pid"]).select(*keys, (F.col("_i") + F.col("_before")).alias("i"), "n", "digest", F.col("name").cast("string").alias("name"), "claim")


def tampered() -> Column:
    """The text without its line ends, where crc32(doc_id) is even."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
