"""Connected components over shared keys, in logarithmic rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marquee.operators.ranking import checkpointed


def star_edges(membership: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Edges (u, v) from every node of a key to the key's smallest node.

    Linear in the membership: a key with many nodes gives a star, never all pairs. Keys held by
    one node give nothing.
    """
    hub = membership.groupBy(key).agg(F.min(node).alias("_hub"), F.max(node).alias("_top")).where("_hub < _top")
    return (
        membership.join(hub.select(key, "_hub"), key)
        .where(F.col(node) != F.col("_hub"))
        .select(F.col(node).alias("u"), F.col("_hub").alias("v"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, part) for every node of an edge; ``part`` is the smallest node of its component.

    Alternating large-star and small-star rounds. Each round is aggregates and one equi-join;
    its result is checkpointed, so a lost executor never replays earlier rounds. The rounds end when
    the edges are stars: every node has one smaller neighbour, which has none itself.
    """
    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _stars(e):
        # Large star: larger neighbours of every node move to the smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = checkpointed(moved.union(low2.select("u", F.col("m").alias("v"))).distinct())
    members = e.select(F.col("u").alias("node"), F.col("v").alias("part"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct()
    return members.union(roots)


def _stars(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1")
    return odd.isEmpty()
