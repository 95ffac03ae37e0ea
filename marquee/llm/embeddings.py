"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is rotated at random and kept as the signs of its coordinates plus the correction factor
<signs, rotated vector>. For another vector q, <signs, rotated q> / factor estimates the cosine without
bias, with an error that concentrates as 1/sqrt(dimensions); pairs whose upper confidence bound misses
the threshold are dropped, all others are recomputed exactly in double precision. Candidate pairs
share the sign bits of at least one of several tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import mapped
from marquee.operators.components import components
from marquee.operators.ranking import checkpointed

#: Rows of a bucket that one task compares; larger buckets are cut into blocks compared pairwise.
BLOCK = 2048
GROUP_ROWS = 12_000


def rotation(d: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(1000 + number).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def table_keys(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Key of every row in every table: ``bits`` signs of rotated coordinates."""
    n, d = unit.shape
    signs = np.concatenate([unit @ rotation(d, k) > 0 for k in range(-(-tables * bits // d))], axis=1)[:, : tables * bits]
    return (signs.reshape(n, tables, bits) << np.arange(bits, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factors) under rotation 0."""
    turned = unit @ rotation(unit.shape[1], 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimates(q: np.ndarray, signs: np.ndarray, factor: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosine of rotated rows ``q`` with coded rows, and the bound on its error."""
    d = q.shape[1]
    est = np.einsum("ij,ij->i", q, signs) / math.sqrt(d) / factor
    return est, sure * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(1, d - 1))


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) within consecutive runs of the given sizes."""
    start = np.cumsum(size) - size
    later = np.repeat(size, size) - (np.arange(size.sum()) - np.repeat(start, size)) - 1
    a = np.repeat(np.arange(size.sum()), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(frame: pd.DataFrame, threshold: float, sure: float) -> pd.DataFrame:
    """Links among the rows of whole buckets: (node, links, root), links weighted by copies.

    A pair counts only in the first table that both rows share.
    """
    frame = frame.sort_values(["t", "key", "i", "j", "block"], kind="stable", ignore_index=True)
    kind = np.float32 if len(frame["vector"].iloc[0]) == 4 * frame["d"].iloc[0] else np.float64
    d = int(frame["d"].iloc[0])
    unit = np.frombuffer(b"".join(frame["vector"]), kind).reshape(-1, d).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ rotation(d, 0)
    signs = np.unpackbits(np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1), axis=1)[:, :d].astype(np.float64) * 2 - 1
    factor, keys = frame["factor"].to_numpy(), np.frombuffer(b"".join(frame["keys"]), np.uint32).reshape(len(frame), -1)
    t, block, weight, node = (frame[c].to_numpy() for c in ("t", "block", "n", "node"))
    same = frame[["t", "key", "i", "j"]].to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]).any(axis=1)]))
    size = np.diff(np.append(edge, len(frame)))
    cross = frame["i"].to_numpy() != frame["j"].to_numpy()
    links, ends = np.zeros(len(frame), np.int64), []
    # Runs are taken together up to a bounded number of pairs; a run is at most two blocks.
    work = np.cumsum(size.astype(np.int64) ** 2)
    lots = np.searchsorted(work, np.arange(0, work[-1] + 1, 2_000_000), side="left")
    for lo, hi in zip(lots, np.append(lots[1:], len(size))):
        if lo == hi:
            continue
        a, b = _pairs(size[lo:hi])
        a, b = a + edge[lo], b + edge[lo]
        keep = ~cross[a] | (block[a] != block[b])
        a, b = a[keep], b[keep]
        for at in range(0, len(a), 200_000):
            x, y = a[at : at + 200_000], b[at : at + 200_000]
            est, error = estimates(turned[x], signs[y], factor[y], sure)
            near = est + error >= threshold
            x, y = x[near], y[near]
            real = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[real], y[real]
            before = np.arange(keys.shape[1])[None, :] < t[x][:, None]
            first = ~((keys[x] == keys[y]) & before).any(axis=1)
            x, y = x[first], y[first]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            ends.append((x, y))
    x, y = (np.concatenate(c) for c in zip(*ends)) if ends else (np.empty(0, int), np.empty(0, int))
    hit = np.unique(np.concatenate([x, y]))
    return pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[_roots(len(frame), x, y)[hit]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, sure: float = 4.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of different lengths. Equal vectors are one node with a weight, so a group of copies costs
    one row. ``recall`` is the chance that a pair exactly at the threshold shares a table; closer pairs
    are found more surely. Rows with repeated vec_id count as vectors of their own. A null vec_id is
    kept; its component is the smallest vec_id that it reaches, or null.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    width = "f4" if kind == "float" else "f8"
    e = F.col("embedding").cast("array<float>" if kind == "float" else "array<double>")
    sound = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, e).alias("e"))
    spark = vectors.sparkSession
    nodes = rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    total = max(2, nodes.count())
    bits = min(30, max(6, math.ceil(math.log2(total)) - 4))
    agree = 1 - math.acos(threshold) / math.pi
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, part in frame.groupby(frame["e"].map(len)):
            raw = np.stack([np.asarray(v, width) for v in part["e"]])
            with np.errstate(over="ignore"):
                top = np.abs(raw.astype(np.float64)).max(axis=1, keepdims=True)
                unit = raw.astype(np.float64) / top
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            keys = table_keys(unit, tables, bits)
            code, factor = codes(unit)
            kept = (unit if width == "f8" else raw).astype(width)
            for t in range(tables):
                out.append(pd.DataFrame({
                    "node": part["node"].to_numpy(), "n": part["n"].to_numpy(), "d": d, "t": t, "key": keys[:, t].astype(np.int64) | (d << 32),
                    "vector": [v.tobytes() for v in kept], "code": [c.tobytes() for c in code], "factor": factor, "keys": [k.tobytes() for k in keys],
                }))
        return pd.concat(out) if out else pd.DataFrame(columns=["node", "n", "d", "t", "key", "vector", "code", "factor", "keys"])

    spread_rows = mapped(nodes.select("node", "n", "e"), spread, "node long, n long, d int, t int, key long, vector binary, code binary, factor double, keys binary")
    hot = spread_rows.groupBy("t", "key").agg(F.count("*").alias("_m")).where(f"_m > {BLOCK}")
    spans = spread_rows.join(hot, ["t", "key"], "left").withColumn("_b", F.coalesce(F.ceil(F.col("_m") / BLOCK), F.lit(1)).cast("int"))
    spans = spans.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    # A block meets itself and every other block of its bucket.
    spans = spans.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    spans = spans.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_m", "_b", "_o")
    groups = max(1, total * tables // GROUP_ROWS)
    spans = spans.withColumn("g", F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(groups)))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compare(part, threshold, sure) for _, part in frame.groupby("d")])

    found = checkpointed(spans.groupBy("g").applyInPandas(work, "node long, links long, root long"))
    parts = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(parts, "node", "left").select("e", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("part", "node").alias("part"))
    low = known.groupBy("part").agg(F.min("least").alias("component_id"))
    named = known.join(low, "part").select("e", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "e", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
