"""SimHash near-duplicates with pivot distance tables.

A fingerprint's coordinates are its Hamming distances to fixed reference fingerprints. Distances obey
the triangle inequality, so two fingerprints within ``limit`` bits differ by at most ``limit`` in every
coordinate; pairs with a larger difference are dropped before the fingerprints are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from marquee.llm.common import partitions, release
from marquee.operators.components import components
from marquee.operators.ranking import checkpointed

#: Reference fingerprints: odd multiples of the golden ratio's 64-bit fraction.
PIVOTS = [((2 * i + 1) * 0x9E3779B97F4A7C15) % 2**64 for i in range(12)]
BLOCKS = 5


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    out = pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")
    release()
    return out


def _keys(fp: Column, limit: int) -> Column:
    """All choices of ``BLOCKS - limit`` of the fingerprint's blocks: a pair within ``limit`` bits shares one."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [(2 ** (b - a) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for n, chosen in enumerate(combinations(masks, BLOCKS - limit)):
        keys.append(F.struct(F.lit(n).cast("byte").alias("t"), fp.bitwiseAND(F.lit(_signed(sum(chosen))).cast("long")).alias("k")))
    return F.explode(F.array(*keys))


def links(prints: DataFrame, limit: int = 2) -> DataFrame:
    """Pairs (u, v) of ``id`` whose distinct ``fp`` differ in at most ``limit`` bits, found once each.

    Candidates share the kept blocks and the cell of their first two distances (a row enters the
    cells its neighbours can lie in), so a hot block is split further by the pivots. The remaining
    coordinates discard pairs; survivors are compared.
    """
    width = 4 * limit
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)).cast("long")))
    rows = prints.select("id", "fp", F.array(*[distance(p).cast("byte") for p in PIVOTS]).alias("d"))
    rows = rows.select("*", _keys(F.col("fp"), limit).alias("b"))
    cell = lambda i, shift=0: F.floor((F.col("d")[i] + shift) / width).cast("int")
    home = rows.select("b", cell(0).alias("c0"), cell(1).alias("c1"), "id", "fp", "d")
    near = rows.select("b", *[F.explode(F.array_distinct(F.array(cell(0, -limit), cell(0, limit)))).alias("c0")], "id", "fp", "d").select(
        "b", "c0", F.explode(F.array_distinct(F.array(cell(1, -limit), cell(1, limit)))).alias("c1"), "id", "fp", "d"
    )
    a, b = home.alias("a"), near.alias("b")
    apart = [F.abs(F.col("a.d")[i] - F.col("b.d")[i]) <= limit for i in range(len(PIVOTS))]
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= limit
    on = (F.col("a.b") == F.col("b.b")) & (F.col("a.c0") == F.col("b.c0")) & (F.col("a.c1") == F.col("b.c1")) & (F.col("a.id") < F.col("b.id"))
    for x in apart:
        on = on & x
    return a.join(b, on & close).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def near_duplicates(docs: DataFrame, limit: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by fingerprints within ``limit`` bits.

    A null or wordless text has fingerprint zero and links like any other. Copies share a
    fingerprint and count as one node, so a group of any size costs one row. Rows with a repeated
    ``doc_id`` keep a row each; rows without ``doc_id`` link like any other and name a component, by null,
    only where it has no doc_id at all. Other columns are ignored; an empty table gives no rows.
    """
    n = partitions(docs.sparkSession)
    whole = docs.select("doc_id", "text")
    prints = checkpointed(whole.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints("text").alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    nodes = checkpointed(nodes.repartition(n, "fp"))
    # Two fingerprints may have the same smallest doc_id only if doc_ids repeat; the fingerprint is the node.
    parts = components(links(nodes.select(F.col("fp").alias("id"), "fp"), limit))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("part", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("id").alias("component_id"))
    of = named.join(least, "part").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
