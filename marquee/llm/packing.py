"""Bulk-synchronous best-fit packing of documents into sequences of a fixed length.

Lengths and gaps are whole numbers up to the sequence length, so the range-sorted list of either is a
list of at most that many runs of equal size, whatever the number of documents. A round sweeps the
runs of documents from the longest down, matches each with the successor run of gaps (the smallest
that holds it), settles conflicts by rank in the run, and updates the gaps; rounds repeat until no
documents are left. Rows get their rank by a distributed range sort and their place by a join with
the matched rank intervals; no row passes through the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import release
from marquee.llm.tokens import default_tokenizer, encoder
from marquee.operators.ranking import checkpointed, positions

PIECES = "doc_id long, row long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """Pieces of at most ``limit`` ids of every document; a null text is the end id alone.

    ``row`` tells rows with equal doc_id apart. Rows without doc_id are kept with a null doc_id.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for frame in frames:
            out, names = [], []
            for doc_id, row, ids in zip(frame["doc_id"], frame["row"], encode.batch(frame["text"])):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for n, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    names.append(None if pd.isna(doc_id) else int(doc_id))
                    out.append((row, n, at, len(part), zlib.crc32(part.tobytes())))
            found = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            found.insert(0, "doc_id", pd.array(names, "Int64"))
            yield found
        release()

    # Ids go as strings, as whole numbers beside nulls would reach Python as inexact floats.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInPandas(run, PIECES)


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rank intervals (length, first rank, last rank, sequences of the group from, copies, offset).

    ``counts`` are documents by length. A group is a range of sequences with equal content; a matched
    interval takes sequences ``from``, ``from + 1``, ... in rank order, ``copies`` documents in each.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups (first sequence, how many)
    sizes: list[int] = []
    opened, out = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 1, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:  # no gap holds it: the documents left open sequences, as full of their own kind as they can be
                gap, first = limit, opened
                n = -(-left // (limit // length))
                opened += n
            # Best fit one at a time would return to the same gap while it stays the smallest that fits.
            after = sizes[at] if at < len(sizes) and gap != limit else limit + 1
            copies = min(gap // length, left) if gap <= after else 1
            use = min(n, left // copies)
            if use == 0:
                copies, use = left, 1
            out.append((length, rank, rank + use * copies - 1, first, copies, limit - gap))
            rank, left = rank + use * copies, left - use * copies
            put(gap - copies * length, first, use)
            if gap < limit or n > use:
                put(gap, first + use, n - use)
    return out


def packed(parts: DataFrame, limit: int = 2048) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: every piece placed, sequences gapless from 0.

    Ties of length are ranked by (doc_id, row, piece). An empty table stays empty. Extra columns stay.
    """
    spark = parts.sparkSession
    parts = checkpointed(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    ranked = positions(parts, ["length"], [F.col("doc_id"), F.col("row"), F.col("piece")], "_rank")
    schema = "length int, _from long, _to long, _first long, _copies int, _at int"
    found = spark.createDataFrame(plan(counts, limit), schema)
    step = F.col("_rank") - F.col("_from")
    return (
        ranked.join(found, "length")
        .where("_rank between _from and _to")
        .withColumn("sequence_id", F.col("_first") + F.floor(step / F.col("_copies")))
        .withColumn("offset", F.col("_at") + (step % F.col("_copies")) * F.col("length"))
        .drop("_rank", "_from", "_to", "_first", "_copies", "_at")
    )


def pack(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """Pieces of all documents in as few sequences as best fit needs."""
    out = packed(pieces(docs, limit, tokenizer, end), limit)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
