"""Token-id files compressed by Re-Pair grammars.

A shard holds the ids of consecutive documents as one sequence. Frequent pairs of neighbouring
symbols are repeatedly replaced by nonterminals until no pair is frequent; the rules, the length every
symbol expands to and the reduced sequence are stored. Running sums of the lengths give the place of
any document, so it is decoded alone. Files are Parquet rows of shards in a folder that all executors
share; file names, shards in a file and documents in a shard all ascend by doc_id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.llm.common import partitions, release
from marquee.llm.tokens import default_tokenizer, encoder
from marquee.operators.ranking import ensure_checkpoint_dir

SHARD_IDS = 250_000
#: Occurrences that pay for a rule, which costs two symbols and a length.
LEAST = 5
BATCH = 256


def _counted(left: np.ndarray, right: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as ascending left * top + right, their counts, their places: ascending for each pair in turn)."""
    bits = int(at[-1]).bit_length() if len(at) else 0
    pair = left * top + right
    if 2 * top.bit_length() + bits <= 63:
        # Pair and place in one number: its sort needs no order of places beside it.
        pair = np.sort(pair << bits | at)
        place = pair & ((1 << bits) - 1)
        pair >>= bits
    else:
        order = np.argsort(pair, kind="stable")
        pair, place = pair[order], at[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else at
    return pair[first], np.diff(np.append(first, len(pair))), place


#: Passes over all places before the rest is taken as a list; what they leave is the same list, shorter.
PASSES = 3


def _chosen(at: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places below ``n`` of pairs to replace, none overlapping the next, and their weights: the heavier pair first, then the earlier one.

    Where most places count, those heavier than both their neighbours are taken at once and what they overlap goes.
    """
    own = np.zeros(n + 2, np.int32)
    own[at + 1] = weight
    picked = np.zeros(n, bool)
    if 8 * len(at) > n:
        left = own.copy()
        for _ in range(PASSES):
            taken = np.flatnonzero((left[1:-1] > left[:-2]) & (left[1:-1] > left[2:]))
            picked[taken] = True
            left[taken] = left[taken + 1] = left[taken + 2] = 0
        at = np.flatnonzero(left[1:-1] > 0)
    else:
        at = np.sort(at)
    for taken in _stretches(at, own[at + 1]):
        picked[taken] = True
    out = np.flatnonzero(picked)
    return out, own[out + 1]


def _stretches(at: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """The same for a list of places, which may hold stretches of one weight.

    A stretch of equal weights that no heavier neighbour touches gives every other place from its start on;
    what they overlap goes, and the rest is looked at again.
    """
    out = []
    while len(at):
        near = np.diff(at) == 1
        edge = np.concatenate([[True], ~near | (weight[1:] != weight[:-1])])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(at)) - 1
        below_left = (first == 0) | ~np.concatenate([[False], near])[first] | (weight[first - 1] < weight[first])
        after = np.minimum(last + 1, len(at) - 1)
        below_right = (last == len(at) - 1) | ~np.append(near, False)[last] | (weight[after] < weight[last])
        stretch = np.cumsum(edge) - 1
        own = (below_left & below_right)[stretch] & ((at - at[first][stretch]) % 2 == 0)
        taken = at[own]
        out.append(taken)
        gone = own.copy()
        gone[1:] |= own[:-1] & near
        gone[:-1] |= own[1:] & near
        at, weight = at[~gone], weight[~gone]
    return out


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(reduced sequence, rules as rows of two symbols, expansion length of every rule, first nonterminal).

    A round counts neighbouring pairs and gives each one that is seen ``least`` times a nonterminal, the
    most frequent first, also where occurrences overlap. Every frequent pair's places are then replaced or
    overlapped by a replaced one, so later rounds count only pairs with a nonterminal of the round before;
    the rounds end when none of them is frequent.
    """
    seq = ids.astype(np.int64)
    base = top = int(seq.max()) + 1 if len(seq) else 1
    size = np.ones(base, np.int64)
    rules, fresh = [], 0
    while len(seq) > 1:
        if fresh:
            new = seq >= fresh
            at = np.flatnonzero(new[:-1] | new[1:])
            pairs, count, place = _counted(seq[at], seq[at + 1], at, top)
        else:
            pairs, count, place = _counted(seq[:-1], seq[1:], np.arange(len(seq) - 1), top)
        often = count >= least
        if not often.any():
            break
        # Indices, as numpy takes them several times faster than a mask of long and short runs.
        place = place[np.flatnonzero(np.repeat(often, count))]
        pairs, count = pairs[often], count[often]
        order = np.argsort(-count, kind="stable")
        # A pair's weight tells it from all others, so a stretch of one weight is a stretch of one pair.
        weight = np.empty(len(pairs), np.int32)
        weight[order] = np.arange(len(pairs), 0, -1, np.int32)
        picked, rank = _chosen(place, np.repeat(weight, count), len(seq) - 1)
        rank = len(pairs) - rank
        # Names only for pairs that are left with a place of their own.
        used = np.zeros(len(pairs), bool)
        used[rank] = True
        rule = np.stack(np.divmod(pairs[order[used]], top), axis=1)
        rules.append(rule)
        size = np.concatenate([size, size[rule].sum(axis=1)])
        seq[picked] = top + (np.cumsum(used) - 1)[rank]
        stays = np.ones(len(seq), bool)
        stays[picked + 1] = False
        seq = seq[np.flatnonzero(stays)]
        fresh, top = top, top + len(rule)
    flat = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return seq.astype(np.uint32), flat.astype(np.uint32), size[base:].astype(np.uint32), base


class Shard:
    """A stored shard: ``read(start, n)`` decodes ``n`` ids from ``start`` without the rest."""

    def __init__(self, seq: bytes, rules: bytes, lengths: bytes, base: int):
        self.seq = np.frombuffer(seq, "<u4").astype(np.int64)
        self.rules = np.frombuffer(rules, "<u4").astype(np.int64).reshape(-1, 2)
        self.base = base
        self.size = np.concatenate([np.ones(base, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)])
        self.stop = np.cumsum(self.size[self.seq])

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """Ids of the symbols: each goes to its place at once, only nonterminals are looked at again."""
        size = self.size[seq]
        at = np.cumsum(size)
        out = np.empty(int(at[-1]), "<u4")
        at -= size
        while len(seq):
            big = seq >= self.base
            small = np.flatnonzero(~big)
            out[at[small]] = seq[small]
            big = np.flatnonzero(big)
            at, rule = at[big], self.rules[seq[big] - self.base]
            seq = rule.ravel()
            at = np.stack([at, at + self.size[rule[:, 0]]], axis=1).ravel()
        return out

    def read(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.empty(0, "<u4")
        a, b = np.searchsorted(self.stop, [start, start + n - 1], side="right")
        skip = start - (self.stop[a] - self.size[self.seq[a]])
        return self._expand(self.seq[a : b + 1])[skip : skip + n]


SHARDS = "pid int, shard int, first long, named int, doc_ids binary, counts binary, base int, seq binary, rules binary, lengths binary"


def _range(cuts: list[int], low: int) -> Column:
    """Number of the range, from ``low`` on, that a doc_id lies in: a binary search over the cuts."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(F.col("doc_id") <= cuts[mid], _range(cuts[:mid], low)).otherwise(_range(cuts[mid + 1 :], low + mid + 1))


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) in ascending doc_id order over partitions, null last; bounds come from doc_id alone."""
    n = partitions(docs.sparkSession)
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] if n > 1 else None
    ranges = docs.withColumn("pid", _range(sorted(set(cuts or [])), 0).cast("int"))
    return ranges.repartitionById(n, "pid").sortWithinPartitions(F.col("doc_id").asc_nulls_last())


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents in ascending ``doc_id`` order to shard files at ``path``.

    Null and empty texts give the end id alone. Repeated doc_ids stay as rows of their own, in any
    order among themselves; rows without doc_id come after all others, in any order. A document longer
    than a shard gets one of its own.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        pid, shard, first, held, names, size = None, 0, 0, [], [], 0

        def flush() -> pd.DataFrame:
            seq, rules, lengths, base = compress(np.concatenate(held))
            counts = np.fromiter(map(len, held), "<u4", len(held))
            own = np.array([int(x) for x in names if x is not None], "<i8")
            row = (pid, shard, first, len(own), own.tobytes(), counts.tobytes(), base, seq.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes())
            return pd.DataFrame([row], columns=[c.split()[0] for c in SHARDS.split(", ")])

        for frame in frames:
            for p, doc_id, ids in zip(frame["pid"], frame["doc_id"], encode.batch(frame["text"])):
                if held and size + len(ids) + 1 > shard_ids:
                    yield flush()
                    shard, first = shard + 1, first + size
                    held, names, size = [], [], 0
                pid = p
                held.append(np.append(ids, np.uint32(end)))
                names.append(doc_id)
                size += len(ids) + 1
        if held:
            yield flush()
        release()

    rows = _ordered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # As a string, as a column of whole numbers and nulls would pass through pandas as inexact floats.
    rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, SHARDS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary) of every document, decoded from the files."""
    return _decoded(spark, path, "doc_id string, start long, ids binary", lambda d, s, x: (d, s, x.tobytes()))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    return _decoded(spark, path, "doc_id string, start long, n_tokens long, ids_crc32 long", lambda d, s, x: (d, s, len(x), zlib.crc32(x.tobytes())))


def _decoded(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(path)
    # One total per range of doc_ids: as many rows as partitions were written.
    ends = shards.groupBy("pid").agg(F.max(F.struct("first", F.expr("length(counts)").alias("n"), "counts")).alias("last")).select("pid", "last.*")
    ends = [(r["pid"], r["first"] + int(np.frombuffer(r["counts"], "<u4").sum())) for r in ends.collect()]
    before, total = {}, 0
    for pid, n in sorted(ends):
        before[pid], total = total, total + n
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                stored = Shard(row.seq, row.rules, row.lengths, row.base)
                counts = np.frombuffer(row.counts, "<u4").astype(np.int64)
                names = [*map(str, np.frombuffer(row.doc_ids, "<i8").tolist()), *[None] * (len(counts) - row.named)]
                starts = np.cumsum(counts) - counts
                out = []
                # Documents are decoded by random access, a few at a time.
                for at in range(0, len(counts), BATCH):
                    ids = stored.read(int(starts[at]), int(counts[at : at + BATCH].sum()))
                    for doc_id, start, n in zip(names[at : at + BATCH], starts[at : at + BATCH].tolist(), counts[at : at + BATCH].tolist()):
                        own = ids[start - starts[at] : start - starts[at] + n]
                        out.append(make(doc_id, before[row.pid] + row.first + start, own))
                yield pd.DataFrame(out, columns=columns)
        release()

    return shards.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
