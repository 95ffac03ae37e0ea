"""Runs of text that repeat in other documents: distributed routing around a per-shard index.

Every window of ``size`` units (bytes or words) has a minimizer, the least hash of the short grams in
it; equal windows have equal minimizers. Consecutive windows with one minimizer form a run. Four steps:

1. Documents are dealt to sources by a hash of doc_id. Each source sends the distinct minimizers of its
   documents to key buckets, a few bytes each.
2. A bucket answers which of them occur in more than one document, and which are hot.
3. A source sends the runs of repeated minimizers, each distinct run once with its least doc_id, to the
   shard of the minimizer. A shard so holds all occurrences of its windows. It is dealt into parts by
   minimizer, and the index of a part finds the least doc_id of every window. Windows of hot minimizers are sent one by one to the shard of the window, so
   no shard holds all surroundings of a frequent passage. A minimizer is hot by its distinct runs, as
   copies of one run are one text of a source: a passage that repeats with its surroundings stays whole.
4. The answers return to the sources, where windows with a smaller doc_id elsewhere cover their units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import partitions, release
from marquee.llm.repair import folder
from marquee.llm.words import CODES, STEP, keyed, lots, mix, run_keys, span_keys

#: Bytes of text of a source, and of runs of a shard; memory of a task follows them, not the input.
SOURCE_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
#: Bytes of text behind one index of a shard: its arrays stay small, and so do the rows from each source to each shard.
PART_BYTES = 5 << 16
LEAST_BYTES = 1 << 18
#: Distinct runs, summed over sources, from which a minimizer counts as hot. Copies of one run are one text to a shard.
HOT = 4096
KEY_BYTES = 6
#: Bytes of text whose hashes are made at once: the arrays stay in the processor's cache.
LOT = 1 << 16
_packer, _unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


class Bytes:
    """Windows of 50 bytes."""

    size, gram = 50, 16

    @staticmethod
    def units(raw: bytes) -> int:
        return len(raw)

    @classmethod
    def lots(cls, raws):
        """(texts, unit counts, hash of the gram at every unit, word spans, code of every unit) of a lot of texts."""
        for lot in lots(raws, LOT):
            data = b"".join(lot) + bytes(cls.gram + 8)
            n = len(data) - cls.gram - 8
            eight = np.empty(n + cls.gram, np.uint64)
            for r in range(8):
                part = np.frombuffer(data, "<u8", count=(len(data) - r) // 8, offset=r)
                eight[r::8] = part[: len(eight[r::8])]
            h = mix(eight[:n] * np.uint64(STEP) + mix(eight[8 : n + 8]))
            yield lot, np.fromiter(map(len, lot), np.int64, len(lot)), h, None, CODES[np.frombuffer(data, np.uint8, n)]

    @staticmethod
    def counts(raws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, raws), np.int64, len(raws))

    @staticmethod
    def cut(raw: bytes, spans, a: int, b: int) -> bytes:
        return raw[a:b]

    @staticmethod
    def kept(raw: bytes, spans, covered: np.ndarray) -> bytes:
        return np.frombuffer(raw, np.uint8)[~covered].tobytes()


class Words:
    """Windows of 13 words."""

    size, gram = 13, 4

    @classmethod
    def lots(cls, raws):
        for lot in lots(raws):
            counts, keys, spans = [], [], []
            for _, starts, ends, own in keyed(lot):
                counts.append(len(own))
                keys.append(own)
                spans.append((starts, ends))
            keys = np.concatenate(keys)
            h = np.zeros(len(keys), np.uint64)
            grams = run_keys(keys, cls.gram)
            h[: len(grams)] = grams
            yield lot, np.array(counts, np.int64), h, spans, keys

    @staticmethod
    def counts(raws: list[bytes]) -> np.ndarray:
        return np.fromiter((len(raw.split()) for raw in raws), np.int64, len(raws))

    @staticmethod
    def cut(raw: bytes, spans, a: int, b: int) -> bytes:
        return b" ".join(raw[spans[0][a] : spans[1][b - 1]].split())

    @staticmethod
    def kept(raw: bytes, spans, covered: np.ndarray) -> bytes:
        words = raw.split()
        return b" ".join(w for w, c in zip(words, covered.tolist()) if not c)


def runs(h: np.ndarray, counts: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer hash) of every run in concatenated documents of ``counts`` units."""
    n, width = len(h), size - gram + 1
    if n < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    low, span = h, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    low = low[: n - size + 1]
    stop = np.repeat(np.cumsum(counts), counts)[: n - size + 1]
    first = np.flatnonzero(np.arange(size, n + 1) <= stop)
    if not len(first):
        return first, first, np.empty(0, np.uint64)
    # The leftmost least gram is another one where the least hash changes, or where it stood first and left.
    turn = np.ones(len(low), bool)
    turn[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
    gap = np.concatenate([[True], first[1:] != first[:-1] + 1])
    edge = np.flatnonzero(gap | turn[first])
    # Minima crowd at the low end; mixed, they spread evenly over buckets.
    return first[edge], np.diff(np.append(edge, len(first))), mix(low[first[edge]])


def _raws(frame: pd.DataFrame) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in frame["text"]]


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    """One order of a source's rows for all steps; equal rows are interchangeable."""
    return frame.assign(text=frame["text"].where(frame["text"].notna(), None), _t=frame["text"].fillna("")).sort_values(["doc_id", "_t"], kind="stable", ignore_index=True).drop(columns="_t")


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


class _Source:
    """Runs of one source's documents, in the fixed order."""

    def __init__(self, frame: pd.DataFrame, unit):
        frame = _sorted(frame)
        self.doc_ids = frame["doc_id"].to_numpy(np.int64)
        doc, start, windows, keys, names, self.raws, self.spans = [], [], [], [], [], [], []
        base = 0
        for lot, counts, h, spans, codes in unit.lots(_raws(frame)):
            first, n, key = runs(h, counts, unit.size, unit.gram)
            ends = np.cumsum(counts)
            own = np.searchsorted(ends, first, side="right")
            doc.append(own + base)
            start.append(first - (ends - counts)[own])
            windows.append(n)
            keys.append(key)
            names.append(span_keys(codes, first, first + n - 1 + unit.size))
            self.raws += lot
            self.spans += spans if spans is not None else [None] * len(lot)
            base += len(lot)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.doc, self.start, self.windows, self.keys = join(doc, np.int64), join(start, np.int64), join(windows, np.int64), join(keys, np.uint64)
        # Keys of the runs' texts.
        self.names = join(names, np.uint64)


def _announce(frame: pd.DataFrame, unit, buckets: int) -> pd.DataFrame:
    """Step 1: (bucket, src, keys, seen) of a source."""
    own = _Source(frame, unit)
    src = int(frame["src"].iloc[0])
    order = np.argsort(own.keys)
    sorted_keys = own.keys[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(order) else order
    keys = sorted_keys[edge]
    ids = own.doc_ids[own.doc][order]
    apart = np.minimum.reduceat(ids, edge) < np.maximum.reduceat(ids, edge) if len(order) else np.empty(0, bool)
    # Distinct runs of a key: a first one, and those that differ from the one before when sorted by text.
    size = np.diff(np.append(edge, len(order)))
    several = np.flatnonzero(np.repeat(size > 1, size))
    of, names = np.repeat(np.arange(len(edge)), size)[several], own.names[order[several]]
    by_name = np.lexsort((names, of))
    of, names = of[by_name], names[by_name]
    count = 1 + np.bincount(of[1:][(of[1:] == of[:-1]) & (names[1:] != names[:-1])], minlength=len(edge))
    # Bit 7: in several documents here; below: the power of two of its distinct runs.
    seen = np.log2(count).astype(np.uint8) | np.where(apart, 128, 0).astype(np.uint8)
    bucket = _bucket(keys, buckets)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(b, src, _pack(keys[lo:hi]), seen[lo:hi].tobytes()) for b, lo, hi in zip(range(buckets), cuts, cuts[1:]) if lo < hi]
    return pd.DataFrame(rows, columns=["bucket", "src", "keys", "seen"])


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Step 2: (src, bucket, repeated, hot) bits in the order of each source's keys."""
    frame = frame.sort_values("src", ignore_index=True)
    parts = [_unpack(k) for k in frame["keys"]]
    keys, seen = np.concatenate(parts), np.frombuffer(b"".join(frame["seen"]), np.uint8)
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    size = np.diff(np.append(edge, len(keys)))
    several = np.maximum.reduceat(seen[order] >> 7, edge).astype(bool)
    total = np.add.reduceat(np.left_shift(1, (seen[order] & 127).astype(np.int64)), edge)
    repeated, hot = np.empty(len(keys), bool), np.empty(len(keys), bool)
    repeated[order] = np.repeat((size > 1) | several, size)
    hot[order] = np.repeat(total >= HOT, size)
    cuts = np.cumsum([0, *map(len, parts)])
    rows = [(src, b, np.packbits(repeated[lo:hi]).tobytes(), np.packbits(hot[lo:hi]).tobytes()) for src, b, lo, hi in zip(frame["src"], frame["bucket"], cuts, cuts[1:])]
    return pd.DataFrame(rows, columns=["src", "bucket", "repeated", "hot"])


def _squeeze(raw: bytes) -> bytes:
    return _packer.compress(raw)


def _expand(raw: bytes) -> bytes:
    return _unpacker.decompress(raw)


SENT = "kind int, src int, g int, texts binary, lengths binary, low binary, counts binary, places binary"


def _send(frame: pd.DataFrame, answers: pd.DataFrame, unit, shards: int, parts: int) -> pd.DataFrame:
    """Step 3: distinct runs by shard (kind 0), in the order of its parts, and where they occur in the source (kind 1)."""
    columns = [c.split()[0] for c in SENT.split(", ")]
    if not len(frame) or not len(answers):
        return pd.DataFrame(columns=columns)
    own = _Source(frame, unit)
    src = int(frame["src"].iloc[0])
    keys, inverse = np.unique(own.keys, return_inverse=True)
    answers = answers.sort_values("bucket")
    size = np.bincount(_bucket(keys, int(answers["buckets"].iloc[0])))
    size = size[size > 0]
    bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(answers[c], size)]).astype(bool)
    repeated, hot = bits("repeated")[inverse], bits("hot")[inverse]
    plain, split = np.flatnonzero(repeated & ~hot), np.flatnonzero(repeated & hot)
    # A hot run becomes windows, each a text of its own.
    many = own.windows[split]
    each = np.repeat(split, many)
    step = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    run = np.concatenate([plain, each])
    start = np.concatenate([own.start[plain], own.start[each] + step])
    stop = start + np.concatenate([own.windows[plain], np.ones(len(each), np.int64)]) - 1 + unit.size
    place = own.doc[run]

    def cut(i: np.ndarray) -> list[bytes]:
        return [unit.cut(own.raws[d], own.spans[d], a, b) for d, a, b in zip(place[i].tolist(), start[i].tolist(), stop[i].tolist())]

    name = own.names[run]
    shard = _bucket(mix(own.keys[run]), shards * parts)
    window_texts = cut(np.arange(len(plain), len(run)))
    digest = np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in window_texts]), "<u8")
    name[len(plain) :] = digest
    shard[len(plain) :] = _bucket(digest, shards * parts)
    del window_texts
    _, first, of = np.unique(name, return_index=True, return_inverse=True)
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, of, own.doc_ids[place])
    group = shard[first]
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    group, part = np.divmod(group[order], parts)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
    chosen = cut(first[order])
    lengths = np.fromiter(map(len, chosen), "<u4", len(chosen))
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).tolist()
    texts, lengths, low = b"".join(chosen), lengths.tobytes(), low[order].astype("<i8").tobytes()
    rows = [(0, src, g, _squeeze(texts[ends[lo] : ends[hi]]), lengths[4 * lo : 4 * hi], low[8 * lo : 8 * hi], np.bincount(part[lo:hi], minlength=parts).astype("<u4").tobytes(), None) for g, lo, hi in zip(group[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(group)])]
    spots = np.stack([place, start, rank[of]], axis=1)
    rows.append((1, src, -1, None, None, None, None, _squeeze(spots.astype("<i4").tobytes())))
    return pd.DataFrame(rows, columns=columns)


def _resolve(frame: pd.DataFrame, index: Callable, size: int) -> pd.DataFrame:
    """Step 3 in a shard: the least doc_id of every window of every run, by source.

    A shard's runs fall into parts that share no minimizer, and so no window; ``index(texts, low)`` gives
    for each distinct run of a part an array of the least doc_id of its windows.
    """
    frame = frame.sort_values("src", ignore_index=True)
    texts, sizes = [], []
    for raw, lengths in zip(frame["texts"], frame["lengths"]):
        raw, ends = _expand(raw), np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64)).tolist()
        texts += [raw[a:b] for a, b in zip([0, *ends], ends)]
        sizes.append(len(ends))
    of, names = pd.factorize(np.fromiter(texts, object, len(texts)))
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, of, np.frombuffer(b"".join(frame["low"]), "<i8"))
    counts = np.stack([np.frombuffer(c, "<u4") for c in frame["counts"]]).astype(np.int64)
    part = np.empty(len(names), np.int64)
    part[of] = np.repeat(np.tile(np.arange(counts.shape[1]), len(counts)), counts.ravel())
    order = np.argsort(part, kind="stable")
    found, many = [], np.empty(len(names), np.int64)
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        values, ends = index(names[own].tolist(), least[own])
        found.append(values)
        many[own] = np.diff(ends, prepend=0)
    found = np.concatenate(found)
    starts = np.empty(len(names), np.int64)
    starts[order] = np.cumsum(many[order]) - many[order]
    rows, at = [], 0
    for src, g, count in zip(frame["src"], frame["g"], sizes):
        pick = of[at : at + count]
        at += count
        n = many[pick]
        stop = np.cumsum(n)
        values = found[np.arange(stop[-1]) + np.repeat(starts[pick] - (stop - n), n)]
        rows.append((src, g, n.astype("<u2").tobytes(), _squeeze(values.astype("<i8").tobytes())))
    return pd.DataFrame(rows, columns=["src", "g", "n", "values"])


def covered(frame: pd.DataFrame, back: pd.DataFrame, unit):
    """Step 4: (doc_id, raw bytes, None, mask of covered units) of a source's sorted documents."""
    doc_ids = frame["doc_id"].to_numpy(np.int64)
    spots = [np.frombuffer(_expand(p), "<i4").reshape(-1, 3) for p in back["places"] if p is not None]
    spots = spots[0].astype(np.int64) if spots else np.empty((0, 3), np.int64)
    back = back[back["g"] >= 0].sort_values("g")
    n = np.frombuffer(b"".join(back["n"]), "<u2").astype(np.int64)
    values = np.frombuffer(b"".join(map(_expand, back["values"])), "<i8")
    starts = np.cumsum(n) - n
    raws = _raws(frame)
    counts = unit.counts(raws)
    begin = np.cumsum(counts) - counts
    many = n[spots[:, 2]]
    stop = np.cumsum(many)
    rep = np.repeat(np.arange(len(spots)), many)
    step = np.arange(len(rep))
    step -= (stop - many)[rep]
    hit = values[starts[spots[:, 2]][rep] + step] < doc_ids[spots[:, 0]][rep]
    window = ((begin[spots[:, 0]] + spots[:, 1])[rep] + step)[hit]
    # A window counts once, and no window leaves its text, so all texts are covered at once.
    edge = np.zeros(int(counts.sum()) + 1, np.int8)
    edge[window] = 1
    edge[window + unit.size] -= 1
    mask = np.cumsum(edge, dtype=np.int8) > 0
    for doc_id, raw, a, size in zip(doc_ids.tolist(), raws, begin.tolist(), counts.tolist()):
        yield doc_id, raw, None, mask[a : a + size]


def _light(work: Callable, sides: int = 1) -> Callable:
    """``work`` on a group, after which the worker gives its memory back."""

    def one(a: pd.DataFrame) -> pd.DataFrame:
        try:
            return work(a)
        finally:
            release()

    def two(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        try:
            return work(a, b)
        finally:
            release()

    return one if sides == 1 else two


def marked(docs: DataFrame, unit, index: Callable, make: Callable, schema: str, beside: list[str] = ()) -> DataFrame:
    """``make(doc_id, raw, spans, mask)`` rows of all documents with a doc_id.

    ``docs`` has doc_id and text. Null texts are empty. Columns ``beside`` come along unchanged.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # As many groups as there are partitions to fill, but none of less than LEAST_BYTES for it.
    spread = min(partitions(spark), total // LEAST_BYTES)
    sources, shards = max(1, total // SOURCE_BYTES, spread), max(1, total // SHARD_BYTES, spread)
    src = F.pmod(F.xxhash64("doc_id"), F.lit(sources)).cast("int").alias("src")
    sourced = rows.select("doc_id", "text", src)
    columns = [c.split()[0] for c in schema.split(", ")]

    parts = max(1, SHARD_BYTES // PART_BYTES)
    announced = sourced.groupBy("src").applyInPandas(_light(lambda f: _announce(f, unit, sources)), "bucket int, src int, keys binary, seen binary")
    answers = announced.groupBy("bucket").applyInPandas(_light(_answer), "src int, bucket int, repeated binary, hot binary").withColumn("buckets", F.lit(sources))
    path = folder(spark, "runs")
    sourced.groupBy("src").cogroup(answers.groupBy("src")).applyInPandas(_light(lambda a, b: _send(a, b, unit, shards, parts), 2), SENT).write.option("compression", "zstd").parquet(path)
    sent = spark.read.schema(SENT).parquet(path)
    resolved = sent.where("kind = 0").groupBy("g").applyInPandas(_light(lambda f: _resolve(f, index, unit.size)), "src int, g int, n binary, values binary")
    back = resolved.select("src", "g", "n", "values", F.lit(None).cast("binary").alias("places")).unionByName(
        sent.where("kind = 1").select("src", "g", F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("values"), "places")
    )

    extra = docs.select(*beside)
    schema = ", ".join([schema, *[f"{n} {t}" for n, t in extra.dtypes]])
    told = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", src, *beside)

    def finish(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = _sorted(a)
        out = pd.DataFrame([make(*x) for x in covered(a, b, unit)] if len(a) else [], columns=columns)
        return out.assign(**{c: a[c] for c in beside}) if len(a) else out.reindex(columns=[*columns, *beside])

    return told.groupBy("src").cogroup(back.groupBy("src")).applyInPandas(_light(finish, 2), schema)


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
