"""Removal of word windows that repeat across documents, by an FM-index per shard.

The index of a shard is the Burrows-Wheeler transform of its texts over word numbers, held as a wavelet
matrix of packed bits with running counts. Documents' windows are streamed through it: backward search
extends all matches to the left by one word at a time and reports the intervals of those that reach
the full length; a match whose interval holds one suffix has met only itself and stops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from marquee.llm.repeats import Words, marked, sha
from marquee.llm.words import CODES, span_keys, spans


class Wavelet:
    """Ranks of symbols in a sequence: one row of bits per binary digit, high digits first."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.digits = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        row = sequence
        for d in reversed(range(self.digits)):
            bit = ((row >> d) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, bool)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among equal symbols; differences are ranks."""
        for k, d in enumerate(reversed(range(self.digits))):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> d) & 1, self.zeros[k] + ones, at - ones)
        return at


class Index:
    """FM-index of texts of word numbers (0 ends a text), ordered by the first ``depth`` symbols."""

    def __init__(self, data: np.ndarray, depth: int):
        self.symbols = int(data.max()) + 1
        rank, span = data.astype(np.int64), 1
        n = len(data)
        while span < depth:
            step = min(span, depth - span)
            later = np.zeros(n, np.int64)
            later[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + later
            self.order = np.argsort(key, kind="stable")
            fresh = np.empty(n, bool)
            fresh[:1] = True
            fresh[1:] = key[self.order][1:] != key[self.order][:-1]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(fresh) - 1
            span += step
        self.first = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=self.symbols))])
        self.tree = Wavelet(np.roll(data, 1)[self.order], self.symbols)
        self.base = self.tree.place(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def search(self, data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals (low, high) of the ``size`` symbols of ``data`` that end at each of ``ends``.

        An interval of one suffix is not extended: it can only be the text's own.
        """
        symbol = data[ends]
        low, high = self.first[symbol], self.first[symbol + 1]
        live = np.arange(len(ends))
        for t in range(1, size):
            live = live[high[live] - low[live] > 1]
            if not len(live):
                break
            symbol = data[ends[live] - t]
            shift = self.first[symbol] - self.base[symbol]
            low[live] = shift + self.tree.place(symbol, low[live])
            high[live] = shift + self.tree.place(symbol, high[live])
        return low, high


def repeated(texts: list[bytes], low: np.ndarray, size: int = Words.size) -> tuple[np.ndarray, np.ndarray]:
    """(least ``low`` over all texts that hold the window, of every window of every text; ends by text)."""
    raw = b"\n".join(texts) + b"\n"
    b = np.frombuffer(raw, np.uint8)
    starts, stops = spans(b)
    keys = span_keys(CODES[b], starts, stops)
    limits = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    number = np.unique(keys, return_inverse=True)[1] + 1
    data = np.zeros(len(number) + len(texts), np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    data[np.arange(len(number)) + text] = number
    of = np.repeat(np.arange(len(texts)), counts + 1)
    many = np.maximum(counts - size + 1, 0)
    ends = np.cumsum(many)
    begin = np.cumsum(counts + 1) - counts - 1
    window = np.arange(ends[-1]) + np.repeat(begin - (ends - many), many)
    index = Index(data, size)
    lo, hi = index.search(data, window + size - 1, size)
    value = low[of[window]].copy()
    several = np.flatnonzero(hi - lo > 1)
    found, inverse = np.unique(lo[several], return_inverse=True)
    if len(found):
        top = np.zeros(len(found), np.int64)
        top[inverse] = hi[several]
        ranked = np.append(low[of[index.order]], np.iinfo(np.int64).max)
        edges = np.stack([found, top], axis=1).ravel()
        value[several] = np.minimum.reduceat(ranked, edges)[::2][inverse]
    return value, ends


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    A word goes if a window of 13 words over it also starts in a document of smaller doc_id. Null and
    short texts stay whole; equal doc_ids don't remove from each other; rows without doc_id take no
    part and come out whole.
    """

    def make(doc_id, raw, _, mask):
        return doc_id, len(mask), int(mask.sum()), sha(Words.kept(raw, None, mask))

    found = marked(docs, Words, repeated, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    whole = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.encode(F.array_join(words, " "), "UTF-8"), 256).alias("kept_sha256"))
    return found.union(whole)
