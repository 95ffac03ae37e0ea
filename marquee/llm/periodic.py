"""Maximal periodic runs of words, by uniting suffix classes in descending order of their common prefixes.

The suffixes of a document are sorted by prefix doubling; neighbours in that order and the length of their
common prefix (LCP) are the edges of a graph. Edges are taken by decreasing LCP, as Kruskal's algorithm
takes them by decreasing weight, and unite classes of positions kept in ascending order. When a union at
LCP l makes positions i < i + q neighbours within their class and q <= l, the words from i on repeat with
period q up to i + q + l. All seeds of one run have the same period and end, and its first word is a seed
of it: the least seed is the start. Positions in between would have joined at a larger LCP if a smaller
period held, so a seed's period is the smallest one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.common import release
from marquee.llm.words import lots

LEAST, TIMES = 6, 4


def suffix_ranks(symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix order, ranks by the first 1, 2, 4, ... symbols) of concatenated documents.

    ``stops`` has the end of the document of every position; documents share no symbol, so suffixes of
    one document stand together. Two positions have the same rank in a level if and only if that many
    symbols from there on agree.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    lead = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]]) if n else np.empty(0, bool)
    # A class is named by its place in the order, so the classes of later levels refine it in place.
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    levels, step = [rank], 1
    size = np.diff(np.append(np.flatnonzero(lead), n))
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_):
        at = order[open_]
        after = np.full(len(at), -1, np.int64)
        inside = at + step < stops[at]
        after[inside] = rank[at[inside] + step]
        own = rank[at]
        new = np.lexsort((after, own))
        at, own, after = at[new], own[new], after[new]
        order[open_] = at
        lead = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        rank = rank.copy()
        rank[at] = open_[np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))]
        levels.append(rank)
        step *= 2
        size = np.diff(np.append(np.flatnonzero(lead), len(at)))
        open_ = open_[np.repeat(size > 1, size)]
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], stops: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, LCP) of neighbouring suffixes that agree in ``least`` symbols or more."""
    level = min(len(levels) - 1, least.bit_length() - 1)
    near = levels[level]
    at = np.flatnonzero(near[order[1:]] == near[order[:-1]]) if len(order) else np.empty(0, np.int64)
    a, b = order[at], order[at + 1]
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < stops[a]) & (y < stops[b])
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        length[same] += 1 << k
    keep = length >= least
    return a[keep], b[keep], length[keep]


def seeds(a: np.ndarray, b: np.ndarray, length: np.ndarray, times: int) -> Iterator[tuple[int, int, int]]:
    """(position, period, LCP) of neighbours that a union makes and that repeat ``times`` times or more."""
    up: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    down = np.argsort(-length, kind="stable")
    more = times - 1
    for x, y, l in zip(a[down].tolist(), b[down].tolist(), length[down].tolist()):
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        while (p := up.get(y, y)) != y:
            up[y] = up.get(p, p)
            y = p
        if x == y:
            continue
        big, small = held.pop(x, None) or [x], held.pop(y, None) or [y]
        if len(big) < len(small):
            big, small, x, y = small, big, y, x
        up[y] = x
        last = -1
        for v, after in zip(small, [*small[1:], 1 << 62]):
            i = bisect_left(big, v)
            # Neighbours from the same side were so before, and the next of this side may stand in between.
            if i and big[i - 1] != last and more * (q := v - big[i - 1]) <= l:
                yield v - q, q, l
            if i < len(big) and big[i] < after and more * (q := big[i] - v) <= l:
                yield v, q, l
            big.insert(i, v)
            last = v
        held[x] = big


def runs_in(words: list[list], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every document, by start, then period.

    A run has the smallest period q, at least ``least`` words and ``times`` * q words, and can't be
    extended. Documents are lists of words; all of them are worked on together.
    """
    counts = np.fromiter(map(len, words), np.int64, len(words))
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if not counts.sum():
        return found
    codes, known = pd.factorize(np.array([w for own in words for w in own], dtype=object))
    starts = np.cumsum(counts) - counts
    symbols = np.repeat(np.arange(len(words)), counts) * len(known) + codes
    stops = np.repeat(starts + counts, counts)
    # The shortest common prefix of a run's first two periods, over all periods.
    low = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    order, levels = suffix_ranks(symbols, stops)
    first: dict[tuple[int, int], int] = {}
    for i, q, l in seeds(*common_prefixes(order, levels, stops, low), times):
        if q + l >= least and i < first.get((i + q + l, q), i + 1):
            first[i + q + l, q] = i
    docs = np.searchsorted(starts + counts, np.fromiter(first.values(), np.int64, len(first)), side="right").tolist()
    for (end, q), i, d in zip(first, first.values(), docs):
        found[d].append((i - int(starts[d]), end - i, q))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, drop in zip(words, (np.cumsum(edge[:-1]) > 0).tolist()) if not drop]


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of every text, and the text without repeats of their periods.

    ``runs`` is an array of (start, length, period) by start, then period. Words are parted by blanks; the
    collapsed text joins the kept ones by one space. A null, empty or blank text has no runs and collapses
    to the empty text. Every row stands for itself, also where doc_ids repeat or are null; other columns
    are ignored. A text is read whole in one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = (b"" if t is None else t.encode("utf-8", "surrogatepass") for t in frame["text"])
            names, at = frame["doc_id"].tolist(), 0
            for lot in lots(texts):
                words = [raw.split() for raw in lot]
                found = runs_in(words, least, times)
                rest = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, found)]
                told = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                yield pd.DataFrame({"doc_id": names[at : at + len(lot)], "runs": told, "collapsed": rest})
                at += len(lot)
        release()

    # As a string, as a column of whole numbers and nulls would pass through pandas as inexact floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumn("doc_id", F.col("doc_id").cast("long"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in one of ten documents.

    Where h = crc32(doc_id) divides by 10, with g = h / 10 and n words, each word i from a = g % n on is
    word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8) in whole numbers.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.expr("CAST(floor(crc32(CAST(doc_id AS STRING)) / 10) AS BIGINT)")).alias("_g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_w", F.when(F.col("_g").isNotNull(), words)).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", F.expr("CAST(1 + (_n - _a) DIV (3 + _g % 8) AS INT)"))
    text = F.expr("array_join(transform(_w, (w, i) -> IF(i >= _a, _w[_a + (i - _a) % _p], w)), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


def digested(found: DataFrame) -> DataFrame:
    """Digest columns of ``periodic``'s rows."""
    line: Column = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("_b"), F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").alias("_lines"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.s")).alias("start"), F.col("_b.n").alias("length"), (-F.col("_b.q")).alias("period"),
        F.expr("1000 * _b.n DIV (-_b.q)").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
