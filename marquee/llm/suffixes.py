"""Removal of byte strings that repeat across documents, by merged Burrows-Wheeler transforms.

A shard's texts are split into parts. Each part's transform is built alone; the transforms are then
merged by interleave refinement: starting from any interleave, a stable pass by the eight preceding
symbols sorts all suffixes by eight more symbols, without comparing suffixes again. The passes carry the
groups of suffixes whose common prefix has the length reached; after 50 symbols the groups are the
repeated 50-byte strings. Places of the interleave that are settled leave the passes: suffixes alone in
their group, whose windows occur once, and suffixes whose text ends before the length reached, where no
window starts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from marquee.llm.repeats import Bytes, marked, sha

PARTS = 2
#: Symbols that one number of the dictionary stands for, and numbers that one sort key holds.
GRAM, DIGITS = 8, 21
#: The lower half of a sort key, a place.
LOW = (1 << 32) - 1


def grams(body: np.ndarray) -> np.ndarray:
    """Number of the eight symbols at every place, in their order; zeros follow the end."""
    data = np.concatenate([body, np.zeros(2 * GRAM, np.uint8)]).tobytes()
    eight = np.empty(len(body), np.uint64)
    for r in range(8):
        part = np.frombuffer(data, ">u8", count=(len(body) - r + 7) // 8, offset=r)
        eight[r::8] = part
    return np.unique(eight, return_inverse=True)[1]


def _triples(at: np.ndarray, high: np.ndarray, middle: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``at`` in the order of triples of numbers, where the sorted ones differ from the one before)."""
    fresh = np.ones(len(at), bool)
    if max(int(x.max(initial=0)) for x in (high, middle, low)) < 1 << DIGITS:
        key = (high << 2 * DIGITS) | (middle << DIGITS) | low
        order = np.argsort(key)
        key = key[order]
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
    else:
        order = np.lexsort((low, middle, high))
        fresh[1:] = (np.diff(high[order]) | np.diff(middle[order]) | np.diff(low[order])) != 0
    return at[order], fresh


def _triple(number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of three consecutive grams as one."""
    return (number[at] << 2 * DIGITS) | (number[at + GRAM] << DIGITS) | number[at + 2 * GRAM]


def bounds(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols before the end of its text, symbols after the start of its text) of every place."""
    stop = np.flatnonzero(body == 0)
    size = np.diff(stop, prepend=-1)
    at = np.arange(len(body))
    return np.repeat(stop, size) - at, at - np.repeat(stop - size + 1, size)


def several(fresh: np.ndarray) -> np.ndarray:
    """Whether each of sorted values occurs more than once, given where they differ from the one before."""
    return ~(fresh & np.append(fresh[1:], True))


def transform(ahead: np.ndarray, number: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Suffixes of a part by ``depth`` symbols or more, those with ``least`` symbols in their text.

    Symbol 0 ends a text. Beyond an end symbol the order doesn't matter. Each sort goes on with the
    suffixes that the ones before left tied.
    """
    order = np.flatnonzero(ahead >= least)
    order, fresh = _triples(order, number[order], number[order + GRAM], number[order + 2 * GRAM])
    span = 3 * GRAM
    tied = np.flatnonzero(several(fresh))
    group = np.cumsum(fresh)[tied]
    while span < depth and len(tied):
        a, b = min(span, depth - GRAM), min(span + GRAM, depth - GRAM)
        own = order[tied]
        order[tied], fresh = _triples(own, group, number[own + a], number[own + b])
        span += 2 * GRAM
        left = several(fresh)
        tied, group = tied[left], np.cumsum(fresh)[left]
    return order


def first_depth(number: np.ndarray, depth: int) -> int:
    """Symbols that sort the first interleave: three grams if they fit a sort key, or one; none for a depth of few grams."""
    if depth < 3 * GRAM:
        return 0
    return 3 * GRAM if int(number.max()) < 1 << DIGITS else GRAM


def first_interleave(numbers: list[np.ndarray], orders: list[np.ndarray], reached: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of every suffix, group) by the leading ``reached`` symbols of the parts' sorted suffixes.

    The parts are sorted, so this is a merge of sorted lists. At depth 0 they just follow one another.
    """
    of = np.repeat(np.arange(len(orders), dtype=np.uint8), [len(x) for x in orders])
    if not reached:
        return of, np.zeros(len(of), np.int64)
    key = np.concatenate([_triple(x, order) if reached > GRAM else x[order] for x, order in zip(numbers, orders)])
    turn = np.argsort(key, kind="stable")
    key = key[turn]
    return of[turn], np.cumsum(np.diff(key, prepend=key[:1]) != 0)


def preceding(body: np.ndarray, number: np.ndarray, behind: np.ndarray, order: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` symbols before each suffix, as a number in their order; -1 where its text has fewer."""
    if step == GRAM:
        own = number[order - step]
    else:
        own = (body[order - 2].astype(np.int64) << 8) | body[order - 1]
    own[behind[order] < step] = -1
    return own


def merge(parts: list[tuple], of: np.ndarray, group: np.ndarray, reached: int, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(interleave of the parts' transforms, first place of every group with ``depth`` equal symbols, the parts' orders in it).

    ``parts`` are (body, number, ahead, behind, order). The interleave names the part of every suffix
    in the merged order; a part's own suffixes keep their order in it. A pass goes on with the suffixes
    that are not settled and whose place a step of symbols on isn't either; all others with ``depth``
    symbols in their text are the only ones with their first ``depth`` symbols.
    """
    orders = [order for *_, order in parts]
    while reached < depth:
        step = GRAM if depth - reached >= GRAM else 2
        open_ = several(np.diff(group, prepend=-1) != 0)
        symbols = np.full(len(of), -1, np.int64)
        for k, (body, number, ahead, behind, _) in enumerate(parts):
            at = np.flatnonzero(of == k)
            shared = open_[at]
            at, own = at[shared], orders[k][shared]
            is_open = np.zeros(len(body) + step, bool)
            is_open[own] = True
            symbols[at] = np.where(is_open[own - step], preceding(body, number, behind, own, step), -1)
            orders[k] = own[is_open[own + step] & (ahead[own] >= reached + step)]
        reached += step
        held = np.flatnonzero(symbols >= 0)
        # Symbols and places are one number, so any sort of it is stable.
        key = (symbols[held] << 32) | held
        key.sort()
        turn, symbols = key & LOW, key >> 32
        of, group = of[turn], group[turn]
        fresh = (symbols[1:] != symbols[:-1]) | (group[1:] != group[:-1])
        group = np.concatenate([[0], np.cumsum(fresh)])[: len(of)]
    return of, np.flatnonzero(np.diff(group, prepend=-1)), orders


def repeated(texts: list[bytes], low: np.ndarray, size: int = Bytes.size) -> tuple[np.ndarray, np.ndarray]:
    """(least ``low`` over all texts that hold the window, of every window of every text; ends by text).

    ``size`` is even, as the last passes sort by two symbols.
    """
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    limits = np.linspace(0, int((n + 1).sum()), PARTS + 1)[1:-1]
    cuts = [0, *np.searchsorted(np.cumsum(n + 1), limits).tolist(), len(texts)]
    spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
    # Symbols are bytes shifted up by one, as UTF-8 never uses the topmost; 0 ends a text.
    bodies = [np.frombuffer(b"\xff".join(texts[a:b]) + b"\xff", np.uint8) + np.uint8(1) for a, b in spans]
    edges = [bounds(x) for x in bodies]
    room = size + 2 * GRAM
    rooms = np.cumsum([0] + [len(x) + room for x in bodies])
    number = grams(np.concatenate([np.pad(x, (0, room)) for x in bodies]))
    numbers = [number[a:b] for a, b in zip(rooms, rooms[1:])]
    reached = first_depth(number, size)
    orders = [transform(ahead, k, size, reached) for (ahead, _), k in zip(edges, numbers)]
    parts = [(x, k, *e, order) for x, k, e, order in zip(bodies, numbers, edges, orders)]
    of, edge, orders = merge(parts, *first_interleave(numbers, orders, reached), reached, size)
    many = np.maximum(n - size + 1, 0)
    value = np.repeat(low, many)
    if len(of):
        # Windows are counted without the last places of each text.
        text = np.repeat(np.arange(len(texts)), n + 1)
        skipped = np.cumsum(n + 1 - many) - (n + 1 - many)
        place = np.empty(len(of), np.int64)
        for k, order in enumerate(orders):
            place[of == k] = order + sum(map(len, bodies[:k]))
        own = text[place]
        least = np.minimum.reduceat(low[own], edge)
        value[place - skipped[own]] = np.repeat(least, np.diff(np.append(edge, len(of))))
    return value, np.cumsum(many)


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    A byte goes if a 50-byte string over it also starts in a document of smaller doc_id. Null and short
    texts stay whole; equal doc_ids don't remove from each other; rows without doc_id take no part and
    come out whole.
    """

    def make(doc_id, raw, _, mask):
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        return doc_id, len(raw), int(mask.sum()), spans, sha(Bytes.kept(raw, None, mask))

    found = marked(docs, Bytes, repeated, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return found.union(whole)


def kept_texts(docs: DataFrame, beside: list[str] = ()) -> DataFrame:
    """(doc_id, kept, columns ``beside``) of every document with a doc_id: the text without removed bytes.

    A character of several bytes stays if any of them does.
    """

    def make(doc_id, raw, _, mask):
        if not mask.any():
            return doc_id, raw.decode("utf-8", "replace")
        b = np.frombuffer(raw, np.uint8)
        if raw.isascii():
            return doc_id, b[~mask].tobytes().decode()
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        gone = np.logical_and.reduceat(mask, lead) if len(lead) else mask[:0]
        keep = ~np.repeat(gone, np.diff(np.append(lead, len(b))))
        return doc_id, b[keep].tobytes().decode("utf-8", "replace")

    return marked(docs, Bytes, repeated, make, "doc_id long, kept string", beside)
