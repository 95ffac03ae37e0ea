"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared runs of words (seeds). For every pair the longest
unmarked common run is marked again and again, found by running Karp-Rabin hashes of falling length;
the marked share of the item is its coverage. Tiles may stand in any order, so reordered passages count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import mapped, release
from marquee.llm.words import keyed, lots, run_keys
from marquee.operators.ranking import checkpointed

SEED = 5
#: Bits of the filter that lets documents' words through to the join; wrong passes cost rows, no results.
FILTER_BITS = 23
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _raw(text: str | None) -> bytes:
    """Lower-case text with marks as blanks."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN)


def _words(texts) -> Iterator[np.ndarray]:
    for lot in lots(_raw(t) for t in texts):
        for _, _, _, keys in keyed(lot):
            yield keys


def tiles(item: list, text: list, least: int = SEED, first: int = 24) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length), longest first, none shorter than ``least``."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    out = []
    least = max(1, least)
    s = max(least, min(first, len(item), len(text)))
    while s >= least and len(item) >= least:
        # Karp-Rabin: runs of length s of unmarked words, by hash, compared word by word.
        at = defaultdict(list)
        for j in range(len(text) - s + 1):
            if free_t[j : j + s].all():
                at[hash(tuple(text[j : j + s]))].append(j)
        found = defaultdict(list)
        for i in range(len(item) - s + 1):
            if not free_i[i : i + s].all():
                continue
            for j in at.get(hash(tuple(item[i : i + s])), ()):
                k = 0
                while i + k < len(item) and j + k < len(text) and free_i[i + k] and free_t[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k >= s:
                    found[k].append((i, j))
        longest = max(found, default=0)
        if longest > 2 * s:
            s = longest
            continue
        blocked = False
        for k in sorted(found, reverse=True):
            for i, j in found[k]:
                if free_i[i : i + k].all() and free_t[j : j + k].all():
                    free_i[i : i + k] = free_t[j : j + k] = False
                    out.append((i, j, k))
                else:
                    blocked = True
        # A match that lost words to a longer one may still hold a run of this length.
        if not blocked:
            if s == least:
                break
            s = max(least, s // 2)
    return out


def _seed_rows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words binary) of every benchmark row with enough words."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        words = [w.tobytes() for w in _words(frame["text"])]
        return pd.DataFrame({"item": frame["item"], "item_id": frame["item_id"].astype("Int64"), "words": words})

    return mapped(rows, work, "item long, item_id long, words binary").where(F.length("words") >= 8 * SEED)


def _seeds(rows: DataFrame, keep: list[str], words: str) -> DataFrame:
    """One row per distinct seed of each row's words."""
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*keep).dtypes) + ", seed long"

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        found = [np.unique(run_keys(np.frombuffer(w, np.uint64), SEED)).view(np.int64) for w in frame[words]]
        out = frame[keep].loc[frame.index.repeat([len(x) for x in found])].reset_index(drop=True)
        out["seed"] = np.concatenate(found) if found else np.empty(0, np.int64)
        return out

    return mapped(rows, work, schema)


def _filter(seeds: DataFrame) -> np.ndarray:
    """Bit table of all seeds, of a fixed size, whatever the benchmark's size."""
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bits = seeds.select((slot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) % 64 as int))").alias("b"))
    out = np.zeros(2**FILTER_BITS // 64, np.uint64)
    for row in bits.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[row["w"]] = np.uint64(row["b"] & (2**64 - 1))
    return np.unpackbits(out.astype("<u8").view(np.uint8), bitorder="little").astype(bool)


def covered(docs: DataFrame, benchmark: DataFrame, least: int = SEED, threshold: float = 0.5, run: int = 13) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, covered, item_words, coverage) of leaks.

    A pair leaks if its coverage is ``threshold`` or more, or one tile has ``run`` words or more.

    Words are compared in lower case without marks. Items of fewer than five words are too short to
    tell a leak and match nothing, as do null and empty texts. Rows with repeated or null ids are
    compared each on its own. Every word of every document is looked at; ``least`` is at least five.
    """
    spark = docs.sparkSession
    least = max(least, SEED)
    items = checkpointed(_seed_rows(benchmark))
    item_seeds = _seeds(items, ["item"], "words")
    passes = spark.sparkContext.broadcast(np.packbits(_filter(item_seeds)))  # of a fixed size

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.unpackbits(passes.value).astype(bool)
        for frame in frames:
            out = []
            for row, doc_id, words in zip(frame["row"], frame["doc_id"], _words(frame["text"])):
                hit = table[(run_keys(words, SEED) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                if not hit.any():
                    continue
                # Any tile lies within a run of passing seeds.
                edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                for n, (a, b) in enumerate(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))):
                    out.append((row, None if pd.isna(doc_id) else int(doc_id), n, words[a : b + SEED - 1].tobytes()))
            yield pd.DataFrame(out, columns=["row", "doc_id", "part", "words"]).astype({"doc_id": "Int64"})
        release()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = checkpointed(rows.mapInPandas(cut, "row long, doc_id long, part int, words binary"))
    pairs = _seeds(parts, ["row", "part"], "words").join(item_seeds, "seed").select("row", "part", "item").distinct()
    joined = pairs.join(parts, ["row", "part"]).join(items.select("item", "item_id", F.col("words").alias("own")), "item")
    # One row per document and item; a document's parts are together no longer than its text.
    whole = joined.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("part", "words"))).alias("parts"))

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc_id, item_id, own, found in zip(frame["doc_id"], frame["item_id"], frame["own"], frame["parts"]):
            item = np.frombuffer(own, np.uint64).tolist()
            text: list = []
            for n, part in enumerate(found):
                text += [*np.frombuffer(part["words"], np.uint64).tolist(), -1 - n]  # a tile doesn't cross parts
            marked = tiles(item, text, least)
            n = sum(k for _, _, k in marked)
            longest = max((k for _, _, k in marked), default=0)
            out.append((doc_id, item_id, len(marked), longest, n, len(item), n / len(item)))
        return pd.DataFrame(out, columns=["doc_id", "item_id", "n_tiles", "longest", "covered", "item_words", "coverage"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    found = mapped(whole.select("doc_id", "item_id", "own", "parts"), tile, "doc_id long, item_id long, n_tiles int, longest int, covered int, item_words int, coverage double")
    return found.where((F.col("coverage") >= threshold) | (F.col("longest") >= run))
