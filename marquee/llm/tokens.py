"""Token ids of whole texts with a public tokenizer, in array operations over batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Bytes of text taken at once, and pieces a worker keeps; a full table starts anew, ids stay the same.
CHUNK = 1_000_000
PIECES_KEPT = 3_000_000

_STEP = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, np.int64).view(np.uint64)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _powers(n: int, step: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _parts(ids: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """The stretches of ``ids`` between the cuts, one more than there are cuts."""
    cuts = cuts.tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys ascending, a place of each, the number of its key for every place).

    Not np.unique, which sorts stably, several times slower, for the first place.
    """
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return ranked[at], order[at], inverse


class Encoder:
    """Ids of pieces of text, each encoded by the tokenizer once and then looked up by a 64-bit key.

    The vocabulary's normalizer works per character and lower-cases; its splitter drops white space
    and parts letters from marks. So no token spans a blank, or the step from an ASCII letter to a
    mark, and the ids of a text are those of its pieces in order (tested against whole texts). Texts
    that may hold special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        kind = np.zeros(256, np.uint8)  # 1 blank, 2 ASCII letter, 3 mark that ends a run of letters
        kind[[32, 10]] = 1
        kind[97:123] = 2
        kind[list(b".,!?;:|%$#&*")] = 3
        self.kind = kind
        self.forward, self.back = _powers(1, _STEP), _powers(1, 1)
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Runs of letters are encoded in one go and parted at word-final tokens."""
        texts = b" ".join(pieces).decode("utf-8", "replace").split(" ")
        plain = [i for i, t in enumerate(texts) if t.isalpha() and (t.isascii() or max(t) < "\u0250")]
        found: list = [None] * len(texts)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in plain)], add_special_tokens=False)[0].ids, np.uint32)
            parts = _parts(ids, np.flatnonzero(self.final[ids])[:-1] + 1)
            if len(parts) == len(plain):
                for i, part in zip(plain, parts):
                    found[i] = part
        rest = [i for i, f in enumerate(found) if f is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        return found

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) + len(keys) > PIECES_KEPT:
            self._empty()
        found = self._encode(pieces)
        n = np.fromiter(map(len, found), np.int64, len(found))
        total = int(n.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + total] = np.concatenate(found)
        at = self.used + np.cumsum(n) - n
        self.used += total
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return place, known

    def _chunk(self, raw: list[bytes]) -> list[np.ndarray]:
        data = (b"\n".join(raw) + b"\n").lower()
        b = np.frombuffer(data, np.uint8)
        if len(b) >= len(self.forward):
            self.forward, self.back = _powers(len(b) + 1, _STEP), _powers(len(b) + 1, pow(_STEP, -1, 2**64))
        kind = self.kind[b]
        before = np.concatenate([[1], kind[:-1]]).astype(np.uint8)
        cut = (before == 2) & (kind == 3)
        starts = np.flatnonzero((kind != 1) & ((before == 1) | cut))
        ends = np.flatnonzero(((kind == 1) & (before != 1)) | cut)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[b] * self.forward[: len(b)], dtype=np.uint64)])
        keys = (sums[ends] - sums[starts]) * self.back[starts]
        keys ^= keys >> np.uint64(31)
        unique, first, inverse = _grouped(keys)
        place, known = self._lookup(unique)
        if not known.all():
            size = len(self.keys)
            new = first[~known]
            self._learn(unique[~known], [data[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            place, known = self._lookup(unique)
            if not known.all():  # the table was emptied
                assert size
                old = first[~known]
                self._learn(unique[~known], [data[s:e] for s, e in zip(starts[old].tolist(), ends[old].tolist())])
                place, _ = self._lookup(unique)
        n = self.n[place][inverse]
        stop = np.cumsum(n)
        source = np.arange(stop[-1] if len(n) else 0) + np.repeat(self.at[place][inverse] - (stop - n), n)
        ids = self.pool[source]
        limits = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        pieces = np.searchsorted(starts, limits)
        bounds = np.concatenate([[0], stop])[pieces]
        return _parts(ids, bounds[:-1])

    def batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of every text, in order; none for null."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if text is not None and "<|" in text:
                if held:
                    yield from self._chunk(held)
                held, size = [], 0
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            held.append((text or "").encode("utf-8", "replace"))
            size += len(held[-1]) + 1
            if size >= CHUNK:
                yield from self._chunk(held)
                held, size = [], 0
        if held:
            yield from self._chunk(held)


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it stays with the Python worker between tasks."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
