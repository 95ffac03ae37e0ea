"""64-bit keys of words and of runs of words, in array operations over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STEP = 0x9E3779B97F4A7C15 | 1
CODES = np.random.default_rng(7).integers(1, 2**63, 256, np.int64).view(np.uint64)
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text taken at once.
CHUNK = 1_000_000

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(STEP ** i, STEP ** -i) modulo 2 ** 64 for i up to ``n``."""
    if n >= len(_powers[0]):
        for k, base in enumerate((STEP, pow(STEP, -1, 2**64))):
            grown = np.full(n + 1, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes; the last byte must be blank."""
    blank = BLANKS[b]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(b) and not blank[0]:
        turn = np.concatenate([[0], turn])
    return turn[::2], turn[1::2]


def span_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Key of every span of 64-bit codes; equal spans give equal keys, wherever they stand."""
    up, down = powers(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts])


def run_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """Key of every run of ``n`` consecutive keys."""
    m = max(0, len(keys) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(STEP) + keys[j : j + m]
    return mix(out)


def lots(raws: Iterator[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    """Consecutive texts, about ``size`` bytes at a time."""
    held, total = [], 0
    for raw in raws:
        held.append(raw)
        total += len(raw) + 1
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def keyed(raws: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, starts, ends, keys) of the words of each text."""
    data = b"\n".join(raws) + b"\n"
    b = np.frombuffer(data, np.uint8)
    starts, ends = spans(b)
    keys = span_keys(CODES[b], starts, ends)
    at = 0
    lo = 0
    for raw in raws:
        hi = int(np.searchsorted(starts, at + len(raw)))
        yield raw, starts[lo:hi] - at, ends[lo:hi] - at, keys[lo:hi]
        at, lo = at + len(raw) + 1, hi
