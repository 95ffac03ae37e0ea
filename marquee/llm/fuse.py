"""Static binary-fuse filters: membership of 64-bit digests in about nine bits each, no false negatives.

Every key owns three slots in three neighbouring segments of one table; the exclusive or of the slots is
the key's eight-bit fingerprint. A key is found by peeling: a slot that only one key uses determines that
key's fingerprint, the key is taken away, and so on in rounds; slots are filled in the reverse order. All
keys of a round are handled at once, as a slot used by one key is used by no other key of that round.
"""

from __future__ import annotations

import math

import numpy as np

from marquee.llm.words import mix

_TRIES = 64


def _layout(n: int) -> tuple[int, int]:
    """(segment length, number of segments a first slot may lie in) for ``n`` keys."""
    if n < 2:
        return 4, 1
    length = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(room / length) - 2)


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(three slots of every key, fingerprints)."""
    with np.errstate(over="ignore"):
        h = mix(mix(keys) + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments * length) >> np.uint64(32)).astype(np.int64)
    low = h.astype(np.int64) & (2**62 - 1)
    mask = length - 1
    slots = np.stack([first, (first + length) ^ ((low >> 18) & mask), (first + 2 * length) ^ (low & mask)])
    return slots, ((h ^ (h >> np.uint64(29))) & np.uint64(255)).astype(np.uint8)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that is theirs alone); None where a core of keys can't be peeled."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    np.bitwise_xor.at(held, slots.ravel(), np.tile(np.arange(n), 3))
    rounds, left = [], n
    lone = np.flatnonzero(count == 1)
    while len(lone):
        keys, at = np.unique(held[lone], return_index=True)
        rounds.append((keys, lone[at]))
        left -= len(keys)
        gone = slots[:, keys].ravel()
        np.subtract.at(count, gone, 1)
        np.bitwise_xor.at(held, gone, np.tile(keys, 3))
        gone = np.unique(gone)
        lone = gone[count[gone] == 1]
    return rounds if left == 0 else None


def build(keys: np.ndarray) -> tuple[int, bytes]:
    """(seed, table) of a filter over the keys; repeated keys count once."""
    keys = np.unique(np.asarray(keys).view(np.uint64))
    length, segments = _layout(len(keys))
    size = (segments + 2) * length
    if not len(keys):
        return 0, b""
    for seed in range(1, _TRIES):
        slots, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 % 2**64, length, segments)
        rounds = _peel(slots, size)
        if rounds is not None:
            break
    else:
        raise ValueError(f"no seed of {_TRIES} peels {len(keys)} keys")
    table = np.zeros(size, np.uint8)
    for own, at in reversed(rounds):
        a, b, c = slots[:, own]
        table[at] = prints[own] ^ table[a] ^ table[b] ^ table[c]
    # The layout follows from the number of keys, which goes in front.
    return seed, len(keys).to_bytes(8, "little") + table.tobytes()


def contains(seed: int, raw: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter claims: all that it was built of, and one in 256 of the others."""
    keys = np.asarray(keys).view(np.uint64)
    if not raw:
        return np.zeros(len(keys), bool)
    length, segments = _layout(int.from_bytes(raw[:8], "little"))
    table = np.frombuffer(raw, np.uint8, offset=8)
    slots, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 % 2**64, length, segments)
    return prints == table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]
