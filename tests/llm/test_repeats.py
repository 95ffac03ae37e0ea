import random

import numpy as np
import pandas as pd
import pytest
from brute import docs_frame, repeated
from hypothesis import given, settings, strategies as st

from marquee.llm import fmindex, repeats, suffixes

as_bytes = lambda t: list((t or "").encode())
as_words = lambda t: (t or "").encode().split()


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))))
        texts.append(rng.choice([" ", "\n", "\t"]).join(parts))
    texts += [None, "", "   ", texts[0], texts[0], "x" * 49, "x" * 50, "x" * 400, "ab " * 3000, "y " * 12, "y " * 13]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return texts, ids


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [4096, 4])
def test_against_all_windows(spark, monkeypatch, seed, hot):
    texts, ids = corpus(seed)
    df = docs_frame(spark, texts, ids, extra=("src", "kind", "g", "_t"))
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SOURCE_BYTES", 3000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(df).collect()}
    assert got == repeated(list(zip(ids, texts)), as_bytes, 50, bytes)
    want = {d: (n, gone, sha) for d, (n, gone, _, sha) in repeated(list(zip(ids, texts)), as_words, 13, b" ".join).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fmindex.removed(df).collect()} == want


def test_null_and_equal_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    df = docs_frame(spark, [long, long, long, None], [7, 7, None, None])
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffixes.removed(df).collect()) == [(-1, 0), (-1, 0), (7, 0), (7, 0)]
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in fmindex.removed(df).collect()) == [(-1, 0, 0), (-1, 14, 0), (7, 14, 0), (7, 14, 0)]


def test_empty_table(spark):
    df = docs_frame(spark, [])
    assert suffixes.removed(df).count() == 0 and fmindex.removed(df).count() == 0


def test_kept_text_keeps_whole_characters(spark):
    df = docs_frame(spark, ["é" * 30, "aé" + "é" * 40 + "z"], [1, 2])
    assert {r["doc_id"]: r["kept"] for r in suffixes.kept_texts(df, ["lang"]).collect()} == {1: "é" * 30, 2: "az"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=20, unique=True))
def test_merged_transforms(texts):
    raw = [t.encode() for t in texts]
    low = np.arange(len(raw))[::-1].copy()
    found, ends = suffixes.repeated(raw, low, 6)
    windows = [t[i : i + 6] for t in raw for i in range(len(t) - 5)]
    assert len(windows) == ends[-1]
    assert found.tolist() == [min(l for t, l in zip(raw, low.tolist()) if w in t) for w in windows]


@pytest.mark.parametrize("digits", [21, 5])
def test_settled_suffixes_leave_the_merge(monkeypatch, digits):
    """Only suffixes that start a window, and not alone until the last pass, are merged to the end; all windows are decided."""
    rng = random.Random(7)
    shared = ["".join(rng.choice("abé ") for _ in range(rng.randint(40, 70))) for _ in range(5)]
    texts = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + rng.choice(shared) + "ab" * rng.randint(0, 40) for _ in range(60)} | {"", "a", "b" * 49, "b" * 50}
    raw = sorted(t.encode() for t in texts)
    low = np.array([rng.randint(0, 99) for _ in raw])
    least = {}
    windows = [t[i : i + 50] for t in raw for i in range(len(t) - 49)]
    for t, l in zip(raw, low.tolist()):
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(l, least.get(t[i : i + 50], l))
    carried, merge = [], suffixes.merge
    monkeypatch.setattr(suffixes, "DIGITS", digits)
    monkeypatch.setattr(suffixes, "merge", lambda *a: carried.append(merge(*a)) or carried[-1])
    found, ends = suffixes.repeated(raw, low)
    assert found.tolist() == [least[w] for w in windows] and ends[-1] == len(windows)
    held = len(carried[0][0])
    # Windows that occur twice, and at most those whose first 48 bytes do.
    assert sum(windows.count(w) > 1 for w in windows) <= held
    assert held <= sum(sum(t.count(w[:48]) for t in raw) > 1 or w[:47] == w[1:48] for w in windows) < len(windows)
    assert suffixes.repeated([b"b" * 49, b""], np.array([1, 2]))[0].tolist() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc"]), min_size=4, max_size=20).map(tuple), min_size=1, max_size=15, unique=True))
def test_backward_search(texts):
    low = np.arange(len(texts))[::-1].copy()
    found, _ = fmindex.repeated([" ".join(t).encode() for t in texts], low, 4)
    least = {}
    for t, l in zip(texts, low.tolist()):
        for i in range(len(t) - 3):
            least[t[i : i + 4]] = min(l, least.get(t[i : i + 4], l))
    assert found.tolist() == [least[t[i : i + 4]] for t in texts for i in range(len(t) - 3)]


def test_equal_windows_share_a_minimizer():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(50)
    first, n, key = repeats.runs(np.concatenate([h, h[100:300]]), np.array([400, 200]), 50, 16)
    own = {}
    for a, m, k in zip(first, n, key):
        for w in range(a, a + m):
            own[w] = k
    assert sorted(own) == [*range(351), *range(400, 551)]
    assert all(own[w] == own[w - 300] for w in range(400, 551))


@pytest.mark.parametrize("spread", [1, 1 << 12, 1 << 50])
def test_minimizers_do_not_depend_on_the_lot(spread):
    """Hashes that differ in their low bits only, alone and before thousands of others."""
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 9, 60).astype(np.uint64) * np.uint64(spread) + np.uint64(1 << 50)
    rest = rng.integers(1 << 60, 1 << 62, 5000).astype(np.uint64)
    alone = repeats.runs(own, np.array([60]), 50, 16)
    first, n, key = repeats.runs(np.concatenate([own, rest]), np.array([60, 5000]), 50, 16)
    mine = first < 60
    for a, b in zip(alone, (first[mine], n[mine], key[mine])):
        assert a.tolist() == b.tolist()
    # The windows of a run share their leftmost least gram.
    for a, m, k in zip(*alone):
        for w in range(a, a + m):
            assert repeats.mix(own[w : w + 35].min(keepdims=True))[0] == k
            assert w + int(own[w : w + 35].argmin()) == a + int(own[a : a + 35].argmin())


def test_copies_of_a_run_are_not_hot():
    """A passage is hot by its distinct surroundings, not by how often it occurs."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh") for _ in range(120))
    near = lambda: "".join(rng.choice("abcdefgh") for _ in range(60))
    frame = lambda texts: pd.DataFrame({"src": 0, "doc_id": range(len(texts)), "text": texts})
    seen = lambda texts: max(b & 127 for row in repeats._announce(frame(texts), repeats.Bytes, 1)["seen"] for b in row)
    assert seen([line] * 64) == 0
    # Runs at the edges of the line have surroundings of their own in each text.
    assert seen([near() + line + near() for _ in range(64)]) >= 4


@pytest.mark.parametrize("unit, index", [(repeats.Bytes, suffixes.repeated), (repeats.Words, fmindex.repeated)])
def test_parts_of_a_shard(unit, index):
    """A shard is decided part by part: each index gets a share of the runs, and all windows are found."""
    texts, ids = corpus(3)
    frame = pd.DataFrame({"src": 0, "doc_id": ids, "text": texts})
    answers = repeats._answer(repeats._announce(frame, unit, 1)).assign(buckets=1)
    got = []
    for parts in (1, 16):
        sent = repeats._send(frame, answers, unit, 1, parts)
        sizes = []
        back = repeats._resolve(sent[sent["kind"] == 0], lambda t, low: sizes.append(len(t)) or index(t, low), unit.size)
        back = pd.concat([back.assign(places=None), sent[sent["kind"] == 1][["src", "g", "places"]]])
        got.append([(d, mask.tolist()) for d, _, _, mask in repeats.covered(repeats._sorted(frame), back, unit)])
        assert len(sizes) > 1 or parts == 1
        assert max(sizes) < sum(sizes) or parts == 1
    assert got[0] == got[1]
    units, join = (as_bytes, bytes) if unit is repeats.Bytes else (as_words, b" ".join)
    assert {d: sum(m) for d, m in got[1]} == {d: r[1] for d, r in repeated(list(zip(ids, texts)), units, unit.size, join).items()}
