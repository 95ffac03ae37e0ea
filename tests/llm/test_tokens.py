import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import docs_frame
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from marquee.llm import packing, repair, tokens

PLAIN = Tokenizer.from_file(tokens.default_tokenizer())
ODD = ["it's 3.5% ΣΑΣ a\tb c d <|endoftext|> x<|startoftext|>y À don't　", "", " ", "\n\n", "e ́x", "İI ı ﬁ", "'s' 'T 'LL", "don'T. IT'S, ab,cd. x., <|ENDOFTEXT|>", "ñ, Ñ! ª. ʰ. ǅ.", "é…, x.y a!!b 3.4,x K,", "ñ Å,", None, "word " * 5000, "\x1c\x1d a\x0bb", "漢字 かな,"]


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_pieces_are_whole_texts():
    own = tokens.Encoder(tokens.default_tokenizer())
    for _ in range(2):
        for text, ids in zip(ODD, own.batch(ODD)):
            assert ids.tolist() == ids_of(text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Z.,'!1\n<|>é"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_any_text(texts):
    own = tokens.encoder(tokens.default_tokenizer())
    assert [x.tolist() for x in own.batch(texts)] == [ids_of(t) for t in texts]


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES_KEPT", 3)
    own = tokens.Encoder(tokens.default_tokenizer())
    texts = [f"w{i} word{i} x" for i in range(20)]
    for t in texts:
        assert next(own.batch([t])).tolist() == ids_of(t)


def test_token_files(spark, tmp_path):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = docs_frame(spark, texts, ids, extra=("pid", "shard", "seq"))
    repair.write(df, str(tmp_path / "t"), shard_ids=900)
    want, at = {}, 0
    for d, t in sorted(zip(ids, texts)):
        x = np.array([*ids_of(t), 1], "<u4")
        want[d] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.digests(spark, str(tmp_path / "t")).collect()} == want
    assert {r["doc_id"]: zlib.crc32(r["ids"]) for r in repair.read(spark, str(tmp_path / "t")).collect()} == {d: w[2] for d, w in want.items()}


def test_token_files_of_nulls_repeats_nothing(spark, tmp_path):
    repair.write(docs_frame(spark, [None, None, "a"], [3, 3, None]), str(tmp_path / "a"))
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in repair.digests(spark, str(tmp_path / "a")).collect()]
    assert sorted(got, key=str) == [(3, 0, 1), (3, 1, 1), (None, 2, 2)]
    repair.write(docs_frame(spark, []), str(tmp_path / "b"))
    assert repair.digests(spark, str(tmp_path / "b")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=300), st.integers(0, 299), st.integers(0, 300))
def test_grammar_round_trip(ids, start, n):
    raw = np.array(ids, np.uint32)
    seq, rules, lengths, base = repair.compress(raw, 2)
    stored = repair.Shard(seq.tobytes(), rules.tobytes(), lengths.tobytes(), base)
    assert stored.read(0, len(ids)).tolist() == ids
    start = min(start, len(ids) - 1)
    n = min(n, len(ids) - start)
    assert stored.read(start, n).tolist() == ids[start : start + n]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=200), st.integers(2, 5))
def test_no_frequent_pair_is_left(ids, least):
    seq, rules, _, base = repair.compress(np.array(ids, np.uint32), least)
    # Counted without overlaps, as they could be replaced.
    left, last = Counter(), {}
    for i, pair in enumerate(zip(seq.tolist(), seq.tolist()[1:])):
        if last.get(pair) != i - 1:
            left[pair], last[pair] = left[pair] + 1, i
    assert all(n < least for n in left.values())
    assert len({tuple(r) for r in rules.tolist()}) == len(rules) and all(max(r) < base + i for i, r in enumerate(rules.tolist()))


def test_the_frequent_pair_comes_first():
    # (1, 2) is seen six times, (0, 1) and (2, 3) four times each: where they overlap, (1, 2) is replaced.
    seq, rules, _, base = repair.compress(np.array([0, 1, 2, 3, 9] * 4 + [1, 2, 8] * 2, np.uint32), 4)
    assert rules[0].tolist() == [1, 2] and (seq != 1).all() and (seq != 2).all()


class Looks(int):
    """A number that counts how many symbols are compared with it."""

    __array_ufunc__ = None
    seen = 0

    def __le__(self, symbols):
        Looks.seen += len(symbols)
        return symbols >= int(self)

    def __rsub__(self, symbols):
        return symbols - int(self)


def test_decoding_looks_at_each_symbol_once():
    # The zeros are fourteen rules deep; the other ids must not be gone through again for each of them.
    raw = np.concatenate([np.arange(1, 20_001), np.zeros(1 << 14, int)]).astype(np.uint32)
    seq, rules, lengths, base = repair.compress(raw, 2)
    stored = repair.Shard(seq.tobytes(), rules.tobytes(), lengths.tobytes(), base)
    stored.base, Looks.seen = Looks(base), 0
    assert stored.read(0, len(raw)).tolist() == raw.tolist()
    assert Looks.seen <= 2 * len(raw)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.integers(0, 700))
def test_places_as_one_by_one(weights, blanks):
    # Blanks beside the places decide whether all places are gone through or only a list of them.
    weights = [*weights, *[0] * blanks]
    at = np.flatnonzero(weights)
    want: set[int] = set()
    for i in sorted(at.tolist(), key=lambda i: (-weights[i], i)):
        if not {i - 1, i + 1} & want:
            want.add(i)
    places, own = repair._chosen(at[::-1], np.array(weights)[at[::-1]], len(weights))
    assert places.tolist() == sorted(want) and own.tolist() == [weights[i] for i in sorted(want)]


@pytest.mark.parametrize("top", [7, 2**31])
def test_pairs_are_counted_with_their_places(top):
    seq = np.random.default_rng(1).integers(0, 7, 500) * (top // 7)
    at = np.arange(0, 499, 2)
    want = defaultdict(list)
    for i in at.tolist():
        want[int(seq[i]) * top + int(seq[i + 1])].append(i)
    pairs, count, place = repair._counted(seq[at], seq[at + 1], at, top)
    assert pairs.tolist() == sorted(want) and count.tolist() == [len(want[p]) for p in sorted(want)]
    assert place.tolist() == [i for p in sorted(want) for i in want[p]]


def test_files_ascend(spark, tmp_path):
    ids = random.Random(4).sample(range(10**6), 300)
    repair.write(docs_frame(spark, [f"text {i} of many" for i in ids], ids).repartition(7), str(tmp_path / "t"), shard_ids=200)
    files = [r["f"] for r in spark.read.parquet(str(tmp_path / "t")).selectExpr("_metadata.file_name AS f").distinct().collect()]
    told = [x for f in sorted(files) for r in spark.read.parquet(str(tmp_path / "t" / f)).collect() for x in np.frombuffer(r["doc_ids"], "<i8").tolist()]
    assert told == sorted(ids)


def test_repeats_compress():
    raw = np.tile(np.arange(50, dtype=np.uint32), 400)
    seq, rules, _, _ = repair.compress(raw)
    assert len(seq) + 2 * len(rules) < len(raw) / 10


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=30))
def test_plan_fills_sequences(counts):
    bins, used = defaultdict(list), Counter()
    for length, a, b, first, copies, at in packing.plan(counts, 64):
        for k in range(b - a + 1):
            bins[first + k // copies].append((at + k % copies * length, length))
            used[length] += 1
    assert used == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    # Best fit from the longest down stays within 11/9 of the bound plus one.
    large = sum(n for x, n in counts.items() if x > 32)
    assert len(bins) <= 11 / 9 * max(large, -(-sum(x * n for x, n in counts.items()) // 64)) * 1.1 + 1


@pytest.mark.parametrize("limit", [16, 2048])
def test_packing(spark, limit):
    rng = random.Random(3)
    texts = ODD + [" ".join(["tree"] * rng.randint(0, 60)) for _ in range(80)] + ["same"] * 40
    ids = [*range(len(texts) - 2), 5, None]
    df = docs_frame(spark, texts, ids, extra=("row", "length", "_rank"))
    got = packing.pack(df, limit).collect()
    want = Counter()
    for d, t in zip(ids, texts):
        x = np.array([*ids_of(t), 0], "<u4")
        for at in range(0, len(x), limit):
            want[d, at // limit, at, len(x[at : at + limit]), zlib.crc32(x[at : at + limit].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit


def test_packing_nothing(spark):
    assert packing.pack(docs_frame(spark, [])).count() == 0
