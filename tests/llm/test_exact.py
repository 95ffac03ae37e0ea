import hashlib
import uuid
from collections import Counter

import numpy as np
import pytest
from brute import docs_frame
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marquee.llm import exact, fuse
from marquee.llm.repair import folder


def model(rows):
    """Counter of (doc_id, keep_id, group_size, kept, sha256); one of the rows with the largest doc_id stays."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = Counter()
    for t, ids in groups.items():
        keep = max(ids, key=lambda d: (d is not None, d or 0))
        first = True
        for d in ids:
            out[d, keep, len(ids), d == keep and first, hashlib.sha256(t.encode()).hexdigest()] += 1
            first = first and d != keep
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("n", [1, 3])
def test_against_groups(spark, n):
    texts = ["a", "b", "a", None, "", "  ", "é" * 40000, "é" * 40000, "A", "a\n", "b", "a", "z", "z", "z"]
    ids = [5, 3, 9, 2, 7, 1, 4, 11, 12, 13, 14, 20, None, 8, 8]
    df = docs_frame(spark, texts, ids, extra=("digest", "row", "batch", "entry", "bucket", "sha"))
    assert result(exact.deduplicate(df, folder(spark, "exact"), n)) == model(list(zip(ids, texts)))


def test_only_null_ids(spark):
    df = docs_frame(spark, ["a", "a"], [None, None])
    assert sorted(r["kept"] for r in exact.deduplicate(df, folder(spark, "exact")).collect()) == [False, True]


def test_empty_table_and_batches(spark):
    assert exact.deduplicate(docs_frame(spark, []), folder(spark, "exact")).count() == 0
    assert exact.Store(spark, folder(spark, "exact")).members().count() == 0


def test_hot_group_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact, "KEYS", 16)
    monkeypatch.setattr(exact, "LEAST_KEYS", 4)
    texts = ["copy" if i % 3 == 0 else f"text {i % 200}" for i in range(600)]
    df = docs_frame(spark, texts)
    assert result(exact.deduplicate(df, folder(spark, "exact"))) == model(list(enumerate(texts)))


def test_snapshots_are_screened_and_stay(spark):
    store = exact.Store(spark, folder(spark, "exact"))
    store.commit(docs_frame(spark, ["a", "b", "b"], [1, 2, 3]))
    before = sorted(map(tuple, spark.read.parquet(f"{store.path}/0/entries").collect()))
    store.commit(docs_frame(spark, ["b", "c", None], [4, 5, 6]))
    assert sorted(map(tuple, spark.read.parquet(f"{store.path}/0/entries").collect())) == before
    stored = {r["sha"]: (r["entry"], r["text"]) for r in spark.read.parquet(f"{store.path}/1/entries").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert stored == {sha("b"): (0, None), sha("c"): (1, "c"), sha(""): (1, "")}
    # A store opened anew goes on where the first one ended.
    again = exact.Store(spark, store.path, store.snapshots)
    again.commit(docs_frame(spark, ["c", "a"], [7, 0]))
    assert result(again.members()) == model([(1, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "c"), (6, ""), (7, "c"), (0, "a")])


def test_claims_without_equal_bytes_are_new(spark, monkeypatch):
    """With digests that collide, and filters that so claim every text, the bytes decide."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(1).cast("long") if c == ("text",) else F.crc32(F.col(c[0]).cast("string")))
    texts = ["a", "b", "c", "a", "b", "d", "d", "e"]
    assert result(exact.deduplicate(docs_frame(spark, texts), folder(spark, f"exact-{uuid.uuid4().hex}"))) == model(list(enumerate(texts)))


def test_the_filter_decides(spark, monkeypatch):
    """Rows come from the screening: with filters that claim nothing, batches don't find each other."""
    monkeypatch.setattr(exact, "_screen", lambda digests, filters: digests[["digest"]].iloc[:0])
    store = exact.Store(spark, folder(spark, "exact"))
    store.commit(docs_frame(spark, ["a", "a"], [1, 2]))
    store.commit(docs_frame(spark, ["a"], [3]))
    assert sorted((r["doc_id"], r["keep_id"]) for r in store.members().collect()) == [(1, 2), (2, 2), (3, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_filters_claim_all_their_keys(keys):
    seed, table = fuse.build(np.array(keys, np.int64))
    assert fuse.contains(seed, table, np.array(keys, np.int64)).all()


def test_filters_claim_few_others_and_are_small():
    rng = np.random.default_rng(5)
    seed, table = fuse.build(rng.integers(-(2**63), 2**63 - 1, 100_000))
    assert len(table) < 1.25 * 100_000
    assert 0.002 < fuse.contains(seed, table, rng.integers(-(2**63), 2**63 - 1, 200_000)).mean() < 0.006
