"""Retained state as base and deltas, against the whole rewrite."""

import random
import shutil

from marquee.operators.snapshot import merge_listings
from marquee.sources.retained import Retained

COLUMNS = "id string, sourceUid string, venue string, address string, title string, price double"
STATE = f"{COLUMNS}, firstSeen string, lastSeen string, missingFromSource boolean, revisions array<struct<title:string,price:double,lastSeen:string>>"


def batch(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def seen(df):
    return sorted(map(str, df.select(*[c.split()[0] for c in STATE.replace("array<struct<title:string,price:double,lastSeen:string>>", "x").split(", ")]).collect()))


def test_equals_whole_rewrite(spark, tmp_path):
    rng = random.Random(3)
    store, whole = Retained(spark, str(tmp_path / "s"), STATE), spark.createDataFrame([], STATE)
    for n in range(4):
        # Ids that change while uid, place and address stay, ids that come back, empty uids, a batch without rows.
        rows = [(f"{i}{'x' if rng.random() < 0.2 else ''}", "" if i % 7 == 0 else f"u{i}", "v", None if i % 5 == 0 else "a", "t", float(rng.randrange(3))) for i in range(40) if rng.random() < 0.7]
        rows = [] if n == 2 else rows
        now = f"2026-10-0{n + 1}"
        assert store.apply(n, batch(spark, rows), now, tracked=["title", "price"])
        whole = spark.createDataFrame(merge_listings(whole, batch(spark, rows), now, tracked=["title", "price"]).select(*whole.columns).collect(), STATE)
        assert seen(store.current()) == seen(whole)
        # A committed batch is not applied again, whatever it brings.
        assert not store.apply(n, batch(spark, []), "2027-01-01", tracked=["title", "price"])
        if n == 1:
            assert store.compact(0.0) and not store.compact(0.0)
            store.expire()
            assert store.batches() == [] and seen(store.current()) == seen(whole)
    assert seen(store.current(before=3)) != seen(whole) and store.batches() == [2, 3]


def test_writes_follow_the_batch(spark, tmp_path):
    store = Retained(spark, str(tmp_path / "s"), STATE)
    many = [(str(i), f"u{i}", "v", "a", "t", 1.0) for i in range(2000)]
    store.apply(0, batch(spark, many), "2026-10-01", tracked=["title", "price"])
    store.compact()
    store.apply(1, batch(spark, many[:1990]), "2026-10-02", tracked=["title", "price"])
    store.apply(2, batch(spark, many[:5]), "2026-10-03", tracked=["title", "price"])
    store.apply(3, batch(spark, many[:5]), "2026-10-04", tracked=["title", "price"])
    rows = lambda n: [spark.read.parquet(f"{store.root}/{k}={n}").count() for k in ("seen", "gone")]
    # Rows that were missing before are not written again.
    assert rows(1) == [1990, 10] and rows(2) == [5, 1985] and rows(3) == [5, 0]
    assert store.current().where("missingFromSource").count() == 1995 and store.current().count() == 2000


def test_cut_off_batch_is_written_anew(spark, tmp_path):
    store = Retained(spark, str(tmp_path / "s"), STATE)
    store.apply(0, batch(spark, [("a", "u", "v", "x", "t", 1.0)]), "2026-10-01", tracked=["title", "price"])
    before = seen(store.current())
    store.apply(1, batch(spark, [("a", "u", "v", "x", "t", 9.0)]), "2026-10-02", tracked=["title", "price"])
    shutil.rmtree(f"{store.root}/gone=1")
    assert seen(store.current()) == before and store.batches() == [0]
    assert store.apply(1, batch(spark, [("a", "u", "v", "x", "t", 2.0)]), "2026-10-02", tracked=["title", "price"])
    assert [(r["price"], len(r["revisions"])) for r in store.current().collect()] == [(2.0, 1)]
