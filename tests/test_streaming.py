"""Streaming forms: daily merge through foreachBatch, status machine with keyed state."""

import datetime as dt

from pyspark.sql import functions as F

from marquee.sources import sinks
from marquee.sources.retained import Retained
from marquee.streaming import daily_merge as DM, status as ST

LISTING = "id string, sourceUid string, venue string, address string, title string, price double, snapshot_at string"


STATE = ("id string, sourceUid string, venue string, address string, title string, price double, firstSeen string, lastSeen string,"
         " missingFromSource boolean, revisions array<struct<title:string,price:double,lastSeen:string>>")


def test_daily_merge(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    days = [("2026-10-01", [("a", 1.0), ("b", 1.0)]), ("2026-10-02", [("a", 2.0)])]
    run = DM.merge_into(root, STATE, lambda b: b.agg(F.max("snapshot_at")).first()[0], tracked=["title", "price"])
    for day, rows in days:
        spark.createDataFrame([(i, i, "v", "x", "t", p, day) for i, p in rows], LISTING).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(LISTING).parquet(src)
        DM.start(stream, str(tmp_path / "cp"), run).trigger(availableNow=True).start().awaitTermination(120)
    state = Retained(spark, root, STATE)
    got = {r["id"]: r for r in state.current().collect()}
    assert got["a"]["price"] == 2.0 and got["a"]["firstSeen"] == "2026-10-01" and got["a"]["revisions"][0]["price"] == 1.0
    assert got["b"]["missingFromSource"] is True
    # A replayed batch gives the same state.
    again = spark.createDataFrame([("a", "a", "v", "x", "t", 2.0, "2026-10-02")], LISTING)
    before = sorted(map(str, state.current().collect()))
    run(again, max(state.batches()))
    assert sorted(map(str, state.current().collect())) == before


def test_status_rule():
    d = dt.date
    last = (d(2026, 1, 1), "x", d(2026, 1, 5), "changed")
    assert ST.next_status(None, d(2026, 1, 1), "x") == "scheduled"
    assert ST.next_status(last, d(2026, 1, 2), "y") == "changed"
    assert ST.next_status(last, d(2026, 1, 2), "x") == "changed"
    assert ST.next_status(last, d(2026, 1, 4), "x") == "scheduled"
    assert ST.next_status((d(2026, 1, 1), "x", d(2026, 1, 1), "changed"), d(2026, 1, 4), "x") == "changed"


def test_status_stream_equals_batch(spark, sf, tmp_path):
    from marquee.operators import snapshot as P
    from marquee.sources import bindings as B

    ST.use_rocksdb(spark)
    daily = B.snap(spark, sf).withColumn("open_until", F.date_add("day", F.floor(F.col("price") / 10).cast("int")))
    rows = daily.select(F.col("id").cast("string").alias("id"), "day", F.col("title").alias("fact"), "open_until")
    src = str(tmp_path / "in")
    rows.where("day <= '2024-01-15'").coalesce(1).write.parquet(src)
    schema = "id string, day date, fact string, open_until date"
    got = {}

    def collect(batch, _):
        got.update({(r["id"], r["day"]): r["status"] for r in batch.collect()})

    for part in ("day > '2024-01-15'", None):
        q = ST.status_stream(spark.readStream.schema(schema).parquet(src)).writeStream.foreachBatch(collect).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination(180)
        if part:
            rows.where(part).coalesce(1).write.mode("append").parquet(src)
    top = daily.agg(F.max("day")).first()[0]
    want = {(str(r["id"]), r["day"]): r["status"] for r in P.status_history(daily, "id", "day", "title", F.col("open_until"), F.lit(top)).collect()}
    assert got == want and "changed" in want.values()


def test_publish_swaps_versions(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert sinks.current_version(spark, root) is None
    sinks.publish(spark.range(3), root, "2026-10-01", 1)
    sinks.publish(spark.range(5), root, "2026-10-02", 1)
    assert sinks.read_current(spark, root).count() == 5
    # An unfinished version directory is never read.
    spark.range(9).write.parquet(root + "/v=2026-10-03")
    assert sinks.read_current(spark, root).count() == 5
