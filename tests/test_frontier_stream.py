"""The frontier stream drains a long queue over days, within each day's budget."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from marquee.streaming.frontier import budget_left, day_end, reads_stream
from marquee.streaming.status import use_rocksdb


def drained(spark, tmp_path, days, legacy=frozenset()):
    """Reads by (source, day); ``days`` are the (source, url) links listed on each day."""
    use_rocksdb(spark)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    inbox = str(inbox)
    schema = "source string, url string, seen timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(inbox).withWatermark("seen", "0 seconds")
    for i, links in enumerate(days):
        at = dt.datetime(2026, 3, 1 + i, 9, tzinfo=dt.timezone.utc)
        spark.createDataFrame([(s, u, at) for s, u in links], schema).coalesce(1).write.mode("append").json(inbox)
        query = reads_stream(stream, 100, legacy).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len({(r["source"], r["url"]) for r in rows}) == len(rows)
    return Counter((r["source"], str(r["day"])) for r in rows)


def test_drains_within_the_daily_budget(spark, tmp_path):
    links = [("big", f"u{i:03}") for i in range(251)] + [("small", f"v{i}") for i in range(7)]
    # Later days list the same pages again; a page in the queue or read before is not queued anew.
    days = [links, links[:40], links[:1] + [("small", "v7")], [("other", "w")], [("other", "x")]]
    assert drained(spark, tmp_path, days) == {
        ("big", "2026-03-01"): 100, ("big", "2026-03-02"): 100, ("big", "2026-03-03"): 51,
        ("small", "2026-03-01"): 7, ("small", "2026-03-03"): 1, ("other", "2026-03-04"): 1,
    }


def test_migration_day_is_reserved(spark, tmp_path):
    days = [[("old", f"u{i:03}") for i in range(130)], [("x", "1")], [("x", "2")], [("x", "3")], [("x", "4")]]
    got = drained(spark, tmp_path, days, frozenset({"old"}))
    assert {k[1]: n for k, n in got.items() if k[0] == "old"} == {"2026-03-02": 100, "2026-03-03": 30}


def test_budget_and_day():
    assert [budget_left(100, 0, 30), budget_left(100, 100, 0), budget_left(100, 60, 60)] == [70, 0, 0]
    assert day_end(0) == 86_400_000 and day_end(86_399_999) == 86_400_000 and day_end(86_400_000) == 172_800_000
