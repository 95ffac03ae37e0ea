"""Queries against their SQL twins on tables that hold what the small given ones lack."""

import os
import re
import sys

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
from check_oracles import rows_of  # noqa: E402

from marquee.operators import contracts as K  # noqa: E402
from marquee.operators.ranking import ensure_checkpoint_dir  # noqa: E402
from marquee.operators.snapshot import matched_rows  # noqa: E402
from marquee.sources.retained import Retained  # noqa: E402


def both(spark, folder, name, tables):
    """(rows of the query, rows of its SQL) over ``tables`` written to a folder."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    return rows_of(df.columns, df.collect()), rows_of([d[0] for d in cur.description], cur.fetchall())


def given(spark, sf, *names):
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names}


def test_pages_of_one_url_are_queued_each(spark, sf, tmp_path):
    t = given(spark, sf, "pages", "labels")
    again = t["pages"].withColumn("page_id", F.col("page_id") + 1000)
    t["pages"] = t["pages"].union(again).union(again.where("page_id % 3 = 0"))
    mine, theirs = both(spark, tmp_path, "inc_04_frontier_day", t)
    assert mine == theirs


def test_snapshot_scan_has_every_kind(spark, sf, tmp_path):
    t = given(spark, sf, "documents")
    lang = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, F.lit(None)).otherwise(F.col("lang"))
    t["documents"] = t["documents"].withColumn("lang", lang)
    mine, theirs = both(spark, tmp_path, "src_03_snapshot_scan", t)
    assert mine == theirs and {dict(zip(mine[0], r))["kind"] for r in mine[1]} == {"de", "en", "es", "fr", "", None}


def test_contract_reads_its_texts_once(spark):
    for contract, scope in ((K.published_live(), ["kind"]), (K.calendar("https://c.example/", "https://c.example/d"), ["kind"]), (K.event_import(), ["kind"])):
        lines = spark.createDataFrame([("a", "{}"), ("a", None)], "kind string, raw string")
        df = K.check(lines, contract, scope)
        assert df._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 1
        assert df.where("violation = 'unreadable' and id is null").count() == 1


def test_contract_work_is_spread(spark, sf):
    """A few rows of JSON are not left to one task."""
    for name in ("chk_01_event_contract", "chk_02_published_listings", "chk_03_live_contract", "chk_04_season_contract"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and ", 4" in plan, name


def test_reconcile_removes_what_it_no_longer_reads(spark, sf):
    before = set(folders(spark))
    df = entry.queries()["joi_07_reconcile"](spark, sf)
    made = [f for f in folders(spark) if f not in before]
    # All that is left is the result's one table, of two numbers a record.
    assert len(made) == 2 and df.agg(F.sum("records")).first()[0] == spark.read.parquet(f"{sf}/orders.parquet").count()


def folders(spark):
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return [d for d, _, _ in os.walk(root) if d != root]


def test_seasons_are_not_gathered_by_season(spark, sf):
    """Twelve seasons: a shuffle by season alone would leave each one to a task."""
    plan = entry.queries()["ext_12_calendar_seasons"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(season#\d+, \d+\)", plan)


def test_retained_joins_are_not_broadcast(spark, tmp_path):
    columns = "id string, sourceUid string, title string, price double"
    store = Retained(spark, str(tmp_path / "s"), f"{columns}, firstSeen string, lastSeen string, missingFromSource boolean, revisions array<struct<title:string,price:double,lastSeen:string>>")
    rows = lambda price: spark.createDataFrame([("a", "u", "t", price), ("b", "w", "t", price)], columns)
    facts = dict(tracked=["title", "price"], fallback=("sourceUid",))
    for n, price in enumerate((1.0, 2.0)):
        store.apply(n, rows(price), f"2026-10-0{n + 1}", **facts)
        store.compact()
    merged = matched_rows(store.current(), rows(3.0), "2026-10-03", **facts)
    for df in (store.current(), merged):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {len(r["revisions"]) for r in merged.collect()} == {2}
