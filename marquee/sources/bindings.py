"""Bindings of the driver's tables to the roles listings, sessions, snapshots, pages, documents.

Each Spark binding has an SQL twin (``*_SQL``, a common table expression) used by the
registered SQL texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Reference day of the order/lineitem data and of the event data.
AS_OF = "1998-06-01"
EVENTS_AS_OF = "2024-01-16"

PLATFORM_CODES = {0: "KKTIX", 1: "OPENTIX", 2: "ibon", 3: "tixCraft"}
CLOCKS = {1: "14:30", 3: "19:30", 5: "20:00", 7: "10:00"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- listings ---------------------------------------------------------------

RAW_LISTING_SQL = """
raw_listing AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS uid, c.c_mktsegment || ' ' || c.c_name AS title,
         CAST(o.o_orderdate AS DATE) AS start_day, l.end_day, r.r_name AS region, n.n_name AS venue,
         o.o_totalprice AS price, o.o_orderpriority AS source, o.o_orderstatus AS status,
         CAST(o.o_orderdate AS DATE) AS first_seen, o.o_orderstatus = 'P' AS missing,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'unconfirmed' END AS note
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS end_day FROM lineitem GROUP BY 1) l
    ON l.l_orderkey = o.o_orderkey)
"""
LISTING_SQL = RAW_LISTING_SQL + """,
listing AS (SELECT * FROM raw_listing WHERE end_day IS NULL OR end_day >= start_day)
"""


def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order periods without the place columns: one shuffle on the order key, no dimension joins."""
    last = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max("l_shipdate").cast("date").alias("end_day"))
    )
    o = table(spark, sf_dir, "orders")
    return o.join(last, o.o_orderkey == last.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("uid"),
        F.col("o_orderdate").cast("date").alias("start_day"),
        "end_day",
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("first_seen"),
        (F.col("o_orderstatus") == "P").alias("missing"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("unconfirmed")).alias("note"),
    )


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a listing, reversed periods included."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            "c_custkey",
            F.concat_ws(" ", "c_mktsegment", "c_name").alias("title"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("venue"),
        )
    )
    p = period(spark, sf_dir)
    return p.join(place, p.uid == place.c_custkey).drop("c_custkey")


def is_forward(start: Column, end: Column) -> Column:
    return end.isNull() | (end >= start)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted listings: unknown or forward periods."""
    return raw_listing(spark, sf_dir).where(is_forward(F.col("start_day"), F.col("end_day")))


def forward_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period(spark, sf_dir).where(is_forward(F.col("start_day"), F.col("end_day")))


PERIOD_SQL = """
forward_period AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS uid, CAST(o.o_orderdate AS DATE) AS start_day, l.end_day,
         o.o_totalprice AS price, o.o_orderpriority AS source, o.o_orderstatus AS status,
         CAST(o.o_orderdate AS DATE) AS first_seen, o.o_orderstatus = 'P' AS missing,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'unconfirmed' END AS note
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS end_day FROM lineitem GROUP BY 1) l
    ON l.l_orderkey = o.o_orderkey
  WHERE l.end_day IS NULL OR l.end_day >= CAST(o.o_orderdate AS DATE))
"""

# --- sessions ---------------------------------------------------------------

SESSION_SQL = """
session AS (
  SELECT l_orderkey AS event, CAST(l_shipdate AS DATE) AS day,
         CASE l_linenumber WHEN 1 THEN '14:30' WHEN 3 THEN '19:30' WHEN 5 THEN '20:00' WHEN 7 THEN '10:00' END AS clock,
         CASE l_suppkey % 4 WHEN 0 THEN 'KKTIX' WHEN 1 THEN 'OPENTIX' WHEN 2 THEN 'ibon' ELSE 'tixCraft' END AS platform,
         l_returnflag = 'R' AS cancelled, l_linestatus = 'F' AS scoped,
         l_partkey AS part, l_suppkey AS supp, l_linenumber AS ord, l_extendedprice AS amount
  FROM lineitem)
"""


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sessions: a NULL clock is a legal value of the session key."""
    clocks = F.create_map(*[F.lit(x) for kv in CLOCKS.items() for x in kv])
    platforms = F.create_map(*[F.lit(x) for kv in PLATFORM_CODES.items() for x in kv])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"),
        F.col("l_shipdate").cast("date").alias("day"),
        clocks[F.col("l_linenumber")].alias("clock"),
        platforms[(F.col("l_suppkey") % 4).cast("int")].alias("platform"),
        (F.col("l_returnflag") == "R").alias("cancelled"),
        (F.col("l_linestatus") == "F").alias("scoped"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("ord"),
        F.col("l_extendedprice").alias("amount"),
    )


# --- daily snapshots --------------------------------------------------------

SNAP_SQL = """
snap AS (
  SELECT user_id AS id, CAST(ts AS DATE) AS day,
         max_by(event_type, (ts, event_id)) AS title, max_by(value, (ts, event_id)) AS price
  FROM events GROUP BY 1, 2)
"""


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity and day: the day's last attributes. Map-side combined."""
    e = table(spark, sf_dir, "events")
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    return (
        e.groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day"))
        .agg(last.alias("v"))
        .select("id", "day", F.col("v.event_type").alias("title"), F.col("v.value").alias("price"))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


LIVE_SQL = RAW_LISTING_SQL + "," + SESSION_SQL + """,
live AS (
  SELECT l.id, l.region, l.venue, l.source AS genre, l.title, s.day, s.clock, coalesce(t.platform, 'unverified') AS platform
  FROM (SELECT DISTINCT event, day, clock FROM session WHERE day >= DATE '1998-06-01' AND NOT cancelled) s
  JOIN raw_listing l ON l.id = s.event AND l.status <> 'P'
  LEFT JOIN (SELECT DISTINCT event, day, clock, platform FROM session WHERE scoped OR part % 2 = 0) t
    ON t.event = s.event AND t.day = s.day AND t.clock IS NOT DISTINCT FROM s.clock)
"""


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as live events (status P stands for cancelled), line items as sessions and tickets."""
    from marquee.operators.search import live_sessions

    events = raw_listing(spark, sf_dir).select("id", "region", "venue", F.col("source").alias("genre"), "title", (F.col("status") == "P").alias("cancelled"))
    s = session(spark, sf_dir)
    return live_sessions(events, s, s.where("scoped OR part % 2 = 0"), F.lit(AS_OF).cast("date"))
