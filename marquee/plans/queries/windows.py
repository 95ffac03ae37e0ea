"""Window and sequence operators (win_*)."""

from __future__ import annotations

from marquee.functions import text as T
from marquee.operators import extract as X, frontier as FR, overlay as O, search as S, snapshot as P, tickets as K
from marquee.plans.queries.common import *  # noqa: F403


@query("win_01_fingerprint_dedup", f"""
WITH f AS (SELECT doc_id, lang, source, CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS prio, {word_key_sql('text')} AS fp FROM documents)
SELECT md5(fp) AS fp, lang, max_by(doc_id, (prio, doc_id)) AS doc_id, max_by(source, (prio, doc_id)) AS source FROM f GROUP BY f.fp, lang
""")
def win_01(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "text", F.when(F.col("source") == "src1", 1).otherwise(0).alias("prio")
    )
    # The winner is an aggregate over small columns; the text itself is only in the grouping digest.
    slim = d.select("doc_id", "lang", "source", "prio", F.md5(T.word_key(F.col("text"))).alias("k"))
    from marquee.operators.ranking import first_per_key

    out = first_per_key(slim, ["k", "lang"], F.struct("prio", "doc_id"), last=True)
    return out.select(F.col("k").alias("fp"), "lang", "doc_id", "source")


@query("win_02_first_ticket", SESSION + """
SELECT event, supp AS url, min_by(ord, (NOT scoped, ord, day)) AS ord, min_by(platform, (NOT scoped, ord, day)) AS platform FROM session GROUP BY 1, 2
""")
def win_02(spark, sf):
    s = B.session(spark, sf).select("event", F.col("supp").alias("url"), "ord", "platform", "scoped", "day")
    return K.first_ticket_per_url(s, F.struct(~F.col("scoped"), "ord", "day")).select("event", "url", "ord", "platform")


@query("win_03_fair_interleave", f"""
WITH q AS (SELECT {host_sql('url')} AS host, url, {url_sql('url', 1)} = 'http' AS backlog FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host, backlog ORDER BY url) AS rn FROM q)
SELECT host, url, rn * 2 - CASE WHEN backlog THEN 0 ELSE 1 END AS turn FROM r
""")
def win_03(spark, sf):
    from marquee.functions import urls as U

    q = table(spark, sf, "pages").select(U.host(F.col("url")).alias("host"), "url", U.scheme(F.col("url")).alias("s"))
    out = FR.interleave(q.drop("s").withColumn("old", U.scheme(F.col("url")) == "http"), "host", F.col("old"), [F.col("url")])
    return out.select("host", "url", "turn")


@query("win_04_daily_budget", f"""
WITH used AS (SELECT event_type AS source, count(*) AS used FROM events WHERE CAST(ts AS DATE) = {EVENTS_AS_OF_SQL} GROUP BY 1),
q AS (SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
      FROM events WHERE CAST(ts AS DATE) > {EVENTS_AS_OF_SQL})
SELECT q.source, event_id, rn FROM q LEFT JOIN used USING (source) WHERE rn <= 100 AND rn <= greatest(0, 100 - coalesce(used, 0))
""")
def win_04(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), "event_id", "ts", F.to_date("ts").alias("day"))
    used = e.where(F.col("day") == events_as_of()).groupBy("source").agg(F.count("*").alias("used"))
    queue = e.where(F.col("day") > events_as_of())
    return FR.plan_reads(queue, used, "source", [F.col("ts"), F.col("event_id")]).select("source", "event_id", F.col("rn").cast("bigint").alias("rn"))


@query("win_05_rotation", """
SELECT d.doc_id, l.quality AS last_attempt FROM documents d LEFT JOIN labels l USING (doc_id)
ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 3
""")
def win_05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels").select("doc_id", F.col("quality").alias("last_attempt")), "doc_id", "left"
    )
    return FR.rotation(d, "last_attempt", "doc_id")


@query("win_06_stop_at_failure", """
WITH s AS (SELECT user_id, min((ts, event_id)) FILTER (event_type = 'error') AS stop FROM events GROUP BY 1)
SELECT e.user_id AS batch, count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS restored
FROM events e JOIN s USING (user_id) WHERE stop IS NULL OR (e.ts, e.event_id) <= stop GROUP BY 1
""")
def win_06(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "batch").select("batch", "ts", "event_id", "event_type")
    kept = FR.until_first_failure(e, "batch", F.struct("ts", "event_id"), F.col("event_type") == "error")
    return kept.groupBy("batch").agg(F.count("*").alias("attempted"), F.count_if(F.col("event_type") != "error").alias("restored"))


@query("win_07_failure_rotation", f"""
WITH last AS (SELECT CASE WHEN user_id % 25 = 0 THEN event_type || ' rare' ELSE event_type END AS source, user_id AS id,
    max(CAST(ts AS DATE)) FILTER (value > 150) AS last_attempt, min(event_id) AS pos FROM events GROUP BY 1, 2),
due AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_attempt ASC NULLS FIRST, pos) AS place, count(*) OVER (PARTITION BY source) AS waiting FROM last
  WHERE last_attempt IS NULL OR last_attempt < {EVENTS_AS_OF_SQL})
SELECT source, id, last_attempt, pos, waiting > 100 AS cut FROM due WHERE place <= 100
""")
def win_07(spark, sf):
    # Event types as sources, users as their pages; a read with a value above 150 failed on its day.
    rare = F.when(F.col("user_id") % 25 == 0, F.concat(F.col("event_type"), F.lit(" rare"))).otherwise(F.col("event_type"))
    e = table(spark, sf, "events").groupBy(rare.alias("source"), F.col("user_id").alias("id")).agg(
        F.max(F.when(F.col("value") > 150, F.to_date("ts"))).alias("last_attempt"), F.min("event_id").alias("pos")
    )
    due = e.where(F.col("last_attempt").isNull() | (F.col("last_attempt") < events_as_of()))
    reads = FR.plan_reads(due, FR.used_budget(e.where("false"), e.select("source", F.lit(0).alias("reserved")).where("false"), "source", "last_attempt", events_as_of()), "source", [F.col("last_attempt").asc_nulls_first(), F.col("pos")])
    waiting = due.groupBy("source").agg((F.count("*") > 100).alias("cut"))
    return reads.join(waiting, "source").select("source", "id", "last_attempt", "pos", "cut")


@query("win_08_change_detection", SNAP + """
, l AS (SELECT *, lag(title) OVER w AS prior_title, lag(price) OVER w AS prior_price, lag(day) OVER w AS prior_day FROM snap WINDOW w AS (PARTITION BY id ORDER BY day))
SELECT id, day, title, price, prior_title, prior_price, prior_day FROM l
WHERE prior_day IS NOT NULL AND (title IS DISTINCT FROM prior_title OR price IS DISTINCT FROM prior_price)
""")
def win_08(spark, sf):
    return P.revisions(B.snap(spark, sf), "id", "day", ["title", "price"])


@query("win_09_session_change", """
WITH d AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sessions FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(sessions) OVER (PARTITION BY id ORDER BY day) AS previous FROM d)
SELECT id, day, sessions, previous, CASE WHEN previous IS NOT NULL AND previous <> sessions THEN 'changed' ELSE 'scheduled' END AS status FROM l
""")
def win_09(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day")).agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sessions")
    )
    prior = F.lag("sessions").over(Window.partitionBy("id").orderBy("day"))
    d = d.withColumn("previous", prior)
    moved = F.col("previous").isNotNull() & (F.col("previous") != F.col("sessions"))
    return d.withColumn("status", F.when(moved, "changed").otherwise("scheduled"))


@query("win_10_seen_range", """
SELECT user_id AS id, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen FROM events GROUP BY 1
""")
def win_10(spark, sf):
    return P.seen_range(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.to_date("ts").alias("day")), "id", "day")


@query("win_11_text_segments", r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)[^.]*\.')) AS piece FROM documents)
SELECT doc_id, count(*) AS pieces, max(length(piece)) AS longest FROM p GROUP BY 1
""")
def win_11(spark, sf):
    # Segmentation by lead stays inside the row: each piece runs to its marker. A split reads the
    # text once; a repeated "up to the marker" match would rescan a long tail without markers.
    parts = F.split("text", r"\.", -1)
    pieces = F.slice(parts, F.lit(1), F.size(parts) - 1)
    d = table(spark, sf, "documents").select("doc_id", F.transform(pieces, lambda x: F.length(x) + 1).alias("n"))
    return d.where(F.size("n") > 0).select("doc_id", F.size("n").cast("bigint").alias("pieces"), F.array_max("n").cast("bigint").alias("longest"))


@query("win_12_first_session", SESSION + f"""
, m AS (SELECT event, min(CAST(day AS VARCHAR) || ' ' || coalesce(clock, '')) AS s FROM session WHERE day >= {AS_OF_SQL} AND NOT cancelled GROUP BY 1)
SELECT event, CAST(s[1:10] AS DATE) AS day, s[12:] AS clock FROM m
""")
def win_12(spark, sf):
    s = K.matching_sessions(B.session(spark, sf).select("event", "day", "clock", "cancelled"), as_of())
    return S.first_session(s)


@query("win_13_next_item", f"""
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= {AS_OF_SQL} ORDER BY 2, 1 LIMIT 1
""")
def win_13(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    return S.next_item(o, F.col("day"), as_of())


@query("win_14_unique_fallback", f"""
WITH k AS (SELECT doc_id, {word_key_sql('text')} AS fp FROM documents)
SELECT fp_id AS fp, doc_id FROM (SELECT md5(fp) AS fp_id, min(doc_id) AS doc_id, count(*) AS n FROM k GROUP BY fp) WHERE n = 1
""")
def win_14(spark, sf):
    # "Exactly one candidate" is an aggregate, not a window count.
    d = table(spark, sf, "documents").select("doc_id", F.md5(T.word_key(F.col("text"))).alias("fp"))
    return d.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1").drop("n")
