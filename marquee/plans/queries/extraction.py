"""Extraction from pages and texts (ext_*)."""

from __future__ import annotations

from marquee.functions import dates as D, text as T, urls as U, values as V
from marquee.operators import adapters as A, calendar as CAL, extract as X, reconcile as RC
from marquee.plans import builds as BU
from marquee.plans.queries.common import *  # noqa: F403
from marquee.plans.queries.quality import H1_SQL, H_ALL, MAIN_SQL, TITLE_SQL


@query("ext_01_title_headings", f"SELECT page_id, {clean_sql(TITLE_SQL)} AS title, {clean_sql(H1_SQL)} AS heading FROM pages")
def ext_01(spark, sf):
    return X.title_and_headings(table(spark, sf, "pages"), F.col("html")).select("page_id", "title", "heading")


ANCHOR_SQL = """(?is)<a\\s[^>]*?href=["''']([^"''']*)["'''][^>]*>(.*?)</a>""".replace("'''", "''")
LINKS_SQL = f"""links AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 1)) AS href,
  unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 2)) AS label FROM pages)"""


@query("ext_02_cards", f"""
WITH {LINKS_SQL}, l AS (SELECT page_id, page_url, {unescape_sql('href')} AS href, {clean_sql('label')} AS label FROM links),
a AS (SELECT page_id, page_url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN lower({url_sql('page_url', 1)}) || ':' || href
  WHEN starts_with(href, '/') THEN lower({url_sql('page_url', 1)}) || '://' || {url_sql('page_url', 2)} || href END AS url, label FROM l)
SELECT page_id, url, count(*) AS cards, '' AS badge FROM a WHERE {host_sql('url')} = {host_sql('page_url')} AND {url_sql('url', 4)} = '' AND {url_sql('url', 5)} = '' AND label <> '' GROUP BY 1, 2
""")
def ext_02(spark, sf):
    links = X.anchors(table(spark, sf, "pages").withColumnRenamed("url", "page_url"), "page_url", "html", ["page_id"])
    one = X.cards(links, "page_url", ["page_id"])
    n = links.where(F.length("label") > 0).groupBy("page_id", "url").agg(F.count("*").alias("cards"))
    return one.join(n, ["page_id", "url"]).select("page_id", "url", "cards", "badge")


FIELD_RULES = {"lang": r'<html lang="([a-z]+)"', "style": r"(?is)<style>(.*?)</style>", "ad": r"<!-- ad (\d+) -->"}


@query("ext_03_field_rules", f"""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, {clean_sql("regexp_extract(html, '(?is)<style>(.*?)</style>', 1)")} AS style,
  regexp_extract(html, '<!-- ad (\\d+) -->', 1) AS ad FROM pages
""")
def ext_03(spark, sf):
    return X.fields_by_rules(table(spark, sf, "pages"), F.col("html"), FIELD_RULES).select("page_id", *FIELD_RULES)


ADAPTERS = [("dated", "Main Hall", "north", "1 Main Street", "iso"), ("parted", "Old Depot", "south", "2 Depot Road", "year_day")]
ADAPTER_RULES = [
    ("dated", "title", r'(?s)<p class="inner">(.*?)</p>'), ("dated", "date", r"(\d{4}-\d{2}-\d{2})"), ("dated", "period", r'<p class="date">(.*?)</p>'), ("dated", "venue", r'<p class="place">(.*?)</p>'),
    ("parted", "title", r"(?s)<h1[^>]*>(.*?)</h1>"), ("parted", "year", r'<span class="y">(\d{4})</span>'), ("parted", "day", r'<span class="md">([\d.]+)</span>'), ("parted", "venue", r"<h3>At</h3><i>(.*?)</i>"),
]


@query("ext_03_source_adapters", f"""
WITH {B.RAW_LISTING_SQL}, p AS (SELECT *, id % 2 = 0 AS dated, status = 'P' OR end_day IS NULL AS one FROM raw_listing)
SELECT id, CASE WHEN dated THEN 'dated' ELSE 'parted' END AS source, CASE WHEN uid % 11 = 0 THEN NULL ELSE title END AS title, start_day AS start,
  CASE WHEN one THEN CASE WHEN dated AND price < 100000 THEN start_day END ELSE greatest(start_day, end_day) END AS "end",
  CASE WHEN dated THEN 'Main Hall' ELSE 'Old Depot' END || ' · ' || venue AS venue, CASE WHEN dated THEN 'north' ELSE 'south' END AS region,
  CASE WHEN uid % 11 = 0 THEN 'missing title or venue' END AS reason
FROM p WHERE one OR end_day >= start_day
""")
def ext_03_adapters(spark, sf):
    # The driver's pages carry no such facts, so each order becomes a page of one of two sources around its own.
    p = B.raw_listing(spark, sf).withColumn("one", (F.col("status") == "P") | F.col("end_day").isNull()).where("one OR end_day >= start_day")
    day = lambda c, form: F.date_format(c, form)
    title = F.when(F.col("uid") % 11 == 0, "").otherwise(F.col("title"))
    dates = F.when(~F.col("one"), F.concat(day("start_day", "yyyy-MM-dd"), F.lit(" ~ "), day("end_day", "yyyy-MM-dd")))
    dates = dates.otherwise(F.concat(day("start_day", "yyyy-MM-dd"), F.when(F.col("price") < 100000, "").otherwise(F.lit(" 起"))))
    dated = F.concat(F.lit('<p class="inner">'), title, F.lit('</p><p class="date">'), dates, F.lit('</p><p class="place">'), F.col("venue"), F.lit("</p>"))
    span = lambda c: F.concat(F.lit('<span class="y">'), day(c, "yyyy"), F.lit('</span><span class="md">'), day(c, "M.d"), F.lit("</span>"))
    parted = F.concat(F.lit("<h1 id='t'>"), title, F.lit("</h1>"), span("start_day"), F.when(F.col("one"), "").otherwise(span("end_day")), F.lit("<h3>At</h3><i>"), F.col("venue"), F.lit("</i>"))
    even = F.col("id") % 2 == 0
    none = F.lit(None).cast("string")
    pages = p.select("id", F.when(even, "dated").otherwise("parted").alias("source"), F.when(even, dated).otherwise(parted).alias("html"), none.alias("venue_hint"), none.alias("badge"), none.alias("prior_price"))
    registry = A.registry(
        spark.createDataFrame(ADAPTERS, "source string, name string, region string, address string, dates string"), spark.createDataFrame(ADAPTER_RULES, "source string, field string, pattern string")
    )
    return A.detail_facts(pages, registry).select("id", "source", "title", "start", "end", "venue", "region", "reason")


@query("ext_04_json_ld", """
SELECT event_id AS page, event_type AS name, CAST(json_extract(props, '$.k') AS INTEGER) AS low, value > 20 AS cancelled FROM events
""")
def ext_04(spark, sf):
    # The driver's pages carry no JSON-LD, so each event row becomes a page around its own facts.
    block = F.to_json(F.struct(
        F.lit("Event").alias("@type"), F.col("event_type").alias("name"),
        F.when(F.col("value") > 20, "EventCancelled").otherwise(F.lit("EventScheduled")).alias("eventStatus"),
        F.struct(F.from_json("props", "k INT")["k"].alias("lowPrice")).alias("offers"),
    ))
    html = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script><script type='application/ld+json'>{broken</script>"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("page"), html.alias("html"))
    return X.json_ld_events(e, "html", ["page"]).select("page", "name", "low", "cancelled")


@query("ext_05_feed_text", """
SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%H:%M') AS clock, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) + 1 END AS end_day,
  'hall ' || user_id AS venue, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ' road' END AS address FROM events
""")
def ext_05(spark, sf):
    f = lambda p, c=F.col("ts"): F.date_format(c, p)
    tail = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ~ "), f("yyyy/MM/dd HH:mm", F.col("ts") + F.expr("INTERVAL 1 DAY")))).otherwise(F.lit("~23:59"))
    place = F.concat(F.lit("hall "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" / "), F.col("event_type"), F.lit(" road"))).otherwise(F.lit("")))
    text = F.concat(F.lit("時間："), f("yyyy/MM/dd HH:mm"), F.lit("(+0800)"), tail, F.lit("\n地點："), place)
    return table(spark, sf, "events").select("event_id", X.feed_time_place(text).alias("x")).select("event_id", "x.*")


@query("ext_06_text_sessions", """
SELECT l_orderkey AS event, l_linenumber AS ord, CAST(l_shipdate AS DATE) AS day, '19:30' AS clock FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) + 1, '16:00' FROM lineitem
""")
def ext_06(spark, sf):
    d = lambda p, n: F.date_format(F.date_add(F.col("l_shipdate").cast("date"), n), p)
    text = F.concat(
        F.lit("介紹 活動日期/時間："), d("yyyy/MM/dd", 0), F.lit("(六)19：30(18:30開放入場)"),
        d("yyyy / M / d", 1), F.lit("（日）14:30開場 / 16:00開演主辦單位：x"),
    )
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("ord"), text.alias("text"))
    found = X.text_sessions(li, F.col("text"), ["event", "ord"]).where("valid")
    return found.select("event", "ord", F.col("date").alias("day"), F.col("time").alias("clock"))


@query("ext_07_labelled_field", f"""
WITH d AS (SELECT doc_id, '票價：' || text || '※ note' AS t FROM documents)
SELECT doc_id, md5(substr({clean_sql("regexp_extract(t, '(?s)票價[ ]*[:：][ ]*(.*?)(?:※|$)', 1)")}, 1, 160)) AS field FROM d
""")
def ext_07(spark, sf):
    t = F.concat(F.lit("票價："), F.col("text"), F.lit("※ note"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.labelled_field(t, "票價", "※")).alias("field"))


@query("ext_08_range_semantics", """
WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 3)::INT AS b FROM orders)
SELECT id, CASE WHEN a = b THEN 1 WHEN b - a <= 1 THEN 2 END AS sessions FROM e
""")
def ext_08(spark, sf):
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, (F.col("o_orderkey") % 3).cast("int"))
    text = F.concat(F.date_format(a, "yyyy.MM.dd"), F.lit(" 19:30 (六) - "), F.date_format(b, "yyyy.MM.dd"), F.lit(" 21:30"))
    s = D.sessions_from_points(X.dotted_points(text))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(s.isNotNull(), F.size(s)).cast("bigint").alias("sessions"))


@query("ext_09_date_bounds", """
WITH e AS (SELECT l_orderkey AS event, list_sort(array_agg(DISTINCT CAST(l_shipdate AS DATE))) AS d, bool_or(l_returnflag = 'R') AS open_ended FROM lineitem GROUP BY 1)
SELECT event, CASE WHEN len(d) <= 2 THEN d[1] END AS start_day, CASE WHEN len(d) = 1 AND NOT open_ended THEN d[1] WHEN len(d) = 2 THEN d[2] END AS end_day,
  CASE WHEN len(d) > 2 THEN 'two explicit dates required' END AS problem FROM e
""")
def ext_09(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(
        F.min(F.col("l_shipdate").cast("date")).alias("a"), F.max(F.col("l_shipdate").cast("date")).alias("b"),
        F.count_distinct(F.col("l_shipdate").cast("date")).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("open"),
    )
    # Bounds and the number of dates tell all that the rule needs; three entries stand for more than two.
    d = F.slice(F.array("a", "b", "b"), 1, F.least(F.lit(3), F.col("n").cast("int")))
    return e.select("event", D.period_from_dates(d, F.col("open")).alias("p")).select(
        "event", F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"), F.col("p.problem").alias("problem")
    )


@query("ext_10_main_text", f"SELECT page_id, length({MAIN_SQL}) AS n_chars, md5({MAIN_SQL}) AS digest FROM pages")
def ext_10(spark, sf):
    m = X.main_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(m).cast("bigint").alias("n_chars"), F.md5(m).alias("digest"))


@query("ext_11_ticket_links", f"""
WITH {LINKS_SQL}, p AS (SELECT page_id, page_url, href, row_number() OVER () AS g FROM links),
k AS (SELECT page_id, count(*) FILTER (starts_with(href, '/') AND NOT starts_with(href, '//') AND href <> '/' AND lower({url_sql('page_url', 1)}) = 'https'
   AND {host_sql('page_url')} LIKE '%.example.com') AS n FROM p GROUP BY 1)
SELECT page_id, least(n, 3) AS links FROM k WHERE n > 0
""")
def ext_11(spark, sf):
    links = X.anchors(table(spark, sf, "pages").withColumnRenamed("url", "page_url"), "page_url", "html", ["page_id"])
    t = X.ticket_links(links, ["page_id"], {"none.example": "none"}, {".example.com": "com-family"})
    return t.groupBy("page_id").agg(F.count("*").alias("links"))


@query("ext_12_calendar_unpivot", """
SELECT l_orderkey AS id, l_linenumber AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'Practice 1' END AS missing,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS timed, CAST(l_shipdate AS DATE) - 2 AS first_item FROM lineitem
""")
def ext_12(spark, sf):
    day = F.col("l_shipdate").cast("date")
    one = lambda n, clock: F.struct(F.date_sub(day, n).alias("date"), clock.alias("time"))
    items = CAL.unpivot_sessions([
        (one(2, F.when(F.col("l_linenumber") % 2 == 1, "10:00:00Z")), "Practice 1"),
        (F.lit(None).cast("struct<date:date,time:string>"), "Sprint"),
        (one(0, F.lit("14:00:00Z")), "Race"),
    ])
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", items.alias("i"))
    gone = F.filter("i", lambda s: s["time"].isNull())
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.get(gone, F.lit(0))["label"].alias("missing"),
        (F.size("i") - F.size(gone)).cast("bigint").alias("timed"), F.array_min(F.transform("i", lambda s: s["date"])).alias("first_item"),
    )


@query("ext_12_calendar_races", """
SELECT o_orderkey AS race, CASE o_orderstatus WHEN 'F' THEN 'monaco' WHEN 'O' THEN 'italy' ELSE 'c' || (o_custkey % 10) END AS id,
  year(o_orderdate) = 1997 AND o_orderpriority <> '5-LOW' AS valid, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS sessions,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Practice 1' ELSE '' END AS missing,
  CAST(CAST(o_orderdate AS DATE) - CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 2 END AS VARCHAR) AS weekend_start FROM orders
""")
def ext_12_races(spark, sf):
    # Orders as calendar rows: low ones carry a race time without a zone, urgent ones no practice time.
    day = F.col("o_orderdate").cast("date")
    point = lambda d, t: F.struct(d.cast("string").alias("date"), t.alias("time"))
    none = F.lit(None).cast("struct<date:string,time:string>")
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("race"), F.year("o_orderdate").cast("string").alias("season"),
        F.when(F.col("o_orderstatus") == "F", "Monaco Grand Prix").when(F.col("o_orderstatus") == "O", "Italian Grand Prix").otherwise(F.lit("Town Grand Prix")).alias("raceName"),
        F.struct(F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")).alias("circuitId")).alias("Circuit"), day.cast("string").alias("date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "12:00:00").otherwise(F.lit("12:00:00Z")).alias("time"),
        point(F.date_sub(day, 2), F.when(F.col("o_orderpriority") != "1-URGENT", "10:00:00Z")).alias("FirstPractice"),
        *[none.alias(f) for f, _ in V.CALENDAR_FIELDS if f != "FirstPractice"],
    )
    out = CAL.races(raw, "1997")
    return out.select("race", "id", "valid", F.size("sessions").cast("bigint").alias("sessions"), F.array_join("missingTimes", ",").alias("missing"), F.col("weekendStart").alias("weekend_start"))


@query("ext_12_calendar_seasons", """
WITH o AS (SELECT *, o_custkey % 12 AS s, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
raw AS (SELECT s, CASE WHEN s % 4 = 2 THEN CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) ELSE k END AS id, 'Race ' || k AS name, s = 4 AND o_orderkey % 50 = 0 AS bad
  FROM o WHERE o_orderkey % 10 <> 3 AND (s % 4 <> 3 OR o_orderkey % 10 < 5)),
ids AS (SELECT s, id, count(*) AS n, bool_or(bad) AS bad FROM raw GROUP BY 1, 2),
seen AS (SELECT s, sum(n) AS n, max(n) AS most, bool_or(bad) AS bad FROM ids GROUP BY 1), held AS (SELECT s, count(*) AS held FROM o WHERE s <> 8 GROUP BY 1),
v AS (SELECT s, CASE WHEN s % 4 = 1 THEN 'INCOMPLETE_CALENDAR' WHEN bad THEN 'INVALID_RACE' WHEN most > 1 THEN 'DUPLICATE_RACE' WHEN n < greatest(15, floor(coalesce(held, 0) * 0.8)) THEN 'DIMINISHED_CALENDAR' END AS reason
  FROM seen LEFT JOIN held USING (s)),
fresh AS (SELECT s, id, name FROM raw JOIN v USING (s) WHERE reason IS NULL)
SELECT 's' || s AS season, id, name, 'ok' AS status, 'now' AS last_success, NULL AS reason FROM fresh
UNION ALL SELECT 's' || s, k, 'old', CASE WHEN reason IS NULL THEN 'unconfirmed' ELSE 'ok' END, 'before', reason FROM o LEFT JOIN v USING (s) WHERE s <> 8 AND (s, k) NOT IN (SELECT s, id FROM fresh)
""")
def ext_12_seasons(spark, sf):
    # Orders as races, customers dealt to twelve seasons: some state a wrong total, repeat an id, lost half
    # of their races or hold an unreadable day; season 8 is new, and a tenth of all races is no longer listed.
    key, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    o = table(spark, sf, "orders").withColumn("s", F.col("o_custkey") % 12).withColumn("season", F.concat(F.lit("s"), F.col("s").cast("string")))
    none = F.lit(None).cast("struct<date:string,time:string>")
    raw = o.where((n % 10 != 3) & ((F.col("s") % 4 != 3) | (n % 10 < 5))).select(
        "season", F.col("season").alias("tableSeason"), F.concat(F.lit("Race "), key).alias("raceName"),
        F.struct(F.when(F.col("s") % 4 == 2, (n - n % 2).cast("string")).otherwise(key).alias("circuitId")).alias("Circuit"),
        F.when((F.col("s") == 4) & (n % 50 == 0), "soon").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date"), F.lit("12:00:00Z").alias("time"),
        *[none.alias(f) for f, _ in V.CALENDAR_FIELDS],
    )
    declared = raw.groupBy("season").agg(F.count("*").alias("total")).withColumn("total", F.when(F.expr("cast(substr(season, 2) as int) % 4 = 1"), F.col("total") + 1).otherwise(F.col("total")))
    previous = o.where("s <> 8").select("season", key.alias("id"), F.lit("old").alias("name"), F.lit("ok").alias("status"), F.lit("before").alias("lastSuccess"))
    out, verdicts = BU.calendar_seasons(raw, declared, previous, "now")
    return out.join(verdicts, "season", "left").select("season", "id", "name", "status", F.col("lastSuccess").alias("last_success"), "reason")


@query("joi_08_contained_titles", f"""
WITH t AS (SELECT DISTINCT {host_sql('url')} AS host, {word_key_sql(clean_sql(TITLE_SQL))} AS k FROM pages),
l AS (SELECT * FROM t WHERE length(k) >= 8)
SELECT a.host AS region_key, a.k AS title_key, b.k AS hub FROM l a JOIN l b ON a.host = b.host AND a.k <> b.k AND contains(a.k, b.k)
""")
def joi_08_contained(spark, sf):
    p = table(spark, sf, "pages").select(
        U.host(F.col("url")).alias("region_key"), F.lit("v").alias("venue_key"), T.word_key(T.clean(X.page_title(F.col("html")))).alias("title_key"),
        F.lit(True).alias("venue_known"),
    )
    return RC.contained_titles(p).select("region_key", "title_key", "hub")
