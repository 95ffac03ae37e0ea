"""Joins (joi_*)."""

from __future__ import annotations

from marquee.functions import text as T, urls as U, values as V
from marquee.operators import coverage as C, overlay as O, reconcile as R, snapshot as P, tickets as K
from marquee.operators.components import star_edges
from marquee.plans.queries.common import *  # noqa: F403

DAY1, DAY2 = "2024-01-15", "2024-01-16"
PREV = f"prev AS (SELECT id, title, price FROM snap WHERE day = DATE '{DAY1}')"
CURR = f"curr AS (SELECT id, title, price FROM snap WHERE day = DATE '{DAY2}')"


def _day(spark, sf, day):
    return B.snap(spark, sf).where(F.col("day") == F.lit(day).cast("date")).drop("day")


def _typed(df):
    """Snapshot rows in the shape of the merge operator."""
    key = F.col("id").cast("string")
    return df.select(key.alias("id"), key.alias("sourceUid"), F.lit("v").alias("venue"), F.lit("a").alias("address"), "title", "price")


@query("joi_01_snapshot_merge", SNAP + f""", {PREV}, {CURR}
SELECT CAST(c.id AS VARCHAR) AS id, c.title, c.price,
       CASE WHEN p.id IS NULL THEN '{DAY2}' ELSE '{DAY1}' END AS first_seen, false AS missing,
       CAST(CASE WHEN p.id IS NOT NULL AND (p.title IS DISTINCT FROM c.title OR p.price IS DISTINCT FROM c.price) THEN 1 ELSE 0 END AS BIGINT) AS n_revisions
FROM curr c LEFT JOIN prev p ON p.id = c.id
UNION ALL
SELECT CAST(p.id AS VARCHAR), p.title, p.price, '{DAY1}', true, 0 FROM prev p WHERE p.id NOT IN (SELECT id FROM curr)
""")
def joi_01(spark, sf):
    prev = _typed(_day(spark, sf, DAY1)).withColumns({
        "firstSeen": F.lit(DAY1), "lastSeen": F.lit(DAY1), "missingFromSource": F.lit(False),
        "revisions": F.expr("cast(array() as array<struct<title:string,price:double,lastSeen:string>>)"),
    })
    out = P.merge_listings(prev, _typed(_day(spark, sf, DAY2)), DAY2, tracked=["title", "price"])
    return out.select(
        "id", "title", "price", F.col("firstSeen").alias("first_seen"), F.col("missingFromSource").alias("missing"),
        F.size("revisions").cast("bigint").alias("n_revisions"),
    )


@query("joi_02_retain_missing", SNAP + f""", {PREV}, {CURR}
SELECT id, title, price, false AS missing FROM curr
UNION ALL SELECT id, title, price, true FROM prev WHERE id NOT IN (SELECT id FROM curr)
""")
def joi_02(spark, sf):
    return P.retain_missing(_day(spark, sf, DAY1), _day(spark, sf, DAY2), ["id"])


@query("joi_03_upsert", SNAP + f""", {PREV}, {CURR}
SELECT id, title, price FROM curr UNION ALL SELECT id, title, price FROM prev WHERE id NOT IN (SELECT id FROM curr)
""")
def joi_03(spark, sf):
    return P.upsert(_day(spark, sf, DAY1), _day(spark, sf, DAY2), ["id"])


@query("joi_04_review_override", """
WITH last AS (SELECT doc_id, toxic = 0 AND (doc_id + 2) % 5 <> 0 AS ok, CASE WHEN quality = 1 THEN 'reviewed' END AS note FROM labels)
SELECT d.doc_id, coalesce(CASE WHEN ok THEN note END, 'unreviewed') AS "saleNote", coalesce(ok, false) AS reviewed,
  CASE WHEN ok THEN CASE WHEN d.lang = 'en' THEN 2 ELSE 1 END END AS scope
FROM documents d LEFT JOIN last l USING (doc_id)
""")
def joi_04(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("venue"))
    d = docs.select("doc_id", "title", "venue", F.col("doc_id").cast("string").alias("sourceUid"), F.lit("unreviewed").alias("saleNote"))
    # Two reviews of each labelled document, a day apart; some name another title, toxic ones an unsafe scheme.
    r = table(spark, sf, "labels").join(docs, "doc_id").withColumn("day", F.explode(F.array(F.lit(1), F.lit(2))))
    session = lambda venue, time: F.struct(F.lit("2026-01-01").alias("date"), F.lit(time).alias("time"), venue.alias("venue"))
    r = r.select(
        F.col("doc_id").cast("string").alias("uid"), F.when((F.col("doc_id") + F.col("day")) % 5 == 0, "other").otherwise(F.col("title")).alias("title"),
        F.when(F.col("toxic") == 0, "https://review.example/e/1").otherwise("http://review.example/e/1").alias("url"), F.col("day").alias("checkedAt"),
        F.when(F.col("quality") == F.col("day") - 1, "reviewed").alias("saleNote"), F.array(session(F.lit("en"), "19:00"), session(F.col("venue"), "20:00")).alias("sessions"),
    )
    out = O.review_overrides(d, r, ["saleNote"])
    return out.select("doc_id", "saleNote", "reviewed", F.when(F.col("ticketSessions").isNotNull(), F.size("ticketSessions")).alias("scope"))


@query("joi_05_curated_precedence", """
SELECT o_orderkey AS id, o_custkey AS "sourceUid", 'provider' AS origin FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, o_custkey, 'curated' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
UNION ALL SELECT -1 - c_custkey, c_custkey, 'curated' FROM customer WHERE c_acctbal < 0
""")
def joi_05(spark, sf):
    o = table(spark, sf, "orders")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    cols = lambda df, origin: df.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sourceUid"), F.lit(origin).alias("origin"))
    low = table(spark, sf, "customer").where("c_acctbal < 0").select(
        (F.lit(-1) - F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("sourceUid"), F.lit("curated").alias("origin")
    )
    curated = cols(o.where(urgent), "curated").unionByName(low)
    return O.curated_first(cols(o, "provider"), curated)


@query("joi_06_ticket_scope", SESSION + """
SELECT s.event, s.day, s.clock, s.ord FROM session s
WHERE EXISTS (SELECT 1 FROM session t WHERE t.scoped AND t.event = s.event AND t.day = s.day
              AND t.clock IS NOT DISTINCT FROM s.clock)
""")
def joi_06(spark, sf):
    s = B.session(spark, sf)
    return K.covered_sessions(s.select("event", "day", "clock", "ord"), s.where("scoped").select("event", "day", "clock"))


def reconcile_input(spark, sf):
    """Orders as records: the customer is the title and uid, line items are sessions and pages."""
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event"), "o_custkey")
    page = F.concat(F.lit("https://pages.example/"), F.col("o_custkey").cast("string"), F.lit("/"), (F.col("supp") % 7).cast("string"))
    s = B.session(spark, sf).join(owner, "event").groupBy("event").agg(
        # Distinct sessions and pages of one order: a handful of line items.
        F.array_sort(F.collect_set(F.struct(F.col("day").alias("date"), F.col("clock").alias("time")))).alias("sessions"),
        F.collect_set(F.when(F.col("scoped"), page)).alias("urls"),
    )
    l = B.raw_listing(spark, sf).select(
        F.col("id").alias("ord"), "source", F.col("uid").cast("string").alias("uid"), "title", "region", "venue",
        F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("page"),
    )
    empty = F.expr("cast(array() as array<struct<date:date,time:string>>)")
    return l.join(s.withColumnRenamed("event", "ord"), "ord", "left").withColumns({
        "sessions": F.coalesce("sessions", empty), "urls": F.coalesce("urls", F.array().cast("array<string>")),
    })


@query("joi_07_reconcile")
def joi_07(spark, sf):
    df = reconcile_input(spark, sf)
    members = R.clusters(df, exact=False)
    return members.groupBy("cluster").agg(F.count("*").alias("records"), F.max("ord").alias("last_record"))


@query("joi_08_candidate_links", f"""
WITH k AS (SELECT doc_id, lang || '|' || {word_key_sql('text')} AS key FROM documents),
h AS (SELECT key, min(doc_id) AS hub FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT k.doc_id AS u, h.hub AS v FROM k JOIN h USING (key) WHERE k.doc_id <> h.hub
""")
def joi_08(spark, sf):
    # Block key of a record: its normalised text within its language. Stars keep the output linear.
    d = table(spark, sf, "documents")
    key = F.xxhash64("lang", T.word_key(F.col("text")))
    return star_edges(d.select(F.col("doc_id").alias("node"), key.alias("key")))


VARIANTS_SQL = f"""
v AS (SELECT r_name AS region, n_name AS venue, o_custkey % 40 AS page,
        {word_key_sql("CASE o_orderstatus WHEN 'F' THEN c_name WHEN 'O' THEN c_mktsegment || ' ' || c_name ELSE c_name || ' live' END")} AS title
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT DISTINCT region, venue, title FROM v), u AS (SELECT DISTINCT region, venue, title, page FROM v)
"""


def title_variants(spark, sf):
    """Orders as records of one venue a nation: customers under three spellings, pages shared by many customers."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    o = table(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    title = F.when(F.col("o_orderstatus") == "F", F.col("c_name")).when(F.col("o_orderstatus") == "O", F.concat_ws(" ", "c_mktsegment", "c_name")).otherwise(F.concat(F.col("c_name"), F.lit(" live")))
    return o.select(
        F.col("r_name").alias("region_key"), F.col("n_name").alias("venue_key"), F.lit(True).alias("venue_known"), T.word_key(title).alias("title_key"),
        F.array((F.col("o_custkey") % 40).cast("string")).alias("urls"),
    )


@query("joi_08_title_links", f"""
WITH {VARIANTS_SQL}
SELECT a.region, a.venue, a.title, b.title AS other, 'contained' AS how FROM t a JOIN t b USING (region, venue)
WHERE a.title <> b.title AND contains(a.title, b.title) AND length(b.title) >= 8
UNION ALL SELECT DISTINCT region, venue, title, least AS other, 'url' FROM
  (SELECT *, min(title) OVER (PARTITION BY region, venue, page) AS least FROM u) WHERE title <> least
""")
def joi_08_title_links(spark, sf):
    return R.title_links(title_variants(spark, sf)).select(F.col("region_key").alias("region"), F.col("venue_key").alias("venue"), "title", "other", "how")


@query("joi_09_overlay_match", SESSION + """
, raw AS (SELECT event, array_agg(DISTINCT day) AS dates FROM session WHERE platform IN ('KKTIX', 'ibon') GROUP BY 1),
prev AS (SELECT event, array_agg(DISTINCT day) AS dates FROM session WHERE platform IN ('OPENTIX', 'tixCraft') GROUP BY 1),
cust AS (SELECT o_orderkey, o_custkey FROM orders),
fallback AS (
  SELECT r.event AS raw_id, min(p.event) AS prev_id FROM
    (SELECT raw.event, c.o_custkey, unnest(dates) AS day FROM raw JOIN cust c ON c.o_orderkey = raw.event
       WHERE raw.event NOT IN (SELECT event FROM prev)) r
  JOIN (SELECT prev.event, c.o_custkey, unnest(dates) AS day FROM prev JOIN cust c ON c.o_orderkey = prev.event) p
    ON p.o_custkey = r.o_custkey AND p.day = r.day
  GROUP BY 1 HAVING count(DISTINCT p.event) = 1)
SELECT raw.event AS raw_id, CASE WHEN raw.event IN (SELECT event FROM prev) THEN raw.event ELSE f.prev_id END AS prev_id,
       CASE WHEN raw.event IN (SELECT event FROM prev) THEN 'id' WHEN f.prev_id IS NOT NULL THEN 'title_day' ELSE 'new' END AS how
FROM raw JOIN cust ON cust.o_orderkey = raw.event LEFT JOIN fallback f ON f.raw_id = raw.event
""")
def joi_09(spark, sf):
    s = B.session(spark, sf)
    cust = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("title_key"))

    def side(*platforms):
        rows = s.where(F.col("platform").isin(*platforms)).groupBy(F.col("event").alias("id")).agg(F.collect_set("day").alias("dates"))
        return rows.join(cust, "id")

    return O.overlay_matches(side("OPENTIX", "tixCraft"), side("KKTIX", "ibon"))


MATRIX = """matrix AS (SELECT l_suppkey % 97 AS id, count(*) AS items, count(DISTINCT l_orderkey) AS events FROM lineitem GROUP BY 1)"""


def _matrix(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 97).alias("id")).agg(F.count("*").alias("items"), F.count_distinct("l_orderkey").alias("events"))


@query("joi_10_coverage_decoration", f"""
WITH {MATRIX} SELECT s.s_suppkey AS id, s.s_name AS name, m.items, m.events FROM supplier s LEFT JOIN matrix m ON m.id = s.s_suppkey
""")
def joi_10(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return C.decorate(s, _matrix(spark, sf), "id")


@query("joi_11_coverage_only", f"""
WITH {MATRIX} SELECT m.id, m.items, m.events FROM matrix m WHERE m.id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
""")
def joi_11(spark, sf):
    active = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return C.coverage_only(_matrix(spark, sf), active, "id")


@query("joi_12_platform_coverage", SESSION + """
, t AS (SELECT DISTINCT event, day, clock, platform FROM session WHERE scoped),
s AS (SELECT DISTINCT event, day, clock FROM session)
SELECT t.platform, count(DISTINCT s.event) AS event_count, count(*) AS session_count
FROM s JOIN t ON t.event = s.event AND t.day = s.day AND t.clock IS NOT DISTINCT FROM s.clock GROUP BY 1
""")
def joi_12(spark, sf):
    s = B.session(spark, sf)
    return C.platform_coverage(s, s.where("scoped"))


@query("joi_13_frontier_new", """
SELECT url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
""")
def joi_13(spark, sf):
    from marquee.operators.frontier import new_urls

    p = table(spark, sf, "pages").select("page_id", "url")
    l = table(spark, sf, "labels")
    read = l.where("quality = 1").select(F.col("doc_id").alias("page_id"))
    queued = l.where("quality = 0").select(F.col("doc_id").alias("page_id"))
    return new_urls(p, read, queued, key="page_id").select("url")


@query("joi_14_recheck_candidates", """
SELECT CAST(d.doc_id AS VARCHAR) AS uid, d.source AS title FROM documents d JOIN labels l USING (doc_id)
WHERE l.quality = 0 AND d.doc_id % 4 <> 0 AND d.lang <> 'de' AND l.toxic = 0
""")
def joi_14(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sourceUid"), F.col("source").alias("title"), (F.col("lang") == "de").alias("missing"), "doc_id")
    l = table(spark, sf, "labels")
    # Every fourth candidate remembers the title of an earlier day.
    title = F.when(F.col("doc_id") % 4 == 0, "earlier title").otherwise(F.col("title"))
    candidates = l.where("quality = 0").join(d, "doc_id").select(F.col("sourceUid").alias("uid"), title.alias("title"))
    return O.recheck_candidates(candidates, d, l.where("toxic = 1").select(F.col("doc_id").cast("string").alias("uid")))


@query("joi_15_page_by_kind", """
SELECT doc_id, 'concerts' AS kind, contains(lower(text), 'concert') OR contains(lower(text), 'ent') AS positive FROM documents
UNION ALL SELECT doc_id, 'comedy', contains(lower(text), 'comedy') OR contains(lower(text), 'ion') FROM documents
""")
def joi_15(spark, sf):
    # Both kinds are decided in one pass over the text, then unpivoted: no second scan, no product.
    low = F.lower("text")
    d = table(spark, sf, "documents").select(
        "doc_id",
        (low.contains("concert") | low.contains("ent")).alias("concerts"),
        (low.contains("comedy") | low.contains("ion")).alias("comedy"),
    )
    return d.unpivot("doc_id", ["concerts", "comedy"], "kind", "positive")


@query("joi_16_legacy_sources", """
WITH reg AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) <= DATE '2024-01-05'),
st AS (SELECT user_id, max(event_type) AS state FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-05' GROUP BY 1)
SELECT e.user_id AS source, coalesce(st.state, 'pending') AS state
FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN st USING (user_id) WHERE e.user_id NOT IN (SELECT user_id FROM reg)
""")
def joi_16(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "source")
    day = F.to_date("ts")
    reg = e.where((F.col("event_type") == "signup") & (day <= F.lit("2024-01-05").cast("date"))).select("source").distinct()
    st = e.where(day > F.lit("2024-01-05").cast("date")).groupBy("source").agg(F.max("event_type").alias("state"))
    return C.legacy_sources(e, reg, st, "source")


HOSTS = {"thther.example.org": "alpha", "m.ththth.example.net": "beta"}
SUFFIXES = {".example.com": "com-family"}
HOST_CASE = (
    f"CASE WHEN {host_sql('url')} = 'thther.example.org' THEN 'alpha' WHEN {host_sql('url')} = 'm.ththth.example.net' THEN 'beta' "
    f"WHEN {host_sql('url')} LIKE '%.example.com' THEN 'com-family' END"
)


@query("joi_17_dictionary_lookup", f"SELECT page_id, {HOST_CASE} AS platform FROM pages")
def joi_17(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.platform_of(F.col("url"), HOSTS, SUFFIXES).alias("platform"))


@query("joi_18_session_facts", """
SELECT c.conv_id AS event, c.turn AS day, CASE WHEN c.turn % 2 = 1 THEN 'x' END AS clock, c.role AS performers, f.n AS host
FROM conversations c LEFT JOIN (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'x' END AS clock, CAST(max(length(text)) AS VARCHAR) AS n
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2, 3) f
ON f.conv_id = c.conv_id AND f.turn = c.turn AND f.clock IS NOT DISTINCT FROM CASE WHEN c.turn % 2 = 1 THEN 'x' END
""")
def joi_18(spark, sf):
    c = table(spark, sf, "conversations")
    clock = F.when(F.col("turn") % 2 == 1, "x")
    sessions = c.select(F.col("conv_id").alias("event"), F.col("turn").alias("day"), clock.alias("clock"), F.col("role"))
    facts = c.where("role = 'assistant'").groupBy(F.col("conv_id").alias("event"), F.col("turn").alias("day"), clock.alias("clock")).agg(
        F.lit("host").alias("performers"), F.max(F.length("text")).cast("string").alias("host")
    )
    out = K.with_session_facts(sessions, facts)
    return out.select("event", "day", "clock", F.col("role").alias("performers"), "host")


@query("joi_19_registry_status", """
WITH snapshots AS (SELECT user_id AS id, 'ok' AS state, count(*) AS discovered, count(*) FILTER (event_type = 'purchase') AS included
  FROM events GROUP BY 1)
SELECT s.s_suppkey AS id, s.s_name AS name, coalesce(n.state, 'pending') AS state, n.discovered, n.included
FROM supplier s LEFT JOIN snapshots n ON n.id = s.s_suppkey
""")
def joi_19(spark, sf):
    reg = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    e = table(spark, sf, "events")
    snaps = e.groupBy(F.col("user_id").alias("id")).agg(
        F.first(F.lit("ok")).alias("state"), F.count("*").alias("discovered"), F.count_if(F.col("event_type") == "purchase").alias("included")
    )
    return C.with_pending_status(reg, snaps, "id")
