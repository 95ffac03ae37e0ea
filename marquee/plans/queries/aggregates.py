"""Aggregations (agg_*)."""

from __future__ import annotations

from marquee.functions import text as T, values as V
from marquee.operators import calendar as CAL, coverage as C, extract as X, normalize as N, quality as Q, search as S, tickets as K
from marquee.plans.queries.common import *  # noqa: F403
from marquee.plans.queries.joins import HOSTS, HOST_CASE, SUFFIXES
from marquee.sources import readers as R


@query("agg_01_min_max_collapse", """
SELECT l_partkey AS id, CAST(min(l_shipdate) AS DATE) AS start_day, CAST(max(l_shipdate) AS DATE) AS end_day,
       max_by(l_suppkey, (l_orderkey, l_linenumber, l_extendedprice)) AS supp,
       max_by(l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS quantity
FROM lineitem GROUP BY 1
""")
def agg_01(spark, sf):
    day = F.col("l_shipdate").cast("date")
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), day.alias("start_day"), day.alias("end_day"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("quantity"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("o"),
    )
    return N.collapse(li, "id", "start_day", "end_day", F.col("o")).drop("o")


@query("agg_02_session_set", SESSION + """
SELECT event, count(*) AS n_sessions, string_agg(CAST(day AS VARCHAR) || ' ' || coalesce(clock, ''), ',' ORDER BY day, coalesce(clock, '')) AS sessions
FROM (SELECT DISTINCT event, day, clock FROM session) GROUP BY 1
""")
def agg_02(spark, sf):
    # Distinct sessions first (combined map-side); what is collected is bounded by days times clocks.
    s = B.session(spark, sf).select("event", "day", F.coalesce("clock", F.lit("")).alias("clock")).distinct()
    arr = F.array_sort(F.collect_list(F.struct("day", "clock")))
    return s.groupBy("event").agg(arr.alias("a")).select(
        "event", F.size("a").cast("bigint").alias("n_sessions"),
        F.array_join(F.transform("a", lambda x: F.concat_ws(" ", x["day"].cast("string"), x["clock"])), ",").alias("sessions"),
    )


@query("agg_03_price_conflict", f"""
WITH p AS (SELECT l_orderkey AS event, l_linenumber AS ord, CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INTEGER) END AS price FROM lineitem),
f AS (SELECT event, arg_min_null(price, (ord, coalesce(price, -1))) AS first_price FROM p GROUP BY 1)
SELECT p.event, CASE WHEN count(*) FILTER (price IS NOT NULL AND price IS DISTINCT FROM first_price) > 0 THEN '{V.PRICE_MIXED}'
       ELSE CAST(first_price AS VARCHAR) END AS price
FROM p JOIN f USING (event) GROUP BY p.event, first_price
""")
def agg_03(spark, sf):
    p = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("ord"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("int")).alias("price"),
    )
    a = p.groupBy("event").agg(
        F.min_by("price", F.struct("ord", F.coalesce("price", F.lit(-1)))).alias("first"), F.min("price").alias("lo"), F.max("price").alias("hi")
    )
    return a.select("event", N.collapsed_price(F.col("first").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string")).alias("price"))


DECIDED = """decided AS (SELECT doc_id, source,
  CASE WHEN contains(lower(text), 'workshop') THEN 'excluded' WHEN lang = 'en' THEN 'included' ELSE 'pending' END AS decision,
  CASE WHEN contains(lower(text), 'workshop') THEN 'COURSE' WHEN lang = 'en' THEN 'LANGUAGE_OK' ELSE 'NO_EVIDENCE' END AS reason FROM documents)"""


def _decided(spark, sf):
    d = table(spark, sf, "documents")
    course = F.lower("text").contains("workshop")
    return d.select(
        "doc_id", "source",
        F.when(course, "excluded").when(F.col("lang") == "en", "included").otherwise("pending").alias("decision"),
        F.when(course, "COURSE").when(F.col("lang") == "en", "LANGUAGE_OK").otherwise("NO_EVIDENCE").alias("reason"),
    )


@query("agg_04_decision_counters", f"""
WITH {DECIDED} SELECT source, count(*) AS discovered, count(*) FILTER (decision = 'included') AS included,
  count(*) FILTER (decision = 'excluded') AS excluded, count(*) FILTER (decision = 'pending') AS pending,
  count(*) FILTER (decision = 'failed') AS failed FROM decided GROUP BY 1
""")
def agg_04(spark, sf):
    return Q.decision_counts(_decided(spark, sf), ["source"])


@query("agg_04_reason_histogram", f"WITH {DECIDED} SELECT source, decision, reason, count(*) AS n FROM decided GROUP BY 1, 2, 3")
def agg_04_reasons(spark, sf):
    return Q.reason_counts(_decided(spark, sf), ["source"])


@query("agg_05_reject_stats", """
SELECT source, count(*) AS input_count, count(*) FILTER (n_chars > 0 AND NOT contains(text, 'the')) AS valid_count,
  count(*) FILTER (NOT (n_chars > 0 AND NOT contains(text, 'the'))) AS rejected_count,
  count(DISTINCT CASE WHEN n_chars > 0 AND NOT contains(text, 'the') THEN md5(text) END) AS event_count
FROM documents GROUP BY 1
""")
def agg_05(spark, sf):
    d = table(spark, sf, "documents")
    rejected = ~((F.col("n_chars") > 0) & ~F.col("text").contains("the"))
    return Q.reject_stats(d, rejected, F.md5("text"), ["source"])


@query("agg_06_ticket_merge", SESSION + """
, tickets AS (SELECT event, supp AS url, CASE WHEN ord % 3 = 0 THEN NULL ELSE part % 5 END AS price, NULL::VARCHAR AS sale_at, day, clock, ord FROM session WHERE scoped),
valid AS (SELECT DISTINCT event, day, clock FROM session WHERE NOT cancelled)
SELECT t.event, t.url, t.price, t.day, t.clock, min(t.ord) AS ord FROM tickets t
WHERE EXISTS (SELECT 1 FROM valid v WHERE v.event = t.event AND v.day = t.day AND v.clock IS NOT DISTINCT FROM t.clock)
GROUP BY ALL
""")
def agg_06(spark, sf):
    s = B.session(spark, sf)
    tickets = s.where("scoped").select(
        "event", F.col("supp").alias("url"), F.when(F.col("ord") % 3 != 0, F.col("part") % 5).alias("price"),
        F.lit(None).cast("string").alias("sale_at"), "day", "clock", "ord",
    )
    return K.merge_tickets(tickets, s.where(~F.col("cancelled"))).drop("sale_at")


@query("agg_07_coverage_report", SESSION + """
, per AS (SELECT event, count(*) AS n, min(day) AS lo, max(day) AS hi FROM session GROUP BY 1)
SELECT o_orderpriority AS source, o_orderstatus AS kind, count(DISTINCT o_custkey) AS detail_urls, min(lo) AS date_from, max(hi) AS date_through,
       count(*) AS stored_events, coalesce(sum(n), 0)::BIGINT AS stored_sessions
FROM orders LEFT JOIN per ON per.event = o_orderkey GROUP BY 1, 2
""")
def agg_07(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("kind"),
        F.col("o_custkey").alias("url"),
    )
    return C.scope_report(o, B.session(spark, sf).select("event", "day"), ["source", "kind"])


@query("agg_08_source_rollup", """
SELECT user_id AS source, max(coalesce(CASE WHEN event_type = 'view' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END, '')) AS checked_at,
       max(coalesce(CASE WHEN event_type = 'purchase' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END, '')) AS last_success
FROM events GROUP BY 1
""")
def agg_08(spark, sf):
    day = F.to_date("ts").cast("string")
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("source"),
        F.when(F.col("event_type") == "view", day).alias("reviewed_at"),
        F.when(F.col("event_type") == "purchase", day).alias("last_success"),
    )
    return C.source_rollup(e, "source")


@query("agg_09_curated_stats", """
SELECT d.source, count(*) AS n, max(n_chars) AS verified, count(*) FILTER (l.toxic = 1) AS uncertain
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
""")
def agg_09(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(
        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    return C.curated_stats(d, "source", F.col("n_chars"), F.col("toxic") == 1)


@query("agg_10_active_count", PERIOD + f"""
SELECT source, count(*) FILTER (end_day >= {AS_OF_SQL} AND NOT missing) AS active FROM forward_period GROUP BY 1
""")
def agg_10(spark, sf):
    return S.active_count(B.forward_period(spark, sf), as_of(), ["source"])


@query("agg_11_headline", PERIOD + f"""
SELECT count(*) FILTER ((end_day IS NULL OR end_day >= {AS_OF_SQL}) AND note IS NULL) AS active,
       count(*) FILTER ((end_day IS NULL OR end_day >= {AS_OF_SQL}) AND first_seen = {AS_OF_SQL}) AS new_today, count(*) AS events
FROM forward_period
""")
def agg_11(spark, sf):
    return S.headline(B.forward_period(spark, sf), as_of())


FACET_DAYS = 400


@query("agg_12_facets", LISTING + f"""
, x AS (SELECT region, venue, source, region = 'ASIA' AS p_region, venue IN ('NATION_2', 'NATION_7', 'NATION_12') AS p_venue, source = '5-LOW' AS p_source FROM listing)
SELECT 'region' AS facet, region AS value, count(*) AS n FROM x WHERE p_source GROUP BY 2
UNION ALL SELECT 'venue', venue, count(*) FROM x WHERE p_region AND p_source GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM x WHERE p_region AND p_venue GROUP BY 2
""")
def agg_12(spark, sf):
    predicates = {
        "region": F.col("region") == "ASIA",
        "venue": F.col("venue").isin("NATION_2", "NATION_7", "NATION_12"),
        "source": F.col("source") == "5-LOW",
    }
    # Relaxing the region also relaxes the venue.
    return S.facets(B.listing(spark, sf), predicates, {"region": ["venue"]})


@query("agg_12_live_facets", LIVE + """
, x AS (SELECT *, region = 'ASIA' AS p_region, venue = 'NATION_2' AS p_venue, genre = '5-LOW' AS p_genre, platform = 'ibon' AS p_platform FROM live)
SELECT 'region' AS facet, region AS value, count(DISTINCT id) AS n FROM x WHERE p_genre AND p_platform GROUP BY 2
UNION ALL SELECT 'venue', venue, count(DISTINCT id) FROM x WHERE p_region AND p_genre AND p_platform GROUP BY 2
UNION ALL SELECT 'genre', genre, count(DISTINCT id) FROM x WHERE p_region AND p_venue AND p_platform GROUP BY 2
UNION ALL SELECT 'platform', platform, count(DISTINCT id) FROM x WHERE p_region AND p_venue AND p_genre GROUP BY 2
""")
def agg_12_live(spark, sf):
    return S.live_facets(B.live(spark, sf), S.LiveFilter(region="ASIA", venue="NATION_2", genre="5-LOW", platform="ibon"))


@query("agg_13_platform_values", SESSION + f"""
, t AS (SELECT DISTINCT event, day, clock, platform FROM session WHERE scoped)
SELECT coalesce(t.platform, '{V.UNVERIFIED_PLATFORM}') AS platform, count(*) AS sessions
FROM session s LEFT JOIN t ON t.event = s.event AND t.day = s.day AND t.clock IS NOT DISTINCT FROM s.clock GROUP BY 1
""")
def agg_13(spark, sf):
    s = B.session(spark, sf)
    out = S.session_platforms(s.select("event", "day", "clock"), s.where("scoped"))
    return out.groupBy("platform").agg(F.count("*").alias("sessions"))


@query("agg_13_venue_values", LISTING + "SELECT region, venue, count(*) AS n FROM listing GROUP BY 1, 2")
def agg_13_venues(spark, sf):
    return B.listing(spark, sf).groupBy("region", "venue").agg(F.count("*").alias("n"))


@query("agg_14_venue_options", LISTING + """
SELECT region, count(DISTINCT venue) AS venues, count(*) AS listings FROM listing GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT venue), count(*) FROM listing
""")
def agg_14(spark, sf):
    # (region, venue) first, then region subtotal and grand total over that small table.
    pairs = B.listing(spark, sf).groupBy("region", "venue").agg(F.count("*").alias("n"))
    return pairs.rollup("region").agg(F.count_distinct("venue").alias("venues"), F.sum("n").alias("listings"))


@query("agg_14_status_histogram", LISTING + "SELECT status, count(*) AS n FROM listing GROUP BY 1")
def agg_14_status(spark, sf):
    return B.listing(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("agg_15_weekend_start", """
SELECT o_orderkey AS id, least(CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE)) AS weekend_start, CAST(o_orderdate AS DATE) AS weekend_end
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, o_orderdate
""")
def agg_15(spark, sf):
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("first"))
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.join(first, o.o_orderkey == first.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"), CAL.weekend_start(day, F.array("first")).alias("weekend_start"), day.alias("weekend_end")
    )


@query("agg_16_declared_total", """
SELECT o_orderpriority AS source, count(*) AS n, count(DISTINCT o_orderkey) AS ids, count(*) = count(DISTINCT o_orderkey) AS unique_ids,
       count(*) = 3000 AS total_agrees FROM orders GROUP BY 1
""")
def agg_16(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), "o_orderkey").agg(F.count("*").alias("c"))
    return o.groupBy("source").agg(F.sum("c").alias("n"), F.count("*").alias("ids")).select(
        "source", "n", "ids", (F.col("n") == F.col("ids")).alias("unique_ids"), (F.col("n") == 3000).alias("total_agrees")
    )


@query("agg_17_price_range", """
WITH b AS (SELECT l_orderkey AS event, min(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS INTEGER) * 100 END) AS lo,
  max(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) * 100 END) AS hi FROM lineitem GROUP BY 1)
SELECT event, CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN lo = hi THEN 'NT$' || format('{:,}', lo)
  ELSE 'NT$' || format('{:,}', lo) || '–' || format('{:,}', hi) END AS price FROM b
""")
def agg_17(spark, sf):
    amount = F.col("l_quantity").cast("int") * 100
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(
        F.min(F.when(F.col("l_returnflag") != "N", amount)).alias("lo"), F.max(F.when(F.col("l_linestatus") == "F", amount)).alias("hi")
    )
    return b.select("event", T.price_range(F.col("lo"), F.col("hi")).alias("price"))


@query("agg_18_page_rollup", """
WITH f AS (SELECT user_id, min_by(event_type, (ts, event_id)) AS name FROM events GROUP BY 1),
s AS (SELECT e.user_id, CAST(e.ts AS DATE) AS day, e.value > 20 AS off, f.name FROM events e JOIN f ON f.user_id = e.user_id AND f.name = e.event_type),
a AS (SELECT user_id, name, count(DISTINCT day) FILTER (NOT off) AS n_on, count(DISTINCT day) FILTER (off) AS n_off FROM s GROUP BY 1, 2)
SELECT user_id AS page, name AS title, CASE WHEN n_on = 0 AND n_off > 0 THEN n_off ELSE n_on END AS sessions, n_on = 0 AND n_off > 0 AS cancelled FROM a
""")
def agg_18(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("page"), F.unix_micros(F.col("ts").cast("timestamp")).alias("block"), F.col("event_id").alias("item"),
        F.col("event_type").alias("name"), F.lit(None).cast("string").alias("venue"), F.lit("").alias("address"), F.lit("").alias("description"),
        F.to_date("ts").cast("string").alias("start"), (F.col("value") > 20).alias("cancelled"),
        F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(None).cast("string").alias("sale"),
    )
    return X.page_facts(e, "page").select("page", "title", F.size("sessions").cast("bigint").alias("sessions"), "cancelled")


@query("agg_19_control_totals", """
SELECT l_returnflag AS grp, count(*) AS recomputed, sum(n)::BIGINT AS recorded, count(*) = sum(n) AS agrees
FROM (SELECT l_returnflag, 1 AS n FROM lineitem) GROUP BY 1
""")
def agg_19(spark, sf):
    li = table(spark, sf, "lineitem")
    per_day = li.groupBy("l_returnflag", "l_shipdate").agg(F.count("*").alias("c"), F.sum(F.lit(1)).alias("n"))
    return per_day.groupBy(F.col("l_returnflag").alias("grp")).agg(F.sum("c").alias("recomputed"), F.sum("n").alias("recorded")).select(
        "grp", "recomputed", "recorded", (F.col("recomputed") == F.col("recorded")).alias("agrees")
    )


@query("agg_20_bundle_manifest", f"""
SELECT {HOST_CASE} AS source_id, count(*) AS items, bool_and({url_sql('url', 1)} = 'https') AS ok FROM pages GROUP BY 1
""")
def agg_20(spark, sf):
    from marquee.functions import urls as U

    return C.bundle_by_source(table(spark, sf, "pages").select("url"), F.col("url"), U.scheme(F.col("url")) == "https", HOSTS, SUFFIXES)


TOTALS_SQL = """rec AS (SELECT o_orderkey // 32 AS bundle, count(*) AS items, sum(('0x' || md5(length(o_orderkey::VARCHAR) || ':' || o_orderkey)[1:15])::BIGINT) AS digest FROM orders GROUP BY 1),
got AS (SELECT l_orderkey // 32 AS bundle, count(*) AS items, sum(('0x' || md5(length(l_orderkey::VARCHAR) || ':' || l_orderkey)[1:15])::BIGINT) AS digest
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) GROUP BY 1),
cmp AS (SELECT bundle, rec.items AS recorded_items, got.items AS recomputed_items, rec.digest::VARCHAR AS recorded_digest, got.digest::VARCHAR AS recomputed_digest,
  coalesce(rec.items = got.items AND rec.digest = got.digest, false) AS agrees FROM rec FULL JOIN got USING (bundle))"""


def _bundles(spark, sf):
    # Orders are the record of what was sent, line items what arrived; a bundle is 32 order numbers.
    of = lambda key: F.floor(F.col(key) / 32).cast("bigint").alias("bundle")
    totals = lambda key: [F.count("*").alias("items"), Q.multiset_digest(F.col(key)).cast("string").alias("digest")]
    sent = table(spark, sf, "orders").groupBy(of("o_orderkey")).agg(*totals("o_orderkey"))
    came = table(spark, sf, "lineitem").select("l_orderkey").distinct().groupBy(of("l_orderkey")).agg(*totals("l_orderkey"))
    return Q.compared_totals(sent, came, ["bundle"], ["items", "digest"])


@query("agg_19_bundle_totals", f"WITH {TOTALS_SQL} SELECT * FROM cmp")
def agg_19_bundles(spark, sf):
    return _bundles(spark, sf)


@query("agg_20_bundle_attempts", f"""
WITH {TOTALS_SQL} SELECT bundle // 4 AS batch, count(*) AS bundles, coalesce(sum(recomputed_items), 0)::BIGINT AS items, bool_and(agrees) AS ok,
  coalesce(string_agg(bundle::VARCHAR, ',' ORDER BY bundle) FILTER (NOT agrees), '') AS failed FROM cmp GROUP BY 1
""")
def agg_20_attempts(spark, sf):
    # A batch of four bundles succeeds only as a whole; the list of failed ones is bounded by that.
    failed = F.array_sort(F.collect_list(F.when(~F.col("agrees"), F.col("bundle"))))
    return _bundles(spark, sf).groupBy(F.floor(F.col("bundle") / 4).cast("bigint").alias("batch")).agg(
        F.count("*").alias("bundles"), F.coalesce(F.sum("recomputed_items"), F.lit(0)).cast("bigint").alias("items"), F.bool_and("agrees").alias("ok"), F.array_join(failed, ",").alias("failed")
    )
