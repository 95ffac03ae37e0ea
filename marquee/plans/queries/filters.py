"""Projections and filters (prj_*, flt_*)."""

from __future__ import annotations

from marquee.functions import dates as D, text as T, urls as U, values as V
from marquee.operators import normalize as N, search as S, tickets as K
from marquee.plans.queries.common import *  # noqa: F403

NORTH = {"north": ["ASIA", "EUROPE"]}


@query("prj_01_allow_list", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def prj_01(spark, sf):
    return N.allow_listed(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_shipdate", "absent"])


@query("prj_02_defaults", f"""
SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, '{V.SALE_NOTE_DEFAULT}') AS "saleNote",
       coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, 'scheduled') AS status,
       '{V.SUMMARY_DEFAULT}' AS summary, '{V.TICKET_STATUS_DEFAULT}' AS "ticketStatus"
FROM orders
""")
def prj_02(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("saleNote"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"),
    )
    return N.with_defaults(o)


@query("prj_03_summary_template", LISTING + """
SELECT id, region || '的展覽，展出於' || venue || '。實際開放日與入場規定請查閱來源。' AS summary FROM listing
""")
def prj_03(spark, sf):
    l = B.listing(spark, sf)
    return l.select("id", T.listing_summary(F.col("region"), F.col("venue"), F.lit("")).alias("summary"))


@query("prj_04_legacy_ticket", """
SELECT l_orderkey AS event, l_linenumber AS ord,
       CASE WHEN l_returnflag = 'A' THEN NULL
            WHEN l_suppkey % 3 = 0 THEN 'KKTIX' WHEN l_suppkey % 3 = 1 THEN 'OPENTIX' END AS platform,
       CASE WHEN l_returnflag <> 'A' AND l_suppkey % 3 < 2 THEN CAST(l_shipdate AS DATE) END AS scope_day
FROM lineitem
""")
def prj_04(spark, sf):
    hosts = F.element_at(
        F.array(F.lit("club.kktix.cc"), F.lit("www.opentix.life"), F.lit("example.org")), (F.col("l_suppkey") % 3 + 1).cast("int")
    )
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.concat(F.lit("https://"), hosts, F.lit("/events/1")).alias("url"),
        F.array(F.struct(F.col("l_shipdate").cast("date").alias("date"), F.lit(None).cast("string").alias("time"))).alias("sessions"),
    )
    existing = F.when(F.col("l_returnflag") == "A", F.array(F.lit(1)))
    t = N.migrate_ticket(existing, F.col("url"), F.lit("1998-06-01"), F.col("sessions"))
    first = F.get(t, F.lit(0))
    return li.select(
        F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("ord"), first["platform"].alias("platform"),
        F.get(first["sessions"], F.lit(0))["date"].alias("scope_day"),
    )


@query("prj_05_session_facts", """
SELECT conv_id, turn, role AS performers, 'host-' || role AS host FROM conversations
""")
def prj_05(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array(F.struct(F.col("turn").alias("date"), F.lit(None).cast("string").alias("time"))).alias("s"))
    facts = N.session_facts(F.col("s"), F.col("role"), F.concat(F.lit("host-"), F.col("role")))
    return c.select("conv_id", F.explode(facts).alias("f")).select("conv_id", F.col("f.date").alias("turn"), "f.performers", "f.host")


VIEW_SQL = {
    "all": "(end_day IS NULL OR end_day >= {d})",
    "history": "end_day < {d}",
    "new": "(end_day IS NULL OR end_day >= {d}) AND first_seen = {d}",
    "ending": "start_day <= {d} AND end_day >= {d} AND end_day - {d} <= 14",
    "recommended": "end_day >= {d} AND start_day - {d} <= 30 AND NOT missing AND note IS NULL",
}


def _view(view):
    sql = PERIOD + f"SELECT id, start_day, end_day FROM forward_period WHERE {VIEW_SQL[view].format(d=AS_OF_SQL)}"

    @query(f"flt_01_view_{view}", sql)
    def run(spark, sf):
        return B.forward_period(spark, sf).where(S.view_predicate(view, as_of())).select("id", "start_day", "end_day")


for _name in VIEW_SQL:
    _view(_name)


@query("flt_02_date_overlap", PERIOD + f"""
SELECT id, start_day, end_day FROM forward_period WHERE start_day <= {AS_OF_SQL} AND end_day >= {AS_OF_SQL}
""")
def flt_02(spark, sf):
    p = B.forward_period(spark, sf)
    return p.where(D.covers(F.col("start_day"), F.col("end_day"), as_of())).select("id", "start_day", "end_day")


@query("flt_03_region_group", LISTING + """
SELECT id, region FROM listing WHERE region IN ('ASIA', 'EUROPE')
""")
def flt_03(spark, sf):
    return B.listing(spark, sf).where(S.region_predicate("north", NORTH)).select("id", "region")


@query("flt_04_nested_membership", SESSION + """
SELECT event, count(*) AS places FROM (SELECT DISTINCT event, supp FROM session)
GROUP BY event HAVING bool_or(supp = 7)
""")
def flt_04(spark, sf):
    # Distinct places first, then plain aggregates: no array grows with an event.
    places = B.session(spark, sf).select("event", "supp").distinct()
    n = places.groupBy("event").agg(F.count("*").alias("places"), F.bool_or(F.col("supp") == 7).alias("hit"))
    return n.where("hit").select("event", "places")


@query("flt_05_text_search", """
SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'tion the')
""")
def flt_05(spark, sf):
    return table(spark, sf, "documents").where(S.contains_text("Tion The ", "source", "lang", "text")).select("doc_id")


@query("flt_06_session_filter", SESSION + f"""
SELECT s.event, count(*) AS matching FROM session s
WHERE NOT s.cancelled AND s.day >= {AS_OF_SQL}
  AND EXISTS (SELECT 1 FROM session t WHERE t.scoped AND t.platform = 'KKTIX' AND t.event = s.event
              AND t.day = s.day AND t.clock IS NOT DISTINCT FROM s.clock)
GROUP BY 1
""")
def flt_06(spark, sf):
    s = B.session(spark, sf)
    tickets = s.where("scoped").select("event", "day", "clock", "platform")
    hit = K.matching_sessions(s.select("event", "day", "clock", "cancelled"), as_of(), platform="KKTIX", tickets=tickets)
    return hit.groupBy("event").agg(F.count("*").alias("matching"))


@query("flt_06_live_search", LIVE + """
, h AS (SELECT DISTINCT id, day, clock FROM live WHERE region IN ('ASIA', 'EUROPE') AND platform = 'KKTIX' AND contains(lower(title || ' ' || venue), 'o'))
SELECT id, CAST(min(CAST(day AS VARCHAR) || ' ' || coalesce(clock, ''))[1:10] AS DATE) AS day, min(CAST(day AS VARCHAR) || ' ' || coalesce(clock, ''))[12:] AS clock,
  count(*) AS sessions FROM h GROUP BY 1
""")
def flt_06_live(spark, sf):
    return S.search_live(B.live(spark, sf), S.LiveFilter(region="east", platform="KKTIX", text="O", groups={"east": ["ASIA", "EUROPE"]}))


@query("flt_07_uncovered_session", SESSION + """
SELECT s.event, s.day, s.clock, s.ord FROM session s
WHERE NOT EXISTS (SELECT 1 FROM session t WHERE t.scoped AND t.event = s.event AND t.day = s.day
                  AND t.clock IS NOT DISTINCT FROM s.clock)
""")
def flt_07(spark, sf):
    s = B.session(spark, sf)
    scopes = s.where("scoped").select("event", "day", "clock")
    return K.uncovered_sessions(s.select("event", "day", "clock", "ord"), scopes)


@query("flt_08_upcoming", SESSION + f"""
SELECT event, count(*) AS upcoming FROM session WHERE day >= {AS_OF_SQL} GROUP BY 1
""")
def flt_08(spark, sf):
    return K.upcoming(B.session(spark, sf), as_of()).groupBy("event").agg(F.count("*").alias("upcoming"))


@query("flt_09_future_weekend", f"""
SELECT o_orderkey AS id FROM orders
WHERE CAST(o_orderdate AS DATE) + INTERVAL '23:59:59' HOUR TO SECOND >= TIMESTAMP '1998-06-01 12:00:00'
""".replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL '86399 seconds'"))
def flt_09(spark, sf):
    now = F.lit("1998-06-01 12:00:00").cast("timestamp_ntz")
    o = table(spark, sf, "orders")
    return S.future_weekends(o, F.col("o_orderdate").cast("date"), now).select(F.col("o_orderkey").alias("id"))


@query("flt_10_listed_pages", f"""
SELECT page_id FROM pages WHERE {url_sql('url', 1)} = 'https' AND {url_sql('url', 4)} = '' AND {url_sql('url', 5)} = ''
  AND starts_with({url_sql('url', 3)}, '/en/') AND {host_sql('url')} = (SELECT min({host_sql('url')}) FROM pages)
""")
def flt_10(spark, sf):
    # One source: the pages of the first host; links to all others lead off it.
    p = table(spark, sf, "pages")
    base = p.agg(F.min(U.host(F.col("url")))).scalar()
    return p.where(U.is_listed_page(F.col("url"), base, "/en/")).select("page_id")


@query("flt_11_safe_url", f"""
SELECT page_id, {url_sql('url', 1)} IN ('http', 'https') AND {host_sql('url')} <> '' AND NOT contains({url_sql('url', 2)}, '@') AS safe,
       {url_sql('url', 1)} = 'https' AND {host_sql('url')} <> '' AND NOT contains({url_sql('url', 2)}, '@')
         AND {url_sql('url', 3)} NOT IN ('', '/') AS detail
FROM pages
""")
def flt_11(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", U.is_safe(F.col("url")).alias("safe"), U.is_detail(F.col("url")).alias("detail"))


@query("flt_12_prefix_accept", """
WITH b AS (
  SELECT l_orderkey AS event, min(l_linenumber) FILTER (l_returnflag = 'R') AS first_bad FROM lineitem GROUP BY 1)
SELECT l.l_orderkey AS event, count(*) FILTER (first_bad IS NULL OR l_linenumber < first_bad) AS accepted,
       CASE WHEN first_bad IS NULL THEN NULL ELSE 'INVALID_DATE_OR_VALUE' END AS reject_reason
FROM lineitem l JOIN b ON b.event = l.l_orderkey GROUP BY l.l_orderkey, first_bad
""")
def flt_12(spark, sf):
    # Long form of the rule: the first bad position is an aggregate, joined back by row.
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), "l_linenumber", (F.col("l_returnflag") == "R").alias("bad"))
    first = li.groupBy("event").agg(F.min(F.when(F.col("bad"), F.col("l_linenumber"))).alias("first_bad"))
    j = li.join(first, "event")
    kept = F.col("first_bad").isNull() | (F.col("l_linenumber") < F.col("first_bad"))
    return j.groupBy("event", "first_bad").agg(F.count_if(kept).alias("accepted")).select(
        "event", "accepted", F.when(F.col("first_bad").isNotNull(), F.lit("INVALID_DATE_OR_VALUE")).alias("reject_reason")
    )


@query("flt_13_dependent_clearing", LISTING + """
SELECT id, region, venue, NOT EXISTS (SELECT 1 FROM listing WHERE region = 'ASIA' AND venue = 'NATION_0') AS cleared
FROM listing WHERE region = 'ASIA'
  AND (venue = 'NATION_0' OR NOT EXISTS (SELECT 1 FROM listing WHERE region = 'ASIA' AND venue = 'NATION_0'))
""")
def flt_13(spark, sf):
    l = B.listing(spark, sf)
    f, cleared = S.clear_incompatible(l, S.Filter(region="ASIA", venue="NATION_0", view="any"))
    cond = S.region_predicate(f.region, f.groups)
    if f.venue:
        cond = cond & (F.col("venue") == f.venue)
    return l.where(cond).select("id", "region", "venue", F.lit(cleared).alias("cleared"))
