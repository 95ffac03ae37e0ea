"""Classification, guards and checks (cls_*, grd_*, chk_*)."""

from __future__ import annotations

from marquee.functions import dates as D, text as T, urls as U, values as V
from marquee.operators import classify as C, extract as X, quality as Q, search as S, venues as VN
from marquee.plans.queries.common import *  # noqa: F403
from marquee.sources import readers as R

# The fixed rules speak Chinese and English; the driver's texts are invented syllables, so the
# ladders run on syllable patterns that Java and RE2 read alike.
PATTERNS = {"course": "(?iu)workshop|ingst", "fan": "(?iu)éau|upgrade", "concerts": "(?iu)tion the|concert", "comedy": "(?iu)tion of", "other": "(?iu)zón"}


@query("cls_01_classifier", """
SELECT d.doc_id, CASE WHEN regexp_matches(text, '(?i)workshop|ingst') THEN 'excluded' WHEN regexp_matches(text, '(?i)éau|upgrade') THEN 'excluded'
  WHEN l.quality = 1 THEN 'included' WHEN l.quality = 0 THEN 'excluded' WHEN regexp_matches(text, '(?i)tion the|concert') THEN 'included' ELSE 'pending' END AS decision,
  CASE WHEN regexp_matches(text, '(?i)workshop|ingst') THEN 'COURSE_OR_MUSICAL' WHEN regexp_matches(text, '(?i)éau|upgrade') THEN 'FAN_MEETING_OR_UPGRADE'
  WHEN l.quality = 1 THEN 'OFFICIAL_REVIEWED_FORMAT' WHEN l.quality = 0 THEN 'OTHER_REVIEWED_FORMAT'
  WHEN regexp_matches(text, '(?i)tion the|concert') THEN 'CONCERT_EVIDENCE' ELSE 'INSUFFICIENT_CONCERT_EVIDENCE' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def cls_01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    reviewed = F.when(F.col("quality") == 1, "concerts").when(F.col("quality") == 0, "comedy")
    return d.select("doc_id", C.classify("concerts", F.col("text"), reviewed, patterns=PATTERNS).alias("c")).select("doc_id", "c.*")


RULES = [("a", "zón|ción"), ("b", "é[aeiou]"), ("c", r"[Ww]h[a-z]+ou"), ("d", "ß|ü")]


@query("cls_02_genre", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)zón|ción') THEN 'a' WHEN regexp_matches(text, '(?i)é[aeiou]') THEN 'b'
  WHEN regexp_matches(text, '(?i)[Ww]h[a-z]+ou') THEN 'c' WHEN regexp_matches(text, '(?i)ß|ü') THEN 'd' WHEN contains(text, 'the') THEN 'other' ELSE 'default' END AS genre FROM documents
""")
def cls_02(spark, sf):
    g = C.genre(F.col("text"), RULES, ("the", "other", "default"), flags="(?iu)")
    return table(spark, sf, "documents").select("doc_id", g.alias("genre"))


@query("cls_03_venue_status", f"""
WITH v AS (SELECT c_custkey AS id, r_name AS region, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN '線上 展' WHEN 3 THEN '鼓山區(高雄市)=' ELSE n_name END AS venue,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' 3F' ELSE '' END AS address, c_name AS title
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT *, CASE WHEN id % 5 = 2 THEN 'online' WHEN id % 5 < 2 THEN CASE WHEN address <> '' THEN 'address' ELSE 'missing' END WHEN id % 5 = 3 THEN 'uncertain' ELSE 'named' END AS status,
  CASE WHEN id % 5 = 2 THEN '{V.VENUE_ONLINE}' WHEN id % 5 < 2 THEN CASE WHEN address <> '' THEN '地址地點：' || address ELSE '{V.VENUE_MISSING}' END
       WHEN id % 5 = 3 THEN '地點待確認（鼓山區）' ELSE venue END AS name,
  CASE WHEN id % 5 = 2 THEN '' WHEN id % 5 <= 3 THEN address ELSE trim(replace(address, '3F', '')) END AS street FROM v)
SELECT id, status, name, 'venue-' || substr(sha256(region || '|' || regexp_replace(name, '[\\s\\p{{Z}}_・·()（）]', '', 'g') || '|' || regexp_replace(street, '[\\s\\p{{Z}}_・·()（）]', '', 'g')), 1, 16) AS venue_id FROM s
""")
def cls_03(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey") % 5
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey").alias("id"), F.col("r_name").alias("region"), F.col("c_name").alias("title"), F.lit("").alias("park"),
        F.when(k == 0, "").when(k == 1, F.col("c_name")).when(k == 2, "線上 展").when(k == 3, "鼓山區(高雄市)=").otherwise(F.col("n_name")).alias("venue"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" 3F"))).otherwise(F.lit("")).alias("address"),
    )
    out = VN.group_venues(df, exact=False)
    return out.select("id", F.col("venueStatus").alias("status"), F.col("venueName").alias("name"), F.col("venueId").alias("venue_id"))


@query("cls_04_link_provenance", f"""
WITH p AS (SELECT page_id, url, page_id % 7 <> 0 AS ok_uid, l.quality = 1 AS verified FROM pages LEFT JOIN labels l ON l.doc_id = page_id)
SELECT page_id, CASE WHEN ok_uid AND coalesce(verified, false) THEN 'verified' WHEN ok_uid THEN 'source-provided' ELSE 'invalid-id' END AS state,
  CASE WHEN ok_uid THEN 'promote' ELSE 'dataset' END AS type, CASE WHEN ok_uid THEN url ELSE '{V.DATASET_URL}' END AS url FROM p
""")
def cls_04(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    j = p.join(l, "page_id", "left")
    uid = F.when(F.col("page_id") % 7 != 0, F.substring(F.md5(F.col("page_id").cast("string")), 1, 24)).otherwise(F.lit("bad"))
    state = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "unavailable")
    link = VN.resolve_link(uid, F.lit("t"), F.col("url"), F.lit("t"), F.col("url"), state, F.lit("2024-01-01"))
    return j.select("page_id", link.alias("k")).select("page_id", F.col("k.state").alias("state"), F.col("k.type").alias("type"), F.col("k.url").alias("url"))


@query("cls_05_demotion", """
SELECT d.doc_id, CASE WHEN lang <> 'en' THEN 'excluded' WHEN coalesce(l.quality, 0) = 1 THEN 'included' ELSE 'pending' END AS decision,
  CASE WHEN lang <> 'en' THEN 'X' WHEN coalesce(l.quality, 0) = 1 THEN 'OK' ELSE 'DETAIL_FACTS_NOT_REVIEWED' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def cls_05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    base = F.when(F.col("lang") == "en", C.verdict("included", "OK")).otherwise(C.verdict("excluded", "X"))
    return d.select("doc_id", C.demote_unreviewed(base, F.col("quality") == 1).alias("c")).select("doc_id", "c.*")


@query("cls_06_tag_prefilter", """
SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'excluded' WHEN contains(text, 'tion the') THEN 'included' ELSE 'pending' END AS decision FROM documents
""")
def cls_06(spark, sf):
    decided = F.when(F.col("text").contains("tion the"), C.verdict("included", "E")).otherwise(C.verdict("pending", "P"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", C.tag_prefilter(F.col("lang"), decided, ["en", "fr"])["decision"].alias("decision"))


@query("cls_07_feed_decision", f"WITH {B.RAW_LISTING_SQL}" + f"""
SELECT id, CASE WHEN end_day IS NULL THEN 'excluded' WHEN end_day - start_day > 400 THEN 'excluded' WHEN start_day < {AS_OF_SQL} THEN 'excluded'
   WHEN status = 'F' THEN 'pending' WHEN region = 'ASIA' THEN 'pending' ELSE 'included' END AS decision,
  CASE WHEN end_day IS NULL THEN 'NO_STRUCTURED_EVENT' WHEN end_day - start_day > 400 THEN 'MULTI_DAY_PARENT_LISTING' WHEN start_day < {AS_OF_SQL} THEN 'PAST_EVENT'
   WHEN status = 'F' THEN 'WEAK' WHEN region = 'ASIA' THEN 'PLACE_NOT_STRUCTURED' ELSE 'OK' END AS reason FROM raw_listing
""")
def cls_07(spark, sf):
    l = B.raw_listing(spark, sf)
    decided = F.when(F.col("status") == "F", C.verdict("pending", "WEAK")).otherwise(C.verdict("included", "OK"))
    # A listing spanning more than 400 days counts as a parent listing here.
    last = F.when(F.datediff("end_day", "start_day") > 400, F.col("end_day")).otherwise(F.col("start_day"))
    c = C.feed_decision(F.col("start_day"), last, as_of(), decided, F.col("region") != "ASIA", F.col("end_day").isNotNull())
    return l.select("id", c.alias("c")).select("id", "c.*")


@query("cls_08_badge", PERIOD + f"""
SELECT id, CASE WHEN note IS NOT NULL THEN '{V.BADGE_NOTE}' WHEN end_day < {AS_OF_SQL} THEN '{V.BADGE_ENDED}' WHEN start_day IS NULL OR end_day IS NULL THEN '{V.BADGE_UNKNOWN}'
  WHEN start_day > {AS_OF_SQL} THEN '{V.BADGE_UPCOMING}' WHEN end_day - {AS_OF_SQL} <= 14 THEN '{V.BADGE_ENDING}' ELSE '{V.BADGE_RUNNING}' END AS badge FROM forward_period
""")
def cls_08(spark, sf):
    p = B.forward_period(spark, sf)
    return p.select("id", C.badge(F.col("start_day"), F.col("end_day"), F.col("note"), as_of()).alias("badge"))


@query("cls_09_sale_conflict", """
SELECT doc_id, (n_chars % 2 = 0 OR lang = 'fr') AND regexp_matches(text, 'tion[^.;]*(?:the|de)') AS conflict FROM documents
""")
def cls_09(spark, sf):
    sale = F.when(F.col("n_chars") % 2 == 0, "2024-01-01")
    d = table(spark, sf, "documents")
    return d.select("doc_id", C.sale_conflict(sale, F.col("lang") == "fr", F.col("text"), r"tion[^.;]*(?:the|de)").alias("conflict"))


@query("cls_10_staleness", """
WITH s AS (SELECT user_id AS source, max(ts) FILTER (event_type = 'purchase') AS last_success FROM events GROUP BY 1)
SELECT source, last_success IS NULL OR last_success < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 36 HOUR AS stale FROM s
""")
def cls_10(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("source")).agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last")
    )
    return s.select("source", D.is_stale(F.col("last"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).alias("stale"))


@query("cls_11_state_label", f"""
SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 20 THEN '{V.STATE_DAILY}' WHEN event_type = 'purchase' THEN '{V.STATE_DONE}'
  WHEN event_type = 'view' THEN '{V.STATE_MANUAL}' WHEN event_type = 'click' THEN '{V.STATE_PENDING}' ELSE '{V.STATE_FAILED}' END AS label FROM events
""")
def cls_11(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "purchase", "ok").when(t == "view", "manual").when(t == "click", "pending").otherwise(F.lit("error"))
    mode = F.when(F.col("value") > 20, "daily-crawl").otherwise(F.lit("reviewed-import"))
    return table(spark, sf, "events").select("event_id", C.state_label(status, mode).alias("label"))


@query("grd_01_empty_guard", "SELECT source, count(*) AS n, count(*) = 0 AS refused FROM documents GROUP BY 1")
def grd_01(spark, sf):
    d = R.require_rows(table(spark, sf, "documents"))
    return d.groupBy("source").agg(F.count("*").alias("n"), (F.count("*") == 0).alias("refused"))


REJ = "sum(CASE WHEN contains(text, 'ei') THEN 1 ELSE 0 END)"


@query("grd_02_rejection_guard", f"""
SELECT source, count(*) AS total, {REJ}::BIGINT AS rejected, {REJ} > count(*) * 0.2 AS over_ratio,
  {REJ} > greatest(2.0, count(*) * 0.2) AS over_crawl, {REJ} > greatest(1.0, count(*) * 0.2) AS over_venue FROM documents GROUP BY 1
""")
def grd_02(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("text").contains("ei")).alias("rejected"))
    r, n = F.col("rejected"), F.col("total")
    return d.select("source", "total", "rejected", Q.rejection_guard(r, n).alias("over_ratio"), Q.rejection_guard(r, n, 2).alias("over_crawl"), Q.rejection_guard(r, n, 1).alias("over_venue"))


TWO_DAYS = """two AS (SELECT event_type AS source, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15') AS active, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-16') AS incoming FROM events GROUP BY 1)"""


def _two_days(spark, sf):
    on = lambda d: F.to_date("ts") == F.lit(d).cast("date")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(
        F.count_if(on("2024-01-15")).alias("active"), F.count_if(on("2024-01-16")).alias("incoming")
    )


@query("grd_03_loss_guard", f"""
WITH {TWO_DAYS} SELECT source, active, incoming, active > 20 AND incoming < active * 0.5 AS provider_loss, active >= 8 AND incoming < active * 0.5 AS venue_loss,
  active >= 6 AND incoming < active * 0.5 AS crawl_loss, incoming < greatest(15, floor(active * 0.8)) AS calendar_loss FROM two
""")
def grd_03(spark, sf):
    a, i = F.col("active"), F.col("incoming")
    return _two_days(spark, sf).select(
        "source", "active", "incoming", Q.loss_guard(a, i).alias("provider_loss"), Q.loss_guard(a, i, 8, True).alias("venue_loss"),
        Q.loss_guard(a, i, 6, True).alias("crawl_loss"), Q.calendar_guard(a, i).alias("calendar_loss"),
    )


VERDICT = """per AS (SELECT user_id AS source, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, max(value) AS top FROM events
   WHERE CAST(ts AS DATE) IN (DATE '2024-01-15', DATE '2024-01-16') GROUP BY 1, 2),
prev AS (SELECT * FROM per WHERE day = DATE '2024-01-15'), cand AS (SELECT * FROM per WHERE day = DATE '2024-01-16'),
verdict AS (SELECT source, NOT (bad > n * 0.2) AS ok FROM cand)"""


def _verdicts(spark, sf):
    days = [F.lit(d).cast("date") for d in ("2024-01-15", "2024-01-16")]
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts")).where(F.col("day").isin(*days))
    per = e.groupBy(F.col("user_id").alias("source"), "day").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.max("value").alias("top")
    )
    prev, cand = per.where(F.col("day") == days[0]), per.where(F.col("day") == days[1])
    return prev, cand, cand.select("source", (~Q.rejection_guard(F.col("bad"), F.col("n"))).alias("ok"))


@query("grd_04_last_good", f"""
WITH {VERDICT} SELECT c.* FROM cand c JOIN verdict v USING (source) WHERE v.ok
UNION ALL SELECT p.* FROM prev p WHERE p.source NOT IN (SELECT source FROM verdict WHERE ok)
""")
def grd_04(spark, sf):
    prev, cand, verdicts = _verdicts(spark, sf)
    return Q.keep_last_good(prev, cand, verdicts)


@query("grd_05_independence", f"WITH {VERDICT} SELECT bool_and(ok) AS all_ok, count(*) FILTER (NOT ok) AS failed_sources FROM verdict")
def grd_05(spark, sf):
    return Q.overall(_verdicts(spark, sf)[2])


@query("chk_01_event_facts", """
WITH e AS (SELECT o_orderkey AS id, o_orderstatus, count(l_orderkey) AS n, bool_or(l_linestatus = 'F') AS ticket FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT id, 'sessions_empty' AS violation FROM e WHERE n = 0
UNION ALL SELECT id, 'status' FROM e WHERE o_orderstatus = 'P'
UNION ALL SELECT id, 'ticket_url' FROM e WHERE ticket AND o_orderstatus = 'O'
""")
def chk_01(spark, sf):
    s = B.session(spark, sf).groupBy("event").agg(
        F.array_sort(F.collect_set(F.struct(F.col("day").cast("string").alias("date"), F.col("clock").alias("time")))).alias("sessions"),
        F.array_sort(F.collect_set(F.when(F.col("scoped"), F.struct(F.col("day").cast("string").alias("date"), F.col("clock").alias("time"))))).alias("scope"),
    )
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "lost").otherwise(F.lit("scheduled"))
    url = F.when(F.col("o_orderstatus") == "O", "https://tickets.example/").otherwise(F.lit("https://tickets.example/e/1"))
    ticket = F.struct(F.lit("P").alias("platform"), url.alias("url"), F.lit("1998-06-01").alias("checkedAt"), F.col("scope").alias("sessions"))
    e = o.join(s, o.o_orderkey == s.event, "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("sourceUid"), F.lit("t").alias("title"), F.lit("r").alias("region"),
        F.lit("v").alias("venue"), "sessions", F.lit("https://source.example/e/1").alias("sourceUrl"), status.alias("status"), F.lit("s").alias("summary"),
        F.when(F.size("scope") > 0, F.array(ticket)).alias("tickets"),
    )
    return Q.violations(e, Q.event_rules())


@query("chk_02_listing_contract", LISTING + """
SELECT id, 'location_region' AS violation FROM listing WHERE source = '5-LOW'
UNION ALL SELECT id, 'location_status' FROM listing WHERE status = 'P'
UNION ALL SELECT id, 'summary_markup' FROM listing WHERE region = 'ASIA'
UNION ALL SELECT id, 'url' FROM listing WHERE venue = 'NATION_3'
""")
def chk_02(spark, sf):
    l = B.listing(spark, sf)
    loc = F.struct(
        F.lit("x").alias("id"), F.col("venue").alias("name"), F.when(F.col("source") == "5-LOW", "elsewhere").otherwise(F.col("region")).alias("region"),
        F.when(F.col("status") == "P", "odd").otherwise(F.lit("named")).alias("status"),
    )
    rows = l.select(
        "id", "region", F.array(loc).alias("locations"), F.when(F.col("region") == "ASIA", "<b>x</b>").otherwise(F.lit("x")).alias("summary"),
        F.col("price").cast("string").alias("price"), F.when(F.col("venue") == "NATION_3", "ftp://a/b").otherwise(F.lit("https://a.example/b")).alias("url"),
    )
    return Q.violations(rows, Q.listing_rules())


@query("chk_03_unique_sessions", SESSION + """
SELECT event, day, clock, count(*) AS n, 'duplicate_session' AS violation FROM session GROUP BY 1, 2, 3 HAVING count(*) > 1
""")
def chk_03(spark, sf):
    return Q.duplicates(B.session(spark, sf), ["event", "day", "clock"], "duplicate_session")


@query("chk_04_calendar_contract", """
WITH e AS (SELECT o_orderkey, o_orderdate, o_orderstatus, max(l_shipdate) AS top FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT 'r-' || o_orderkey AS id, 'dates_ordered' AS violation FROM e WHERE CAST(o_orderdate AS DATE) > CAST(top AS DATE)
UNION ALL SELECT 'r-' || o_orderkey, 'status' FROM e WHERE o_orderstatus = 'P'
""")
def chk_04(spark, sf):
    p = B.period(spark, sf)
    rows = p.select(
        F.concat(F.lit("r-"), F.col("id").cast("string")).alias("id"), F.when(F.col("status") == "P", "lost").otherwise(F.lit("ok")).alias("status"),
        F.col("start_day").alias("weekendStart"), F.col("end_day").alias("weekendEnd"), F.lit("https://calendar.example/2026").alias("source"),
        F.array(F.struct(F.concat(F.col("start_day").cast("string"), F.lit("T00:00:00+00:00")).alias("start"))).alias("sessions"),
    )
    return Q.violations(rows, Q.race_rules("https://calendar.example/"))


def _leak_sql():
    parts = [f"SELECT source, '{n}' AS pattern, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}') GROUP BY 1" for n, p in V.LEAK_PATTERNS.items()]
    return " UNION ALL ".join(parts)


@query("chk_05_leak_scan", _leak_sql())
def chk_05(spark, sf):
    return Q.leak_scan(table(spark, sf, "documents"), F.col("text"), ["source"])


@query("chk_06_traversal", """
WITH v AS (SELECT conv_id, count(*) AS visited, max(turn) + 1 + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END AS expected, bool_or(role = 'assistant') AS claimed FROM conversations GROUP BY 1)
SELECT conv_id, claimed AND visited = expected AS complete, conv_id % 10 = 9 AS future_review FROM v
""")
def chk_06(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.min("turn").alias("low"), F.count_distinct("turn").alias("n"), F.max("turn").alias("top"), F.bool_or(F.col("role") == "assistant").alias("claimed")
    )
    # Expected turns are 0 to a top: bounds and a distinct count decide, without listing either side.
    expected = F.col("top") + 1 + F.when(F.col("conv_id") % 4 == 0, 1).otherwise(0)
    review = F.when(F.col("conv_id") % 10 == 9, F.lit("2024-02-01")).otherwise(F.lit("2024-01-01"))
    complete = F.col("claimed") & (F.col("low") >= 0) & (F.col("n") == expected)
    return c.select("conv_id", complete.alias("complete"), (review > "2024-01-16").alias("future_review"))


MAIN_SQL = collapse_sql(unescape_sql(
    r"regexp_replace(" + "regexp_replace(" * 6 + "html"
    + "".join(rf", '(?is)<{t}\b[^>]*>.*?</{t}\s*>', ' ', 'g')" for t in ("script", "style", "nav", "header", "footer", "svg"))
    + ", '<[^>]*>', ' ', 'g')"
))


@query("chk_07_content_digest", f"SELECT page_id, sha256({MAIN_SQL}) AS digest FROM pages")
def chk_07(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.content_digest(F.col("html")).alias("digest"))


H_ALL = r"array_to_string(regexp_extract_all(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), ' ')"
TITLE_SQL = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
H1_SQL = r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query("chk_08_title_confirm", f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'no such title' ELSE {clean_sql(H1_SQL)} END AS expected, {TITLE_SQL} AS t, {H_ALL} AS h FROM pages),
k AS (SELECT page_id, {word_key_sql('expected')} AS e, {word_key_sql(clean_sql('t'))} AS t, {word_key_sql(clean_sql('h'))} AS h FROM p)
SELECT page_id, length(e) > 0 AND contains(t, e) AND contains(h, e) AS confirmed FROM k
""")
def chk_08(spark, sf):
    expected = F.when(F.col("page_id") % 3 == 0, "no such title").otherwise(T.clean(X.first_heading(F.col("html"))))
    return table(spark, sf, "pages").select("page_id", X.title_confirmed(F.col("html"), expected).alias("confirmed"))


@query("chk_09_reason_allow_list", f"""
SELECT CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE '{V.GENERIC_REASON}' END AS reason, count(*) AS n FROM events GROUP BY 1
""")
def chk_09(spark, sf):
    return table(spark, sf, "events").groupBy(Q.safe_reason(F.col("event_type"), ["error", "view"]).alias("reason")).agg(F.count("*").alias("n"))
