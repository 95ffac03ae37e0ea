"""Scalar functions (fn_*) over whole tables."""

from __future__ import annotations

from marquee.functions import dates as D, text as T, urls as U, values as V
from marquee.operators import classify as C, search as S, venues as VN
from marquee.plans.queries.common import *  # noqa: F403
from marquee.plans.queries.joins import HOSTS, HOST_CASE, SUFFIXES

WORD = r"[^\p{L}\p{N}_]"


@query("fn_01_clean_markup", f"SELECT page_id, md5({clean_sql('html')}) AS digest, length({clean_sql('html')}) AS n FROM pages")
def fn_01(spark, sf):
    c = T.clean(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("n"))


@query("fn_02_normalized", f"SELECT doc_id, md5({word_key_sql('''replace(text, '台', '臺')''')}) AS digest FROM documents")
def fn_02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("digest"))


@query("fn_03_fingerprint", f"SELECT p_partkey AS id, {word_key_sql('p_name || p_brand')} AS k FROM part")
def fn_03(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.word_key(F.concat("p_name", "p_brand")).alias("k"))


@query("fn_04_place_key", rf"""
SELECT s_suppkey AS id, regexp_replace({collapse_sql("s_name || '  (' || n_name || ') '")}, '[\s\p{{Z}}_・·()（）]', '', 'g') AS k
FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def fn_04(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    place = F.concat("s_name", F.lit("  ("), "n_name", F.lit(") "))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("id"), T.place_key(T.tidy(place)).alias("k"))


RAW_DATE = """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%-m-%-d')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%d.%m.%Y') END"""


def _raw_date():
    f = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 4
    return F.when(k == 0, f("yyyy/MM/dd HH:mm:ss")).when(k == 1, f("yyyy-M-d")).when(k == 2, f("yyyy-MM-dd")).otherwise(f("dd.MM.yyyy"))


@query("fn_05_lenient_date", rf"""
WITH r AS (SELECT event_id, replace(substr({RAW_DATE}, 1, 10), '/', '-') AS v FROM events)
SELECT event_id, CASE WHEN regexp_matches(v, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN TRY_CAST(v AS DATE) END AS day FROM r
""")
def fn_05(spark, sf):
    return table(spark, sf, "events").select("event_id", D.lenient_date(_raw_date()).alias("day"))


@query("fn_06_session_parse", """
SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%H:%M') END AS clock FROM events
""")
def fn_06(spark, sf):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.date_format("ts", "yyyy/MM/dd")).when(k == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    )
    s = D.session(raw)
    return table(spark, sf, "events").select("event_id", s["date"].alias("day"), s["time"].alias("clock"))


@query("fn_07_utc_stamp", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS stamp FROM events
""")
def fn_07(spark, sf):
    clock = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "HH:mm:ss'Z'")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", D.utc_stamp(F.date_format("ts", "yyyy-MM-dd"), clock).alias("stamp"))


@query("fn_08_stable_id", """
SELECT c_custkey AS id, substr(sha256(CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || coalesce(CASE WHEN c_nationkey > 4 THEN c_mktsegment END, '')), 1, 20) AS key FROM customer
""")
def fn_08(spark, sf):
    seg = F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.stable_id(F.col("c_custkey"), F.col("c_name"), seg).alias("key"))


PLACES = ["tion", "ever", "zón", "é", "wh"]


@query("fn_09_region_extract", """
SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'ever') THEN 'ever' WHEN contains(text, 'zón') THEN 'zón'
  WHEN contains(text, 'é') THEN 'é' WHEN contains(text, 'wh') THEN 'wh' ELSE '地區未提供' END AS region FROM documents
""")
def fn_09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.region_of(F.col("text"), cities=PLACES).alias("region"))


@query("fn_10_region_short", rf"""
WITH t AS (SELECT doc_id, {collapse_sql('text')} AS v FROM documents)
SELECT doc_id, CASE WHEN contains(v, 'zón') THEN 'zón' WHEN contains(v, 'éau') THEN 'éau'
  WHEN regexp_matches(v, '(?:^|[\s\p{{Z}}/、])des') THEN 'de' WHEN regexp_matches(v, '(?:^|[\s\p{{Z}}/、])wh') THEN 'en' END AS region FROM t
""")
def fn_10(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.region_with_short(F.col("text"), ["zón", "éau"], {"des": "de", "wh": "en"}).alias("region")
    )


@query("fn_11_platform", f"SELECT page_id, {host_sql('url')} AS host, {HOST_CASE} AS platform FROM pages")
def fn_11(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.host(F.col("url")).alias("host"), U.platform_of(F.col("url"), HOSTS, SUFFIXES).alias("platform")
    )


@query("fn_12_canonical_url", f"""
WITH p AS (SELECT page_id, {url_sql('url', 1)} AS s, {url_sql('url', 2)} AS a, {url_sql('url', 3)} || 'é x%20y~*' AS p, {url_sql('url', 4)} AS q, {url_sql('url', 5)} AS f FROM pages)
SELECT page_id, lower(s) || '://' || a || replace(url_encode(url_decode(p)), '%2F', '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END
  || CASE WHEN f <> '' THEN '#' || f ELSE '' END AS url FROM p
""")
def fn_12(spark, sf):
    u = F.col("url")
    tail = F.concat(
        F.when(U.query(u) != "", F.concat(F.lit("?"), U.query(u))).otherwise(F.lit("")),
        F.when(U.fragment(u) != "", F.concat(F.lit("#"), U.fragment(u))).otherwise(F.lit("")),
    )
    # A mixed Unicode, blank and percent-encoded tail on every path.
    mixed = F.concat(U.scheme(u), F.lit("://"), U.authority(u), U.path(u), F.lit("é x%20y~*"), tail)
    return table(spark, sf, "pages").select("page_id", U.canonical(mixed).alias("url"))


@query("fn_13_title_key", rf"""
SELECT doc_id, md5({word_key_sql(r"regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '【11/14 場】' ELSE '[a very long bracket that stays]' END || text, '^\s*[【\[][^】\]]{0,20}[】\]]\s*', '')")}) AS digest FROM documents
""")
def fn_13(spark, sf):
    prefix = F.when(F.col("doc_id") % 2 == 0, "【11/14 場】").otherwise("[a very long bracket that stays]")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.title_key(F.concat(prefix, F.col("text")))).alias("digest"))


@query("fn_14_identities", """
SELECT s_suppkey AS id, lower(regexp_replace(s_name, '[^\\p{L}\\p{N}_]', '', 'g')) AS venue_key,
       CASE WHEN s_suppkey % 2 = 0 THEN 'lan-all-around-you' END AS program FROM supplier
""".replace("\\\\", "\\"))
def fn_14(spark, sf):
    title = F.when(F.col("s_suppkey") % 2 == 0, "藍恩 All Around You").otherwise("藍恩")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), VN.venue_identity(F.col("s_name")).alias("venue_key"), VN.program_identity(title).alias("program")
    )


@query("fn_15_park_tag", """
SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'songshan' WHEN c_mktsegment = 'MACHINERY' THEN 'huashan' WHEN c_mktsegment = 'FURNITURE' THEN 'pier2' ELSE '' END AS park FROM customer
""")
def fn_15(spark, sf):
    seg = F.col("c_mktsegment")
    venue = F.when(seg == "BUILDING", "松菸 1F").when(seg == "MACHINERY", "華山 東館").otherwise(F.lit("館"))
    address = F.when(seg == "FURNITURE", "高雄駁二 B4").otherwise(F.lit(""))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.park_of(venue, address).alias("park"))


@query("fn_16_price_text", f"""
SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_type WHEN p_size > 10 THEN '{V.PRICE_FREE}' ELSE '{V.PRICE_UNKNOWN}' END AS price,
  '票價未逐日確認；前次人工核對：' || p_type AS prior FROM part
""")
def fn_16(spark, sf):
    price = F.when(F.col("p_size") > 25, F.col("p_type"))
    once = T.prior_price(F.col("p_type"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        T.price_text(price, F.when(F.col("p_size") > 10, "N").otherwise(F.lit("Y"))).alias("price"),
        T.prior_price(once).alias("prior"),
    )


@query("fn_17_local_time", """
SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS local_clock,
       CAST(ts + INTERVAL 8 HOUR AS DATE) - CAST(ts AS DATE) AS day_delta FROM events
""")
def fn_17(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", D.local_day(ts).alias("local_day"), F.date_format(D.local_time(ts), "HH:mm").alias("local_clock"),
        D.cross_day(ts).cast("bigint").alias("day_delta"),
    )


@query("fn_18_day_gap", PERIOD + f"SELECT id, start_day - {AS_OF_SQL} AS to_start, end_day - {AS_OF_SQL} AS to_end FROM forward_period")
def fn_18(spark, sf):
    return B.forward_period(spark, sf).select(
        "id", D.day_gap(F.col("start_day"), as_of()).cast("bigint").alias("to_start"), D.day_gap(F.col("end_day"), as_of()).cast("bigint").alias("to_end")
    )


@query("fn_19_date_label", PERIOD + f"""
SELECT id, coalesce(CAST(start_day AS VARCHAR), '{V.START_UNKNOWN}') || ' — ' || coalesce(CAST(end_day AS VARCHAR), '{V.END_UNKNOWN}') AS label FROM forward_period
""")
def fn_19(spark, sf):
    return B.forward_period(spark, sf).select("id", D.date_label(F.col("start_day"), F.col("end_day")).alias("label"))


@query("fn_20_region_rank", "SELECT r_name AS region, CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 ELSE 2 END AS rank FROM region")
def fn_20(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_name").alias("region"))
    return r.select("region", S.region_rank("region", ["ASIA", "EUROPE"]).cast("bigint").alias("rank"))


@query("fn_21_sale_value", f"""
SELECT l_orderkey AS event, l_linenumber AS ord,
  CASE WHEN l_returnflag = 'R' AND (l_linestatus = 'F' OR l_quantity > 25) THEN '{V.SALE_CONFLICT_TEXT}'
       WHEN l_linestatus = 'F' THEN 'ticket' WHEN l_quantity > 25 THEN 'event' ELSE '' END AS value FROM lineitem
""")
def fn_21(spark, sf):
    ticket = F.when(F.col("l_linestatus") == "F", "ticket")
    event = F.when(F.col("l_quantity") > 25, "event")
    note = F.when(F.col("l_returnflag") == "R", "一般開賣時間未公布").otherwise(F.lit("已開賣"))
    conflict = C.sale_conflict(event, ticket.isNotNull(), note)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("ord"), C.sale_time_value(conflict, ticket, event).alias("value")
    )


@query("fn_22_nested_title", f"""
SELECT doc_id, md5({collapse_sql('text')}) AS quoted, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE '[ 其他 ] ' || text END) AS bare FROM documents
""")
def fn_22(spark, sf):
    wrapped = F.concat(F.lit("《"), F.col("text"), F.lit("》"))
    one_line = T.collapse(wrapped)
    badge = F.when(F.col("doc_id") % 2 == 0, "[ 免票 ] ").otherwise(F.lit("[ 其他 ] "))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.quoted_title(one_line)).alias("quoted"), F.md5(T.without_badge(F.concat(badge, F.col("text")))).alias("bare")
    )


@query("fn_23_host_source", f"SELECT page_id, {HOST_CASE} AS source_id, {HOST_CASE} IS NULL AS rejected FROM pages")
def fn_23(spark, sf):
    s = U.source_of(F.col("url"), HOSTS, SUFFIXES)
    return table(spark, sf, "pages").select("page_id", s.alias("source_id"), s.isNull().alias("rejected"))


@query("fn_24_join_notes", """
SELECT doc_id, concat_ws('；', CASE WHEN lang <> 'en' THEN lang END, source, nullif(CASE WHEN n_chars > 500 THEN 'long' ELSE '' END, '')) AS note FROM documents
""")
def fn_24(spark, sf):
    note = T.join_notes(F.when(F.col("lang") != "en", F.col("lang")), F.col("source"), F.when(F.col("n_chars") > 500, "long").otherwise(F.lit("")))
    return table(spark, sf, "documents").select("doc_id", note.alias("note"))


@query("fn_25_session_label", """
SELECT event_id, CASE event_type WHEN 'view' THEN '衝刺' WHEN 'click' THEN '正賽' ELSE event_type || ' - X' END AS label FROM events
""")
def fn_25(spark, sf):
    name = F.when(F.col("event_type") == "view", "Sprint - X").when(F.col("event_type") == "click", "Race - X").otherwise(F.concat("event_type", F.lit(" - X")))
    return table(spark, sf, "events").select("event_id", T.session_label(name).alias("label"))


@query("fn_26_date_shape", rf"SELECT event_id, regexp_matches({RAW_DATE}, '^\d{{4}}-\d{{2}}-\d{{2}}$') AS shaped FROM events")
def fn_26(spark, sf):
    return table(spark, sf, "events").select("event_id", D.date_shaped(_raw_date()).alias("shaped"))
