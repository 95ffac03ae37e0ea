"""Whole contracts over published JSON rows (chk_01 to chk_04).

Rows are made sound from the given tables; a row whose id leaves the remainder k gets the k-th fault, an
edit of its JSON text. So each rule fires on known rows, and no rule fires on the others.
"""

from __future__ import annotations

from marquee.operators import contracts as K
from marquee.plans.queries.common import *  # noqa: F403

LONG = "s" * 181
#: Hosts of the viewing platforms in chk_04.
LINK_HOSTS = ["www.example.tv", "video.example.org"]


def spread(df, *keys):
    """Rows over all shuffle partitions: narrow rows are few bytes, but their JSON is much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def twice(df, scope, raw, again):
    """(scope, raw): the rows, and those that fulfil ``again`` a second time, as they were before the edit ``raw``."""
    texts = F.when(again, F.array(raw, F.col("raw"))).otherwise(F.array(raw))
    return df.select(scope, texts.alias("_texts")).select(scope, F.explode_outer("_texts").alias("raw"))


def edited(raw, number, faults):
    """``raw`` with the fault of ``number``: (violation, text to find, text to put)."""
    fault = F.pmod(number, F.lit(len(faults) + 3)).cast("int")
    pick = lambda at: F.get(F.array(*[F.lit(f[at]) for f in faults]), fault)
    return F.coalesce(F.replace(raw, pick(1), pick(2)), raw)


def expected(number, faults):
    """SQL for the violation of a number, null for a row left sound."""
    names = ", ".join(f"'{f[0]}'" for f in faults)
    return f"([{names}])[{number} % {len(faults) + 3} + 1]"


IN_SESSIONS, IN_SCOPE = '"region":"r","sessions":[', '"checkedAt":"1998-06-01","sessions":['
EVENT_FAULTS = [
    ("identity", '"venue":"v"', '"venue":""'),
    ("identity", '"title":"t",', ""),
    ("session_date", IN_SESSIONS, IN_SESSIONS + '{"date":"1990-02-30"},'),
    ("session_time", IN_SESSIONS, IN_SESSIONS + '{"date":"1990-02-03","time":"24:10"},'),
    ("session_status", IN_SESSIONS, IN_SESSIONS + '{"date":"1990-02-03","status":"lost"},'),
    ("session_field", IN_SESSIONS, IN_SESSIONS + '{"date":"1990-02-03","note":"x"},'),
    ("source_url", '"https://source', '"https://me:pw@source'),
    ("status", '"scheduled"', '"lost"'),
    ("summary_length", '"summary":"s"', f'"summary":"{LONG}"'),
    ("event_field", '"title"', '"prose":"x","title"'),
    ("ticket_field", '"platform":"P"', '"platform":"P","seat":1'),
    ("ticket_url", 'example/e/1","checkedAt"', 'example/","checkedAt"'),
    ("ticket_platform", '"platform":"P"', '"platform":"<b>"'),
    ("ticket_checked", '"checkedAt":"1998-06-01"', '"checkedAt":"soon"'),
    ("ticket_scope", IN_SCOPE, IN_SCOPE + '{"date":"1990-01-01"},'),
    ("unreadable", '{"id"', '["id"'),
]
# A live event has a genre or not by its kind, so the fault of one kind is sound in the other.
LIVE_FAULTS = EVENT_FAULTS[:9] + [
    ("session_twice", IN_SESSIONS, IN_SESSIONS + '{"date":"1990-02-03"},{"date":"1990-02-03"},'),
    ("ticket_twice", '"tickets":[', '"tickets":[{"platform":"Q","url":"https://tickets.example/e/1","checkedAt":"1998-06-01","sessions":[{"date":"1990-02-03"}],"price":"9"},'
     '{"platform":"P","url":"https://tickets.example/e/1","checkedAt":"1998-06-01","sessions":[{"date":"1990-02-03"}],"price":"9"},'),
    ("tickets_missing", '"tickets"', '"programKey"'),
    ("ticket_unverified", '"ticketVerifiedAt":"1998-06-01"', '"ticketVerifiedAt":""'),
    ("ticket_button", '"ticketUrl":"https', '"ticketUrl":"http'),
    ("event_field", '"title"', '"prose":"x","title"'),
    ("genre", '"genre"', '"address"'),
    ("genre", '"address":"-"', '"genre":"爵士"'),
]


def _events(spark, sf, *more):
    """(number, empty, the columns of a sound event): orders with their distinct sessions, sold through one ticket."""
    slot = F.struct(F.col("day").cast("string").alias("date"), F.col("clock").alias("time"))
    s = spread(B.session(spark, sf).select("event", "day", "clock"), "event").groupBy("event").agg(F.collect_set(slot).alias("slots"))
    ticket = F.struct(
        F.lit("P").alias("platform"), F.lit("https://tickets.example/e/1").alias("url"), F.lit("1998-06-01").alias("checkedAt"),
        F.slice("slots", 1, 1).alias("sessions"),
    )
    e = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey").join(s, F.col("event") == F.col("o_orderkey"), "left")
    empty = F.col("slots").isNull()
    raw = F.to_json(F.struct(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_custkey").cast("string").alias("sourceUid"), F.lit("t").alias("title"),
        F.lit("r").alias("region"), F.coalesce("slots", F.array().cast("array<struct<date:string,time:string>>")).alias("sessions"), F.lit("v").alias("venue"),
        F.lit("https://source.example/e/1").alias("sourceUrl"), F.lit("scheduled").alias("status"), F.lit("s").alias("summary"),
        F.when(empty, F.array().cast("array<struct<platform:string,url:string,checkedAt:string,sessions:array<struct<date:string,time:string>>>>")).otherwise(F.array(ticket)).alias("tickets"),
        *more,
    ))
    return e.select(F.col("o_orderkey").alias("number"), "o_orderpriority", empty.alias("empty"), raw.alias("raw"))


EVENT_SQL = """e AS (SELECT o_orderkey AS number, o_orderpriority, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS no_slots FROM orders)"""


@query("chk_01_event_contract", f"""
WITH {EVENT_SQL}, v AS (SELECT *, CASE WHEN no_slots THEN 'sessions_empty' ELSE {expected('number', EVENT_FAULTS)} END AS violation FROM e)
SELECT o_orderpriority AS source, CASE WHEN violation <> 'unreadable' THEN 'e' || number END AS id, violation FROM v WHERE violation IS NOT NULL
""")
def chk_01_contract(spark, sf):
    e = _events(spark, sf)
    lines = e.select(F.col("o_orderpriority").alias("source_id"), F.when(F.col("empty"), F.col("raw")).otherwise(edited(F.col("raw"), F.col("number"), EVENT_FAULTS)).alias("raw"))
    return K.check(lines, K.event_import(), ["source_id"]).withColumnRenamed("source_id", "source")


LISTING_FAULTS = [
    ("locations_empty", '"locations":[{', '"locations":[],"park":[{'),
    ("location_name", '"name":"n"', '"name":""'),
    ("location_region", '"name":"n","region":"', '"name":"n","region":"un'),
    ("location_status", '"named"', '"odd"'),
    ("location_field", '"name":"n"', '"name":"n","lat":1'),
    ("location_field", '[{"id":"x",', "[{"),
    ("summary_length", '"summary":"x"', f'"summary":"{LONG}"'),
    ("price_length", '"price":"', f'"price":"{LONG}'),
    ("note_length", '"verificationNote":"x"', f'"verificationNote":"{LONG}"'),
    ("summary_markup", '"summary":"x"', '"summary":"<b>x</b>"'),
    ("url_provenance", '"url":"https://host.example/a"', '"url":"https://host.example/b"'),
    ("url_provenance", '"sourceUid":"0', '"sourceUid":"z'),
    ("listing_field", '"summary":"x"', '"image":"x","summary":"x"'),
    ("revision_field", '"lastSeen"', '"seenBy"'),
]


@query("chk_02_published_listings", LISTING + f"""
, v AS (SELECT source, id, {expected('id', LISTING_FAULTS)} AS violation FROM listing)
SELECT source AS provider, CAST(id AS VARCHAR) AS id, violation FROM v WHERE violation IS NOT NULL
UNION ALL SELECT source, CAST(id AS VARCHAR), 'duplicate_id' FROM listing WHERE venue = 'NATION_3'
""")
def chk_02_contract(spark, sf):
    place = F.struct(F.lit("x").alias("id"), F.lit("n").alias("name"), F.col("region"), F.lit("named").alias("status"))
    url = F.lit("https://host.example/a")
    raw = F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), "title", F.array(place).alias("locations"), "region", F.lit("x").alias("summary"), F.col("price").cast("string").alias("price"),
        F.lit("x").alias("verificationNote"), url.alias("url"), F.lit("moc").alias("source"), F.lpad(F.col("uid").cast("string"), 24, "0").alias("sourceUid"),
        url.alias("promoteUrl"), F.lit("verified").alias("sourceLinkState"), F.lit("1998-06-01").alias("sourceLinkCheckedAt"),
        F.array(F.struct(F.lit("old").alias("title"), F.lit("1998-01-01").alias("lastSeen"))).alias("revisions"),
    ))
    narrow = spread(B.listing(spark, sf).select("id", "source", "venue", "title", "region", "price", "uid"), "id")
    l = narrow.select("id", F.col("source").alias("provider"), "venue", raw.alias("raw"))
    # Listings of one venue were published twice; the second time without faults.
    lines = twice(l, "provider", edited(F.col("raw"), F.col("id"), LISTING_FAULTS), F.col("venue") == "NATION_3")
    return K.check(lines, K.published_listing(), ["provider"])


@query("chk_03_live_contract", f"""
WITH {EVENT_SQL}, v AS (SELECT *, CASE WHEN number % 3 = 0 THEN 'concerts' ELSE 'comedy' END AS kind, number % {len(LIVE_FAULTS) + 3} AS fault,
  CASE WHEN no_slots THEN 'sessions_empty' ELSE {expected('number', LIVE_FAULTS)} END AS violation FROM e)
SELECT kind, 'e' || number AS id, violation FROM v WHERE violation IS NOT NULL AND NOT (NOT no_slots AND violation = 'genre' AND (kind = 'concerts') <> (fault = {len(LIVE_FAULTS) - 2}))
UNION ALL SELECT kind, 'e' || number, 'ticket_scope' FROM v WHERE NOT no_slots AND violation = 'ticket_twice'
UNION ALL SELECT kind, 'e' || number, 'duplicate_id' FROM v WHERE o_orderpriority = '5-LOW' AND number % 7 = 0 AND NOT no_slots
""")
def chk_03_contract(spark, sf):
    concerts = F.col("o_orderkey") % 3 == 0
    more = [F.when(concerts, F.lit("爵士")).alias("genre"), F.when(~concerts, F.lit("-")).alias("address"),
            F.lit("https://tickets.example/e/1").alias("ticketUrl"), F.lit("1998-06-01").alias("ticketVerifiedAt")]
    e = _events(spark, sf, *more).withColumn("kind", F.when(F.col("number") % 3 == 0, "concerts").otherwise("comedy"))
    raw = F.when(F.col("empty"), F.col("raw")).otherwise(edited(F.col("raw"), F.col("number"), LIVE_FAULTS))
    return K.check(twice(e, "kind", raw, F.expr("o_orderpriority = '5-LOW' and number % 7 = 0 and not empty")), K.published_live(), ["kind"])


DATA = "https://calendar.example/data.json"
RACE_FAULTS = [
    ("id_pattern", '{"id":"r-', '{"id":"R '),
    ("status", '"status":"ok"', '"status":"lost"'),
    ("date_form", '"weekendEnd":"', '"weekendEnd":"x'),
    ("dates_ordered", '"weekendStart":"', '"weekendStart":"9'),
    ("data_source", '"dataSource":"https', '"dataSource":"http'),
    ("source", '"source":"https://calendar.example/', '"source":"https://other.example/'),
    ("race_field", '"sourceTimezone":"UTC",', ""),
    ("race_field", '"name":"a"', '"name":"a","image":"x"'),
    ("session_field", '"name":"race"', '"label":"race"'),
    ("session_end", '"end":null', '"end":"later"'),
    ("utc_offset", "+00:00", "+08:00"),
]


@query("chk_04_season_contract", f"""
WITH o AS (SELECT o_custkey AS season, o_orderkey AS number FROM orders), v AS (SELECT *, {expected('number', RACE_FAULTS)} AS violation FROM o)
SELECT season, CASE violation WHEN 'id_pattern' THEN 'R ' ELSE 'r-' END || number AS id, violation FROM v WHERE violation IS NOT NULL
UNION ALL SELECT season, 'r-' || number, 'date_form' FROM v WHERE violation = 'dates_ordered'
UNION ALL SELECT season, NULL, 'too_few_rows' FROM v GROUP BY season HAVING count(*) < 15
""")
def chk_04_contract(spark, sf):
    start = F.to_date("o_orderdate")
    slot = F.struct(F.lit("race").alias("name"), F.concat(start.cast("string"), F.lit("T00:00:00+00:00")).alias("start"), F.lit(None).cast("string").alias("end"))
    raw = F.to_json(F.struct(
        F.concat(F.lit("r-"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("a").alias("name"), start.cast("string").alias("weekendStart"),
        F.date_add(start, 2).cast("string").alias("weekendEnd"), F.lit("https://calendar.example/2026").alias("source"), F.lit(DATA).alias("dataSource"),
        F.lit("UTC").alias("sourceTimezone"), F.array(slot).alias("sessions"), F.lit(0).alias("missingTimes"), F.lit("1998-06-01").alias("lastSuccess"), F.lit("ok").alias("status"),
    ), {"ignoreNullFields": "false"})
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    lines = o.select(F.col("o_custkey").alias("season"), edited(raw, F.col("o_orderkey"), RACE_FAULTS).alias("raw"))
    return K.check(lines, K.calendar("https://calendar.example/", DATA), ["season"])


@query("chk_04_platform_links", f"""
SELECT source, CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 5 WHEN 1 THEN 'link_host' WHEN 2 THEN 'link_host' WHEN 3 THEN 'link_host' ELSE 'platform_field' END AS violation
FROM documents WHERE doc_id % 5 > 0
""")
def chk_04_platforms(spark, sf):
    url = F.get(F.array(*[F.lit(u) for u in ("https://www.example.tv/a", "https://evil.example/a", "http://www.example.tv/a", "https://me:pw@www.example.tv/a")]), (F.col("doc_id") % 5).cast("int"))
    links = F.array(F.struct(F.lit("https://video.example.org/b").alias("url")), F.struct(F.coalesce(url, F.lit("https://www.example.tv/a")).alias("url")))
    texts = [F.lit("x").alias(c) for c in ("region", "kind", "description", "conditions")]
    raw = F.to_json(F.struct(F.lit("n").alias("name"), *texts, F.lit(True).alias("verified"), links.alias("links")))
    raw = F.when(F.col("doc_id") % 5 == 4, F.replace(raw, F.lit('"kind":"x",'), F.lit(""))).otherwise(raw)
    named = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("number"), raw.alias("raw"))
    broken = K.check(named, K.platforms(LINK_HOSTS), ["source", "number"])
    return broken.select("source", F.col("number").alias("id"), "violation")
