"""Sources and sinks (src_*, snk_*)."""

from __future__ import annotations

import tempfile
from functools import reduce

from marquee.functions import urls as U
from marquee.operators import quality as Q
from marquee.plans import builds as BU
from marquee.plans.queries.common import *  # noqa: F403
from marquee.sources import readers as R, sinks


@query("src_01_provider_scan", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       coalesce(CAST(json_extract(props, '$.K') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT)) AS either
FROM events
""")
def src_01(spark, sf):
    # Provider rows as JSON files in the shared folder, odd ones with the second spelling of the show
    # list and the price; the provider reader unites both.
    root = _out_dir(spark, "provider")
    k = F.get_json_object("props", "$.k")
    show = lambda name: F.to_json(F.array(F.struct(F.col("event_type").alias("locationName"), k.alias(name))))
    row = lambda shows, price: F.concat(F.lit('{"UID":"'), F.col("event_id").cast("string"), F.lit('","category":"'), F.col("event_type"), F.lit(f'","{shows}":'), show(price), F.lit("}"))
    e = table(spark, sf, "events")
    e.select(F.when(F.col("event_id") % 2 == 0, row("showInfo", "price")).otherwise(row("showinfo", "Price"))).write.text(root)
    rows = R.read_provider(spark, root)
    price = F.get("shows", F.lit(0))["price"].cast("bigint")
    return rows.select(F.col("UID").cast("bigint").alias("event_id"), F.col("category").alias("event_type"), price.alias("k"), price.alias("either"))


@query("src_02_kind_fanout", """
SELECT CASE event_type WHEN 'purchase' THEN 'concerts' WHEN 'view' THEN 'comedy' END AS kind,
       count(*) AS n, count(DISTINCT user_id) AS entities, bool_or(event_type IN ('purchase', 'view')) AS category_seen
FROM events GROUP BY 1
""")
def src_02(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "concerts").when(F.col("event_type") == "view", "comedy")
    e = table(spark, sf, "events")
    return e.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("entities"),
        F.bool_or(F.col("event_type").isin("purchase", "view")).alias("category_seen"),
    )


@query("src_02_category_builds", """
WITH k(kind, code) AS (VALUES ('concerts', 'purchase'), ('comedy', 'view'), ('festivals', 'festival'))
SELECT kind, CASE WHEN count(event_id) > 0 THEN 'published' ELSE 'category' END AS outcome, count(event_id) AS n, max(event_id) AS last_id
FROM k LEFT JOIN events ON event_type = code GROUP BY kind
""")
def src_02_builds(spark, sf):
    # One build for each kind: the guard sees the whole feed, the version holds the rows of its category.
    feed, parts = table(spark, sf, "events").select("event_id", "event_type"), []
    for kind, code in (("concerts", "purchase"), ("comedy", "view"), ("festivals", "festival")):
        root = _out_dir(spark, f"kind-{kind}")
        guard = sinks.Guarded(feed, {"category": ~F.bool_or(F.col("event_type") == code)})
        outcome = sinks.publish_guarded(guard.rows.where(F.col("event_type") == code), guard, root, "1")
        rows = sinks.read_committed(spark, root, "event_id bigint")
        parts.append(rows.agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")).select(F.lit(kind).alias("kind"), F.lit(outcome).alias("outcome"), "n", "last_id"))
    return reduce(lambda a, b: a.union(b), parts)


@query("grd_02_guarded_snapshots", """
WITH k(lang) AS (VALUES ('en'), ('fr'), ('de'), ('xx')), d AS (
  SELECT k.lang, count(doc_id) AS n, count(*) FILTER (doc_id IS NOT NULL AND contains(text, 'qu')) AS bad, max(doc_id) AS last_id
  FROM k LEFT JOIN documents ON documents.lang = k.lang GROUP BY 1)
SELECT lang, CASE WHEN n = 0 THEN 'empty' WHEN bad > n * 0.2 THEN 'rejected' ELSE 'published' END AS outcome,
  CASE WHEN n = 0 OR bad > n * 0.2 THEN 0 ELSE n - bad END AS n FROM d
""")
def grd_02_guarded(spark, sf):
    # Guards count while the version is written: an empty language and one with too many rejected rows stay unpublished.
    docs, parts = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").contains("qu").alias("bad")), []
    for lang in ("en", "fr", "de", "xx"):
        root = _out_dir(spark, f"lang-{lang}")
        n, bad = F.count("*"), F.count_if("bad")
        guard = sinks.Guarded(docs.where(F.col("lang") == lang), {"empty": n == 0, "rejected": Q.rejection_guard(bad, n)})
        outcome = sinks.publish_guarded(guard.rows.where(~F.col("bad")), guard, root, "1")
        rows = sinks.read_committed(spark, root, "doc_id bigint")
        parts.append(rows.agg(F.count("*").alias("n")).select(F.lit(lang).alias("lang"), F.lit(outcome).alias("outcome"), "n"))
    return reduce(lambda a, b: a.union(b), parts)


@query("src_03_snapshot_scan", """
SELECT source, lang AS kind, count(*) AS n, max(doc_id) AS last_doc FROM documents
WHERE regexp_matches(source, '^[a-z0-9][a-z0-9-]{0,63}$') GROUP BY 1, 2
""")
def src_03(spark, sf):
    # The snapshot is written by (kind, source) once and scanned over all kinds. Folder names don't tell an
    # empty kind from an absent one, so the language is in the rows too.
    root = _out_dir(spark, "snapshot")
    d = table(spark, sf, "documents").where(F.col("source").rlike(R.SOURCE_ID))
    rows = d.select("doc_id", "lang", F.col("lang").alias("kind"), F.col("source").alias("source_id"))
    rows.hint("rebalance", "kind").write.partitionBy("kind", "source_id").parquet(root)
    rows = R.read_snapshot(spark, root, schema="doc_id bigint, lang string")
    return rows.groupBy(F.col("source_id").alias("source"), F.col("lang").alias("kind")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))


@query("src_04_registry_check", """
SELECT CAST(s_nationkey AS VARCHAR) AS id, count(*) AS n, 'duplicate' AS problem
FROM supplier GROUP BY s_nationkey HAVING count(*) > 1
""")
def src_04(spark, sf):
    return R.registry_problems(table(spark, sf, "supplier"), "s_nationkey")


@query("src_05_sitemap_scan", r"""
SELECT DISTINCT trim(url) AS url FROM pages WHERE regexp_matches(url, '^https://[^/]+/[a-z]{2}/\d+$')
""")
def src_05(spark, sf):
    # Sitemap files of the page table, written to the shared folder and read as XML.
    root = _out_dir(spark, "sitemap")
    loc = F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;")
    nodes = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 1000).alias("n"), F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>")).alias("x"))
    nodes.groupBy("n").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("x"), ""), F.lit("</urlset>")).alias("doc")).select("doc").write.text(root)
    return R.read_sitemap(spark, root, r"^https://[^/]+/[a-z]{2}/\d+$")


@query("src_06_feed_scan", """
SELECT c_custkey AS feed, count(event_id) AS entries, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum,
       count(event_id) = 0 AS empty_feed
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1
""")
def src_06(spark, sf):
    # Entries as JSON feed files in the shared folder, one feed object a row, read with the declared
    # schema. Feeds come from the registry, so one without entries shows.
    root = _out_dir(spark, "feed")
    entry = F.struct(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("title"), F.lit("").alias("summary"), F.col("props").alias("content"))
    table(spark, sf, "events").select(F.to_json(F.struct(F.array(entry).alias("entry")))).write.text(root)
    e = R.read_feed(spark, root).select(F.col("url").cast("bigint").alias("feed"), F.from_json("content", "k BIGINT")["k"].alias("k"))
    n = e.groupBy("feed").agg(F.count("*").alias("entries"), F.sum("k").alias("k_sum"))
    feeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("feed"))
    return feeds.join(n, "feed", "left").select("feed", F.coalesce("entries", F.lit(0)).alias("entries"), "k_sum", F.col("entries").isNull().alias("empty_feed"))


@query("src_07_envelope_scan", """
SELECT conv_id AS page_id, turn AS item_pos, role AS item_kind, length(text) AS n_chars FROM conversations
""")
def src_07(spark, sf):
    # One JSON envelope a turn, in files of the shared folder, read with the declared schema and exploded.
    root = _out_dir(spark, "envelopes")
    item = F.struct(F.col("turn").cast("string").alias("sourceUid"), F.create_map(F.lit("kind"), F.col("role"), F.lit("text"), F.col("text")).alias("evidence"))
    page = F.struct(F.col("conv_id").cast("string").alias("id"), F.array(item).alias("items"))
    table(spark, sf, "conversations").select(F.to_json(F.struct(F.lit("talks").alias("sourceId"), F.array(page).alias("pages")))).write.text(root)
    items = R.explode_envelope(R.read_envelopes(spark, root))
    return items.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("item.sourceUid").cast("bigint").alias("item_pos"), F.col("item.evidence")["kind"].alias("item_kind"),
        F.length(F.col("item.evidence")["text"]).cast("bigint").alias("n_chars"),
    )


IMPORTS_SQL = """
WITH d AS (SELECT source, lang AS kind, doc_id, doc_id % 6 <> 1 AS listed, doc_id % 4 <> 0 AS held, CAST(replace(source, 'src', '') AS INTEGER) AS s,
    CASE WHEN doc_id % 5 = 0 THEN 'excluded' WHEN doc_id % 7 = 0 THEN 'pending' WHEN lang = 'es' AND doc_id % 11 = 0 THEN 'failed' ELSE 'included' END AS decision FROM documents),
t AS (SELECT source, kind, any_value(s) AS s, count(*) FILTER (listed) AS discovered, count(*) FILTER (listed AND decision = 'included') AS included,
    count(*) FILTER (listed AND decision = 'failed') AS failed FROM d GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN s % 10 = 1 OR s % 10 = 9 AND kind = 'fr' THEN 'NOT_REGISTERED' WHEN s % 10 = 2 THEN 'REVIEW_DAY' WHEN s % 10 = 3 THEN 'EXPECTED_PAGES' WHEN s % 10 = 4 THEN 'VISITED_PAGES'
    WHEN s % 10 = 5 THEN 'PAGE_URL' WHEN discovered = 0 THEN 'NO_ITEMS' WHEN failed > 0 THEN 'INVALID_FACTS' END AS reason FROM t),
w AS (SELECT *, reason IS NULL AND s % 10 IN (0, 7, 9) AS whole FROM v)
"""


@query("src_07_reviewed_envelopes", IMPORTS_SQL + """
SELECT source AS source_id, kind, reason IS NULL AS ok, reason, whole, discovered, included, failed FROM w
""")
def src_07_reviewed(spark, sf):
    out = _imports(spark, sf)[0]
    return out.select(F.col("sourceId").alias("source_id"), "kind", "ok", "reason", F.col("coverageComplete").alias("whole"), "discovered", "included", "failed")


@query("joi_02_reviewed_imports", IMPORTS_SQL + f"""
SELECT source AS source_id, kind, CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN fresh AND held AND doc_id % 3 = 0 THEN 'changed' WHEN fresh THEN 'scheduled' WHEN doc_id % 9 = 0 THEN 'cancelled' WHEN whole THEN 'unconfirmed' ELSE 'scheduled' END AS status,
  CASE WHEN NOT fresh AND doc_id % 9 <> 0 AND whole THEN '{V.NOTE_NOT_LISTED}' END AS note, CASE WHEN fresh AND held AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS revisions
FROM (SELECT d.*, whole, listed AND decision = 'included' AND reason IS NULL AS fresh FROM d JOIN w USING (source, kind)) WHERE fresh OR held
""")
def joi_02_reviewed(spark, sf):
    verdicts, events, previous = _imports(spark, sf)
    out = BU.reviewed_snapshots(verdicts, events, previous, f"{B.EVENTS_AS_OF}T09:00:00+08:00")
    return out.select(F.col("sourceId").alias("source_id"), "kind", "id", "status", F.col("statusNote").alias("note"), F.size("revisions").cast("bigint").alias("revisions"))


def _imports(spark, sf):
    """Documents as reviewed items: an envelope for each source and language, a fault by the source's last digit."""
    n = F.col("doc_id")
    d = table(spark, sf, "documents").select(F.col("source").alias("sourceId"), F.col("lang").alias("kind"), "doc_id").withColumn("s", F.replace("sourceId", F.lit("src"), F.lit("")).cast("int") % 10)
    decision = F.when(n % 5 == 0, "excluded").when(n % 7 == 0, "pending").when((F.col("kind") == "es") & (n % 11 == 0), "failed").otherwise(F.lit("included"))
    items = d.where(n % 6 != 1).withColumn("decision", decision)
    s = F.col("s")
    page = lambda i, url="https://reviewed.example/": F.struct(F.lit(i).alias("id"), F.lit(url + i).alias("url"))
    two = F.array(page("p1"), page("p2"))
    # 6 lacks a page that it expects, 8 claims no complete traversal.
    expected = F.when(s == 3, F.array(F.lit("p1"), F.lit("p2"), F.lit("p1"))).when(s == 6, F.array(*map(F.lit, ("p1", "p2", "p3")))).otherwise(F.array(F.lit("p1"), F.lit("p2")))
    envelopes = d.select("sourceId", "kind", "s").distinct().select(
        "sourceId", "kind", F.when(s == 2, "2024-02-30").otherwise(F.lit(B.EVENTS_AS_OF)).alias("reviewedAt"),
        F.struct(F.lit("listing").alias("scope"), expected.alias("expectedPageIds"), (s != 8).alias("complete")).alias("traversal"),
        F.when(s == 4, F.array(page("p1"), page("p4"))).when(s == 5, F.array(page("p1"), page("p2", "http://reviewed.example/"))).otherwise(two).alias("pages"),
    )
    kinds = F.array_except(F.array(*map(F.lit, ("en", "de", "fr", "es"))), F.when(s == 9, F.array(F.lit("fr"))).otherwise(F.array().cast("array<string>")))
    registry = d.select("sourceId", "s").distinct().select(F.col("sourceId").alias("id"), F.when(s == 1, "feed").otherwise(F.lit("reviewed-json")).alias("adapter"), kinds.alias("kinds"))
    shape = lambda rows, time, status: rows.select(
        "sourceId", "kind", n.cast("string").alias("id"), F.array(F.struct(F.lit(B.EVENTS_AS_OF).cast("date").alias("date"), time.alias("time"))).alias("sessions"),
        status.alias("status"), F.lit(None).cast("string").alias("statusNote"), F.expr("cast(array() as array<struct<at:string,note:string,previousSessions:array<struct<date:date,time:string>>>>)").alias("revisions"),
    )
    events = shape(items.where("decision = 'included'"), F.lit("19:30"), F.lit("scheduled"))
    previous = shape(d.where(n % 4 != 0), F.when(n % 3 == 0, "14:30").otherwise(F.lit("19:30")), F.when(n % 9 == 0, "cancelled").otherwise(F.lit("scheduled")))
    return BU.envelope_verdicts(envelopes, registry, items, f"{B.EVENTS_AS_OF}T09:00:00+08:00"), events, previous


@query("src_08_batch_totals", """
SELECT count(*) AS events, sum(n)::BIGINT AS sessions, sum(n) = (SELECT count(*) FROM lineitem) AS totals_agree
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
""")
def src_08(spark, sf):
    # Per-event session counts first: the join sees one row per order.
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select("o_orderkey")
    events = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    declared = table(spark, sf, "lineitem").agg(F.count("*")).scalar()
    totals = R.batch_totals(events, F.coalesce("n", F.lit(0)))
    return totals.select("events", "sessions", (F.col("sessions") == declared).alias("totals_agree"))


@query("src_09_dimension_or_empty", """
SELECT d.source, count(*) AS docs, count(l.doc_id) AS labelled, 0 AS overridden FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0 GROUP BY 1
""")
def src_09(spark, sf):
    # One dimension was written by an earlier step, the other never.
    root = _out_dir(spark, "dimension")
    table(spark, sf, "labels").where("toxic = 0").write.json(root)
    d = table(spark, sf, "documents").select("doc_id", "source")
    l = R.read_or_empty(spark, root, "doc_id bigint, quality int", multi_line=False)
    o = R.read_or_empty(spark, f"{root}-never", "doc_id bigint, override string")
    return d.join(l, "doc_id", "left").join(o, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count("override").cast("int").alias("overridden")
    )


@query("src_10_page_corpus", f"""
SELECT page_id, {host_sql('url')} AS host, length(html) AS n_chars FROM pages
""")
def src_10(spark, sf):
    p = R.read_pages(spark, f"{sf}/pages.parquet")
    return p.select("page_id", U.host(F.col("url")).alias("host"), F.length("html").cast("bigint").alias("n_chars"))


def _scratch(name: str) -> str:
    return tempfile.mkdtemp(prefix=f"marquee-{name}-")


def _out_dir(spark, name: str) -> str:
    """A folder of its own for each run, under the cluster's shared folder where one is set."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else _scratch(name)


@query("snk_01_publish_snapshot", f"""
SELECT event_type, count(*) AS n, '2024-01-30T09:00:00' AS generated_at, 1 AS schema_version FROM events GROUP BY 1
""")
def snk_01(spark, sf):
    root = _out_dir(spark, "publish")
    out = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    sinks.publish(out, root, "2024-01-30T09:00:00", 1)
    return sinks.read_current(spark, root)


@query("snk_02_status_sink", """
SELECT user_id AS source, CAST(ts AS DATE) AS day, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failed
FROM events GROUP BY 1, 2
""")
def snk_02(spark, sf):
    root = _out_dir(spark, "status")
    e = table(spark, sf, "events")
    sinks.append_status(
        e.groupBy(F.col("user_id").alias("source"), F.to_date("ts").alias("day")).agg(
            F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failed")
        ),
        root,
    )
    return spark.read.parquet(root)


@query("snk_03_decision_ledger", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'included' ELSE 'excluded' END AS decision,
       CASE WHEN lang = 'en' THEN 'LANGUAGE_OK' ELSE 'OTHER_LANGUAGE' END AS reason,
       source AS source_id, '2024-01-30' AS run_day
FROM documents
""")
def snk_03(spark, sf):
    root = _out_dir(spark, "ledger")
    d = table(spark, sf, "documents")
    ok = F.col("lang") == "en"
    ledger = d.select(
        "doc_id", F.when(ok, "included").otherwise("excluded").alias("decision"),
        F.when(ok, "LANGUAGE_OK").otherwise("OTHER_LANGUAGE").alias("reason"),
        F.col("source").alias("source_id"), F.lit("2024-01-30").alias("run_day"),
    )
    # Rebalance keeps few files per source and lets AQE split a source that holds most rows.
    sinks.append_decisions(ledger.hint("rebalance", F.col("source_id")), root)
    return spark.read.schema("doc_id bigint, decision string, reason string, source_id string, run_day string").parquet(root)


@query("snk_04_state_checkpoint", """
SELECT user_id AS id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1
""")
def snk_04(spark, sf):
    root = _out_dir(spark, "state")
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    sinks.save_state(e, root, "2024-01-30")
    # The same step again replaces itself: the state does not grow.
    return sinks.save_state(e, root, "2024-01-30")
