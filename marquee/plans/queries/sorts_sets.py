"""Sort, top-k and set operators (srt_*, set_*)."""

from __future__ import annotations

from marquee.functions import text as T, values as V
from marquee.operators import overlay as O, quality as Q, search as S
from marquee.plans.queries.common import *  # noqa: F403

FIRST_REGIONS = ["ASIA", "EUROPE"]
RANK_SQL = "CASE region WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 ELSE 2 END"
ORDER_SQL = {
    "all": f"{RANK_SQL}, coalesce(start_day, DATE '9999-12-31'), title, id",
    "ending": f"coalesce(end_day, DATE '9999-12-31'), {RANK_SQL}, id",
    "history": "end_day DESC, id",
}
WHERE_SQL = {
    "all": f"(end_day IS NULL OR end_day >= {AS_OF_SQL})",
    "ending": f"start_day <= {AS_OF_SQL} AND end_day >= {AS_OF_SQL} AND end_day - {AS_OF_SQL} <= 14",
    "history": f"end_day < {AS_OF_SQL}",
}


def _ordered(view):
    @query(f"srt_01_order_{view}", LISTING + f"""
SELECT row_number() OVER (ORDER BY {ORDER_SQL[view]}) AS pos, id, region, start_day, end_day FROM listing WHERE {WHERE_SQL[view]}
""")
    def run(spark, sf):
        from marquee.operators.ranking import positions

        # The whole ordered view: range partitions numbered on their own and shifted.
        hits = B.listing(spark, sf).where(S.view_predicate(view, as_of())).select("id", "title", "region", "start_day", "end_day", F.lit(1).alias("view"))
        out = positions(hits, ["view"], S.order_for(view, FIRST_REGIONS))
        return out.select(F.col("pos").cast("bigint").alias("pos"), "id", "region", "start_day", "end_day")


for _v in ORDER_SQL:
    _ordered(_v)


@query("srt_02_paged_limit", LISTING + f"""
SELECT id, title, start_day, end_day FROM listing WHERE {WHERE_SQL['all']} ORDER BY {ORDER_SQL['all']} LIMIT 24
""")
def srt_02(spark, sf):
    hits = B.listing(spark, sf).where(S.view_predicate("all", as_of()))
    return S.page(hits, S.order_for("all", FIRST_REGIONS)).select("id", "title", "start_day", "end_day")


@query("srt_03_session_order", SESSION + """
SELECT event, day, clock, row_number() OVER (PARTITION BY event ORDER BY day, coalesce(clock, '')) AS pos
FROM (SELECT DISTINCT event, day, clock FROM session)
""")
def srt_03(spark, sf):
    from marquee.operators.ranking import positions

    # Positions of a range-partitioned table: an event with most of the rows spreads over tasks.
    s = B.session(spark, sf).select("event", "day", "clock").distinct()
    out = positions(s, ["event"], [F.col("day"), F.coalesce("clock", F.lit(""))])
    return out.select("event", "day", "clock", F.col("pos").cast("bigint").alias("pos"))


@query("srt_04_genre_order", """
SELECT lang, CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 99 END AS rank, count(*) AS n FROM documents GROUP BY 1, 2
""")
def srt_04(spark, sf):
    rank = S.genre_rank(F.col("lang"), ["fr", "en", "de"])
    return table(spark, sf, "documents").groupBy("lang", rank.cast("bigint").alias("rank")).agg(F.count("*").alias("n"))


@query("srt_05_facet_order", """
SELECT row_number() OVER (ORDER BY n_name) AS pos, n_name AS value FROM nation
""")
def srt_05(spark, sf):
    from marquee.operators.ranking import positions

    return positions(table(spark, sf, "nation").select(F.col("n_name").alias("value"), F.lit(1).alias("facet")), ["facet"], [F.col("value")]).select(
        F.col("pos").cast("bigint").alias("pos"), "value"
    )


@query("srt_06_capped_list", """
WITH d AS (SELECT DISTINCT l_orderkey AS event, l_suppkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY l_suppkey) AS rn FROM d)
SELECT event, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY rn) AS first_three FROM r WHERE rn <= 3 GROUP BY 1
""")
def srt_06(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), "l_suppkey").distinct()
    # The literal limit is a group limit: each task keeps three rows per event before the shuffle.
    w = Window.partitionBy("event").orderBy("l_suppkey")
    head = d.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    arr = F.array_sort(F.collect_list("l_suppkey"))
    return head.groupBy("event").agg(F.array_join(F.transform(arr, lambda x: x.cast("string")), ",").alias("first_three"))


@query("set_01_ordered_union", """
SELECT doc_id, source, NULL::VARCHAR AS note, 0 AS prio FROM documents WHERE source = 'src1'
UNION ALL SELECT doc_id, source, lang, 1 FROM documents WHERE source = 'src2'
UNION ALL SELECT doc_id, source, NULL, 2 FROM documents WHERE source NOT IN ('src1', 'src2')
""")
def set_01(spark, sf):
    d = table(spark, sf, "documents")
    cols = d.select("doc_id", "source")
    return O.ordered_union([
        cols.where("source = 'src1'"),
        d.where("source = 'src2'").select("doc_id", "source", F.col("lang").alias("note")),
        cols.where("source NOT IN ('src1', 'src2')"),
    ])


@query("set_02_union_sessions", SESSION + """
SELECT event, count(DISTINCT (day, coalesce(clock, ''))) AS merged FROM session GROUP BY 1
""")
def set_02(spark, sf):
    s = B.session(spark, sf)
    first = F.col("platform").isin("KKTIX", "OPENTIX")
    sides = s.where(first).select("event", "day", "clock").union(s.where(~first).select("event", "day", "clock")).distinct()
    return sides.groupBy("event").agg(F.count("*").alias("merged"))


@query("set_03_intersection", SESSION + """
, a AS (SELECT event, array_agg(DISTINCT day) FILTER (platform = 'KKTIX') AS x, array_agg(DISTINCT day) FILTER (platform <> 'KKTIX') AS y FROM session GROUP BY 1)
SELECT event, coalesce(list_has_any(x, y), false) AS overlaps, coalesce(len(list_intersect(x, y)), 0) AS shared FROM a
""")
def set_03(spark, sf):
    k = F.col("platform") == "KKTIX"
    days = B.session(spark, sf).groupBy("event", "day").agg((F.bool_or(k) & F.bool_or(~k)).alias("both"))
    return days.groupBy("event").agg(F.bool_or("both").alias("overlaps"), F.count_if("both").alias("shared"))


@query("set_04_extra_keys", """
SELECT event_id, array_to_string(list_filter(json_keys(props), lambda k: k NOT IN ('a', 'b')), ',') AS extra FROM events
""")
def set_04(spark, sf):
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.array_join(Q.extra_keys(keys, ["a", "b"]), ",").alias("extra"))


@query("set_05_subset_equality", """
WITH v AS (SELECT conv_id, list_sort(array_agg(DISTINCT turn)) AS visited, max(turn) AS top, count(*) AS n FROM conversations GROUP BY 1),
e AS (SELECT *, range(0, top + 1 + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END) AS expected FROM v)
SELECT conv_id, len(list_filter(visited, lambda x: NOT list_contains(expected, x))) = 0 AS valid,
       len(list_filter(visited, lambda x: NOT list_contains(expected, x))) = 0 AND len(list_filter(expected, lambda x: NOT list_contains(visited, x))) = 0 AS complete FROM e
""")
def set_05(spark, sf):
    # Expected turns are 0 to a top: bounds and a distinct count decide, without listing either side.
    top = F.max("turn") + F.max(F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("low"), F.count_distinct("turn").alias("n"), top.alias("top"))
    valid = F.col("low") >= 0
    return c.select("conv_id", valid.alias("valid"), (valid & (F.col("n") == F.col("top") + 1)).alias("complete"))


@query("set_06_keep_first", f"""
SELECT {host_sql('url')} AS host, {url_sql('url', 3)} AS path, min(page_id) AS page_id FROM pages GROUP BY 1, 2
""")
def set_06(spark, sf):
    from marquee.functions import urls as U
    from marquee.operators.ranking import first_per_key

    p = table(spark, sf, "pages").select(U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"), "page_id")
    return first_per_key(p, ["host", "path"], F.col("page_id"))
