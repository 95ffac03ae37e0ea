"""Facts from raw pages and feed text (ext_*). Whole texts, built-in expressions, one narrow stage each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import dates as D, text as T, urls as U, values as V

ANCHOR = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def first_heading(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)


def title_and_headings(df: DataFrame, html: Column) -> DataFrame:
    """ext_01: cleaned title, first heading and all h1/h2 headings."""
    heads = F.regexp_extract_all(html, F.lit(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), F.lit(1))
    return df.withColumns(
        {
            "title": T.clean(page_title(html)),
            "heading": T.clean(first_heading(html)),
            "headings": F.concat_ws(" ", F.transform(heads, lambda h: T.clean(h))),
        }
    )


def title_confirmed(html: Column, expected: Column) -> Column:
    """chk_08: the expected key occurs in the title and in the headings."""
    key = T.word_key(expected)
    heads = F.concat_ws(" ", F.regexp_extract_all(html, F.lit(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), F.lit(1)))
    return (
        (F.length(key) > 0)
        & T.word_key(T.clean(page_title(html))).contains(key)
        & T.word_key(T.clean(heads)).contains(key)
    )


def anchors(df: DataFrame, page_url: str, html: str, keep: list[str]) -> DataFrame:
    """ext_02: one row per anchor with its href, absolute URL and cleaned text."""
    # The page is matched once; the parts are taken from each short match. Outer form: a plain
    # explode would scan the page again in an inferred filter.
    found = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    rows = df.select(*keep, page_url, F.posexplode_outer(found).alias("pos", "a")).where("pos IS NOT NULL")
    part = lambda i: F.regexp_extract("a", ANCHOR, i)
    named = rows.select(*keep, page_url, "pos", T.unescape_named(part(1)).alias("href"), T.clean(part(2)).alias("label"))
    return named.select(*keep, page_url, "pos", "href", U.absolute(F.col(page_url), F.col("href")).alias("url"), "label")


def cards(links: DataFrame, page_url: str, key: list[str]) -> DataFrame:
    """ext_02: listed pages, one row per (key, URL): same host, no query; the last card wins."""
    same = (U.host(F.col("url")) == U.host(F.col(page_url))) & (U.query(F.col("url")) == "") & (U.fragment(F.col("url")) == "")
    listed = links.where(same & (F.length("label") > 0))
    title = T.without_badge(F.col("label"))
    return listed.groupBy(*key, "url").agg(
        F.max_by(F.struct(title.alias("title"), T.badge_of(F.col("label")).alias("badge")), F.col("pos")).alias("c")
    ).select(*key, "url", "c.*")


def ticket_links(links: DataFrame, key: list[str], hosts: dict[str, str], suffixes: dict[str, str], cap: int = 3) -> DataFrame:
    """ext_11: detail links of known platforms, the first three of each page.

    The cap is part of the operator. A page's links are one document's, so its group is small.
    """
    kept = links.withColumn("platform", U.platform_of(F.col("url"), hosts, suffixes)).where(
        F.col("platform").isNotNull() & U.is_detail(F.col("url"))
    )
    return kept.groupBy(*key).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "platform", "url"))), 1, cap).alias("t")
    ).select(*key, F.explode("t").alias("t")).select(*key, "t.platform", "t.url", "t.pos")


MAIN_DROP = r"(?is)<(script|style|nav|header|footer|svg)\b[^>]*>.*?</\1\s*>"


def main_text(html: Column) -> Column:
    """ext_10: text without scripts, styles, navigation, header and footer."""
    return T.collapse(T.unescape_named(F.regexp_replace(F.regexp_replace(html, MAIN_DROP, " "), "<[^>]*>", " ")))


def content_digest(html: Column) -> Column:
    """chk_07: fingerprint of the main text."""
    return F.sha2(main_text(html).cast("binary"), 256)


def fields_by_rules(df: DataFrame, html: Column, rules: dict[str, str]) -> DataFrame:
    """ext_03: one column per rule; a rule is a pattern with one group."""
    return df.withColumns({name: T.clean(F.regexp_extract(html, pattern, 1)) for name, pattern in rules.items()})


JSON_LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def json_ld_events(df: DataFrame, html: str, key: list[str]) -> DataFrame:
    """ext_04: schema.org Event objects of a page, block and item positions kept.

    Blocks that are not JSON are skipped; a block may be one object or a list.
    """
    blocks = df.select(*key, F.posexplode_outer(F.regexp_extract_all(F.col(html), F.lit(JSON_LD), F.lit(1))).alias("block", "text"))
    parsed = blocks.select(*key, "block", "text", F.try_parse_json("text").alias("v")).where("block IS NOT NULL AND v IS NOT NULL")
    as_list = parsed.select(
        *key, "block",
        F.when(F.ltrim(F.regexp_replace("text", r"^\s+", "")).startswith("["), F.try_variant_get("v", "$", "array<variant>"))
        .otherwise(F.array("v")).alias("items"),
    )
    items = as_list.select(*key, "block", F.posexplode("items").alias("item", "e"))
    get = lambda p, t="string": F.try_variant_get("e", p, t)
    # Only whole numbers count as prices; quoted and fractional ones are no facts.
    whole = lambda p: F.when(F.schema_of_variant(get(p, "variant")) == "BIGINT", get(p, "int"))
    return items.where(get('$["@type"]') == "Event").select(
        *key, "block", "item",
        T.clean(get("$.name")).alias("name"),
        T.clean(get("$.location.name")).alias("venue"),
        T.collapse(F.concat_ws(" ", get("$.location.address.addressLocality"), get("$.location.address.streetAddress"))).alias("address"),
        T.clean(get("$.description")).alias("description"),
        F.substring(get("$.startDate"), 1, 19).alias("start"),
        F.coalesce(get("$.eventStatus").contains("Cancelled"), F.lit(False)).alias("cancelled"),
        whole("$.offers.lowPrice").alias("low"),
        whole("$.offers.highPrice").alias("high"),
        F.coalesce(get("$.offers.availabilityStarts"), get("$.offers.validFrom")).alias("sale"),
    )


def page_facts(events: DataFrame, key: str) -> DataFrame:
    """agg_18: facts of a page from its Event items that share name and venue with the first one.

    Sessions are the scheduled ones, or the cancelled ones when every item is cancelled. A page with
    an unreadable start has no facts.
    """
    order = F.struct("block", "item")
    first = events.groupBy(key).agg(
        F.min_by(F.struct("name", "venue", "address", "description", "low", "high", "sale"), order).alias("f")
    )
    point = F.struct(D.strict_date(F.substring("start", 1, 10)).alias("date"), F.substring("start", 12, 5).alias("time"))
    same = events.select(key, "name", "venue", "cancelled", point.alias("s")).join(first, key).where(
        (F.col("name") == F.col("f.name")) & F.col("venue").eqNullSafe(F.col("f.venue"))
    )
    agg = same.groupBy(key).agg(
        F.first("f").alias("f"),
        F.array_sort(F.collect_set(F.when(~F.col("cancelled"), F.col("s")))).alias("_on"),
        F.array_sort(F.collect_set(F.when(F.col("cancelled"), F.col("s")))).alias("_off"),
        F.bool_or(F.col("s.date").isNull()).alias("_unreadable"),
    ).where("NOT _unreadable")
    all_off = (F.size("_on") == 0) & (F.size("_off") > 0)
    stamped = F.col("f.sale").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
    return agg.select(
        key, F.col("f.name").alias("title"), F.col("f.venue").alias("venue"), F.col("f.address").alias("address"),
        T.region_with_short(F.concat_ws(" ", "f.address", "f.venue")).alias("region"),
        F.when(all_off, F.col("_off")).otherwise(F.col("_on")).alias("sessions"),
        T.price_range(F.col("f.low"), F.col("f.high")).alias("price"),
        F.when(stamped, F.concat(F.col("f.sale"), F.lit("+08:00"))).alias("saleAt"),
        F.col("f.description").alias("description"),
        all_off.alias("cancelled"),
    )


FEED_TIME = (
    r"時間：\s*(\d{4})/(\d{2})/(\d{2})\s+(\d{2}:\d{2})\(\+0800\)"
    r"\s*(?:~\s*(?:(\d{4})/(\d{2})/(\d{2})\s+)?(\d{2}:\d{2}))?"
)


def feed_time_place(content: Column) -> Column:
    """ext_05: struct(day, clock, end_day, venue, address) of a feed text. Day is NULL when absent."""
    c = F.replace(T.collapse(T.unescape_named(T.or_empty(content))), F.lit(" 地點："), F.lit("\n地點："))
    g = lambda i: F.regexp_extract(c, FEED_TIME, i)
    has = c.rlike(FEED_TIME)
    day = F.when(has, F.concat_ws("-", g(1), g(2), g(3)).try_cast("date"))
    end = F.when(has & (g(5) != ""), F.concat_ws("-", g(5), g(6), g(7)).try_cast("date"))
    place = F.when(c.contains("地點："), F.trim(F.regexp_extract(c, r"(?s)地點：(.*)$", 1))).otherwise(F.lit(""))
    cut = F.locate(" / ", place)
    venue = F.trim(F.when(cut > 0, F.substring(place, F.lit(1), cut - 1)).otherwise(place))
    address = F.when(cut > 0, F.trim(F.substring(place, cut + 3, F.length(place)))).otherwise(F.lit(""))
    return F.struct(day.alias("day"), F.when(has, g(4)).alias("clock"), end.alias("end_day"), venue.alias("venue"), address.alias("address"))


def bound(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """``keys`` and the given columns, each computed once: no later filter or use is merged into them."""
    return df.select(*keys, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def dated_rows(df: DataFrame, section: Column, keys: list[str]) -> DataFrame:
    """win_11: one row (keys, pos from 1, head, rest) per date of ``section``; rest ends at the next date."""
    mark = "\u0001"
    marked = F.regexp_replace(F.replace(section, F.lit(mark), F.lit(" ")), V.BARE_DATE, mark + "$0" + mark)
    parts = F.split(marked, mark)
    # Odd parts are dates, each with the part after it.
    pairs = F.transform(F.sequence(F.lit(1), F.size("_parts") - 1, F.lit(2)), lambda i: F.struct(F.get("_parts", i).alias("head"), F.get("_parts", i + 1).alias("rest")))
    cut = bound(df, keys, _parts=parts).where(F.size("_parts") > 1)
    return cut.select(*keys, F.posexplode(pairs).alias("pos", "_pair")).select(*keys, (F.col("pos") + 1).alias("pos"), "_pair.head", "_pair.rest")


def text_sessions(df: DataFrame, content: Column, keys: list[str]) -> DataFrame:
    """ext_06: one row (keys, pos, date, time, valid) per date of a text that lists several.

    Only the part under the date label counts. A date may carry notes in brackets, which are no clocks
    of its own, a door clock and a start clock; the start is the clock called so, else the first clock
    that is not called the doors'. Without a clock the time is null. Rows are exploded before the
    clocks are read, so that each piece is read once, in generated code.
    """
    labelled = F.split(F.replace(content, F.lit("："), F.lit(":")), V.DATES_LABEL, 2)
    section = F.get(F.split(F.get(labelled, F.lit(1)), V.DATES_END, 2), F.lit(0))
    keys_pos = [*keys, "pos"]
    rows = bound(
        dated_rows(df, section, keys), keys_pos, date=F.substring_index(F.regexp_replace("head", r"\D+", "-"), "-", 3).try_cast("date"),
        rest=F.when(F.col("rest").contains(":"), F.regexp_replace("rest", r"[（(][^)）]*[)）]", " ")).otherwise(F.lit("")),
    )
    clocks = bound(rows, [*keys_pos, "date", "rest"], start=F.when(F.col("rest").contains("開演"), F.regexp_extract("rest", V.START_CLOCK, 1)).otherwise(F.lit("")))
    found = bound(clocks, [*keys_pos, "date"], clock=F.when(F.col("start") != "", F.col("start")).otherwise(F.regexp_extract("rest", V.PLAIN_CLOCK, 1)))
    time = F.lpad(F.nullif("clock", F.lit("")), 5, "0")
    return found.select(*keys_pos, "date", time.alias("time"), (F.col("date").isNotNull() & F.coalesce(D.valid_clock(time), F.lit(True))).alias("valid"))


def labelled_field(content: Column, label: str, stop: str, limit: int = 160) -> Column:
    """ext_07: text after a label up to the next label; NULL when the label is absent."""
    pattern = rf"(?s){label}\s*[:：]\s*(.*?)(?:{stop}|$)"
    return F.when(content.rlike(pattern), T.cap(T.clean(F.regexp_extract(content, pattern, 1)), limit))


POINT = r"(\d{4})\.(\d{2})\.(\d{2})\s*(\d{2}:\d{2})?"


def dotted_points(text: Column) -> Column:
    """Points struct(date, time) of a dotted date text, in order."""
    hits = F.regexp_extract_all(text, F.lit("(?:" + POINT + ")"), F.lit(0))

    def one(h):
        g = lambda i: F.regexp_extract(h, POINT, i)
        clock = F.when(g(4) != "", g(4))
        return F.struct(F.concat_ws("-", g(1), g(2), g(3)).try_cast("date").alias("date"), clock.alias("time"))

    return F.transform(hits, one)
