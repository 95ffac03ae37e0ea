"""Source adapters as data: what a source's pages hold where, and how their facts are put together (ext_03).

Two tables describe a source. ``sources`` has a row for each: source, name, region, address and ``dates``,
the way its dates are written (one of DATE_FORMS). ``rules`` has a row for each field: source, field and
pattern, a regular expression whose first group is the value. A page is joined with its source's rules as
one array, so it stays one row and its text isn't copied, and a new source needs rows, not code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import text as T, values as V

#: ``iso``: whole dates, field "date". ``year_day``: fields "year" and "day" (month.day), first and last of
#: each. ``edges``: fields "start_year", "start_day", "end_year", "end_day"; an edge counts if it is whole.
DATE_FORMS = ["iso", "year_day", "edges"]
FIELDS = "map<string,array<string>>"


def registry(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per source: its registry columns and ``rules`` array<struct<field, pattern>>."""
    own = rules.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("field", "pattern"))).alias("rules"))
    return sources.join(own, "source", "left")


def fields(pages: DataFrame, adapters: DataFrame, html: str = "html") -> DataFrame:
    """Pages with the registry columns of their source and ``fields``: every value that each rule finds.

    Pages of a source without rules are left out; nobody says how to read them.
    """
    found = F.transform("rules", lambda r: F.struct(
        r["field"], F.filter(F.transform(F.regexp_extract_all(F.col(html), r["pattern"], F.lit(1)), lambda v: T.clean(v)), lambda v: v != "")
    ))
    joined = pages.join(adapters.where("rules IS NOT NULL"), "source")
    return joined.withColumn("fields", F.map_from_entries(found)).drop("rules")


def _all(name: str) -> Column:
    return F.coalesce(F.col("fields")[name], F.array().cast("array<string>"))


def _first(name: str) -> Column:
    return F.get(_all(name), F.lit(0))


def _last(name: str) -> Column:
    return F.element_at(F.when(F.size(_all(name)) > 0, _all(name)), -1)


def _edge(year: str, day: str) -> Column:
    return F.when(_first(year).isNotNull() & _first(day).isNotNull(), F.concat_ws(".", _first(year), _first(day)))


def dates_of() -> Column:
    """The page's dates as written, in the form that the source's registry row names."""
    days = _all("day")
    pair = F.array(F.concat_ws(".", _first("year"), _first("day")), F.concat_ws(".", _last("year"), _last("day")))
    by_year = F.when((F.size(_all("year")) > 0) & F.size(days).isin(1, 2), F.slice(pair, F.lit(1), F.size(days)))
    edges = F.array_compact(F.array(_edge("start_year", "start_day"), _edge("end_year", "end_day")))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.col("dates") == "iso", _all("date")).when(F.col("dates") == "year_day", by_year).when(F.col("dates") == "edges", edges), none)


def price_of(badge: Column, prior: Column) -> Column:
    """The list badge decides; else the price of the earlier review, marked as not checked daily."""
    kept = F.when(prior.startswith(V.DETAIL_UNCHECKED), prior).otherwise(F.concat(F.lit(V.DETAIL_LAST_REVIEW), prior))
    known = F.when(badge == "free", V.DETAIL_FREE).when(badge == "paid", V.DETAIL_PAID)
    return F.substring(F.coalesce(known, F.when(F.length(prior) > 0, kept), F.lit(V.DETAIL_UNKNOWN)), 1, 180)


def detail_facts(pages: DataFrame, adapters: DataFrame, html: str = "html") -> DataFrame:
    """Facts of detail pages: title, start, end, venue, price, and ``reason`` where a page gives none.

    ``pages``: source, ``html`` and the hints of earlier steps: venue_hint, badge, prior_price. A page
    without title or venue fails. No date leaves both days open. A single date is a period of one day only
    where whole dates are written and no word says that the end is open; otherwise the end stays unknown.
    """
    f = fields(pages, adapters, html)
    f = f.withColumn("_d", F.transform(dates_of(), lambda d: F.try_to_date(F.replace(d, F.lit("."), F.lit("-")), "y-M-d")))
    title = F.when(F.length(_first("title")) > 0, _first("title"))
    venue = F.coalesce(_first("venue"), F.when(F.length("venue_hint") > 0, F.col("venue_hint")))
    mark = F.concat(F.col("name"), F.lit(" · "))
    bare = F.when(venue.startswith(mark), F.substr(venue, F.length(mark) + 1)).otherwise(venue)
    one = F.size("_d") == 1
    open_end = one & ((F.col("dates") != "iso") | F.coalesce(F.array_join(_all("period"), " ").rlike(V.OPEN_ENDED_PATTERN), F.lit(False)))
    start = F.when(F.size("_d") > 0, F.array_min("_d"))
    failed = title.isNull() | venue.isNull()
    keep = [c for c in pages.columns if c not in (html, "venue_hint", "badge", "prior_price")]
    return f.select(
        *keep, title.alias("title"), start.alias("start"), F.when((F.size("_d") > 0) & ~open_end, F.array_max("_d")).alias("end"),
        F.concat(mark, bare).alias("venue"), "region", "address", price_of(F.col("badge"), F.col("prior_price")).alias("price"),
        F.when(failed, "missing title or venue").when(F.exists("_d", lambda d: d.isNull()), "bad date").alias("reason"),
    )
