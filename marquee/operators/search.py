"""Listing and session search: views, regions, facets, ordering, paging (flt_*, srt_*, agg_11 to agg_13)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import values as V
from marquee.functions.dates import covers

FAR_DAY = "9999-12-31"


def ended(end: Column, today: Column) -> Column:
    return F.coalesce(end < today, F.lit(False))


def view_predicate(view: str, today: Column, start="start_day", end="end_day", first_seen="first_seen",
                   missing="missing", note="note") -> Column:
    """flt_01: membership of a view. Unknown dates never count as known ones."""
    s, e = F.col(start), F.col(end)
    if view == "history":
        return ended(e, today)
    current = ~ended(e, today)
    known = s.isNotNull() & e.isNotNull()
    if view == "new":
        return current & F.coalesce(F.col(first_seen).cast("date") == today, F.lit(False))
    if view == "ending":
        return current & known & (s <= today) & (F.datediff(e, today) <= 14)
    if view == "recommended":
        clear = ~F.coalesce(F.col(missing), F.lit(False)) & (F.coalesce(F.length(F.col(note)), F.lit(0)) == 0)
        return current & known & (F.datediff(s, today) <= 30) & clear
    return current


def region_predicate(region: str | None, groups: dict[str, list[str]], column: str = "region") -> Column:
    """flt_03: one region or a named group of regions; empty selects all."""
    if not region:
        return F.lit(True)
    return F.col(column).isin(*groups.get(region, [region]))


def region_rank(column: str, first: list[str]) -> Column:
    """fn_20: position in the preferred list, all others equal and last."""
    out = F.lit(len(first))
    for i, name in reversed(list(enumerate(first))):
        out = F.when(F.col(column) == name, F.lit(i)).otherwise(out)
    return out


def contains_text(query: str, *columns: str) -> Column:
    """flt_05: case-insensitive substring of the joined columns."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.lower(joined).contains(query.strip().lower())


def order_for(view: str, first_regions: list[str], start="start_day", end="end_day", title="title",
              region="region", id_col="id", collation: str | None = None) -> list[Column]:
    """srt_01: ordering of a view; unknown dates sort last, the id breaks ties."""
    rank = region_rank(region, first_regions)
    far = F.lit(FAR_DAY).cast("date")
    label = F.col(title) if collation is None else F.collate(F.col(title), collation)
    if view == "history":
        return [F.col(end).desc(), F.col(id_col)]
    if view == "ending":
        return [F.coalesce(F.col(end), far), rank, F.col(id_col)]
    return [rank, F.coalesce(F.col(start), far), label, F.col(id_col)]


def page(df: DataFrame, order: list[Column], pages: int = 1, size: int = V.PAGE_SIZE) -> DataFrame:
    """srt_02: the first pages of a result; planned as a distributed top-k."""
    return df.orderBy(*order).limit(pages * size)


@dataclass(frozen=True)
class Filter:
    """A listing query; empty fields do not restrict."""

    view: str = "all"
    region: str = ""
    venue: str = ""
    day: str = ""
    text: str = ""
    groups: dict[str, list[str]] = field(default_factory=dict)
    text_columns: tuple[str, ...] = ("title", "venue")


def search(df: DataFrame, f: Filter, today: Column) -> DataFrame:
    """Entry C for listings: conjunctive filter, cheap column predicates only."""
    cond = region_predicate(f.region, f.groups) & view_predicate(f.view, today)
    if f.venue:
        cond = cond & (F.col("venue") == f.venue)
    if f.day:
        cond = cond & covers(F.col("start_day"), F.col("end_day"), F.lit(f.day).cast("date"))
    if f.text:
        cond = cond & contains_text(f.text, *f.text_columns)
    return df.where(cond)


def clear_incompatible(df: DataFrame, f: Filter) -> tuple[Filter, bool]:
    """flt_13: a chosen venue that the chosen region lacks is dropped and reported."""
    if not f.venue:
        return f, False
    available = not df.where(region_predicate(f.region, f.groups) & (F.col("venue") == f.venue)).isEmpty()
    if available:
        return f, False
    return Filter(**{**f.__dict__, "venue": ""}), True


def facets(df: DataFrame, predicates: dict[str, Column], relax: dict[str, list[str]] | None = None) -> DataFrame:
    """agg_12: values of every facet with its own predicate left out, in one scan.

    ``relax`` names further predicates a facet ignores (the region also ignores the venue).
    Counts are combined map-side on (facet, value).
    """
    relax = relax or {}
    entries = []
    for facet in predicates:
        cond = F.lit(True)
        for other, p in predicates.items():
            if other != facet and other not in relax.get(facet, []):
                cond = cond & F.coalesce(p, F.lit(False))
        value = F.struct(F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("value"))
        entries.append(F.when(cond, value))
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("x")).select("x.*")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def session_platforms(sessions: DataFrame, tickets: DataFrame, keys=("event", "day", "clock")) -> DataFrame:
    """agg_13: one row per session and covering platform, or the 'unverified' bucket."""
    from marquee.operators.tickets import join_sessions

    t = tickets.select(*keys, F.col("platform").alias("_platform")).distinct()
    joined = join_sessions(sessions.drop("platform"), t, "left", keys)
    return joined.withColumn("platform", F.coalesce("_platform", F.lit(V.UNVERIFIED_PLATFORM))).drop("_platform")


def headline(df: DataFrame, today: Column) -> DataFrame:
    """agg_11: active and new counts."""
    return df.agg(
        F.count_if(~ended(F.col("end_day"), today) & (F.coalesce(F.length("note"), F.lit(0)) == 0)).alias("active"),
        F.count_if(view_predicate("new", today)).alias("new_today"),
        F.count("*").alias("events"),
    )


def active_count(df: DataFrame, today: Column, keys: list[str] | None = None) -> DataFrame:
    """agg_10: end on or after the day and not missing."""
    active = (F.col("end_day") >= today) & ~F.coalesce(F.col("missing"), F.lit(False))
    return df.groupBy(*(keys or [])).agg(F.count_if(active).alias("active"))


def genre_rank(column: Column, order: list[str] | None = None) -> Column:
    """srt_04: position in a custom order; unknown values last."""
    listed = F.array(*[F.lit(g) for g in (order or V.GENRE_ORDER)])
    at = F.array_position(listed, column)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(99))


def future_weekends(df: DataFrame, end: Column, now: Column) -> DataFrame:
    """flt_09: weekends whose last second is not past."""
    last_second = end.cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return df.where(last_second >= now)


def next_item(df: DataFrame, order: Column, today: Column) -> DataFrame:
    """win_13: the next upcoming row as a single aggregate."""
    cols = df.columns
    return df.where(order >= today).agg(F.min_by(F.struct(*cols), F.struct(order, *[F.col(c) for c in cols])).alias("_r")).select("_r.*")


def first_session(sessions: DataFrame) -> DataFrame:
    """win_12: earliest matching session per event, the sort key of a result."""
    return sessions.groupBy("event").agg(F.min(F.struct("day", F.coalesce("clock", F.lit("")).alias("clock"))).alias("s")).select(
        "event", F.col("s.day").alias("day"), F.col("s.clock").alias("clock")
    )


@dataclass(frozen=True)
class LiveFilter:
    """A query for live events; empty fields do not restrict. Platform and day hold for one session together."""

    region: str = ""
    venue: str = ""
    genre: str = ""
    platform: str = ""
    day: str = ""
    text: str = ""
    groups: dict[str, list[str]] = field(default_factory=dict)
    text_columns: tuple[str, ...] = ("title", "venue")


def live_sessions(events: DataFrame, sessions: DataFrame, tickets: DataFrame, today: Column) -> DataFrame:
    """Coming, not cancelled sessions of events that stand, a row per covering platform or the unverified bucket.

    events: id, region, venue, genre, title, cancelled; sessions and tickets: event, day, clock.
    """
    open_events = events.where(~F.coalesce("cancelled", F.lit(False))).drop("cancelled")
    coming = sessions.where((F.col("day") >= today) & ~F.coalesce("cancelled", F.lit(False))).select("event", "day", "clock").distinct()
    return session_platforms(coming, tickets).join(open_events, F.col("event") == F.col("id"))


def _live_predicates(f: LiveFilter) -> dict[str, Column]:
    equal = lambda c, v: F.col(c) == v if v else F.lit(True)
    return {
        "region": region_predicate(f.region, f.groups), "venue": equal("venue", f.venue), "genre": equal("genre", f.genre), "platform": equal("platform", f.platform),
        "": (F.col("day") == F.lit(f.day).cast("date") if f.day else F.lit(True)) & (contains_text(f.text, *f.text_columns) if f.text else F.lit(True)),
    }


def search_live(rows: DataFrame, f: LiveFilter) -> DataFrame:
    """Events with a session of ``live_sessions`` that meets the whole filter: id, first such day and clock, how many.

    The first session is the sort key of the result; ``ranking.positions`` or a top-k page orders it.
    """
    cond = F.lit(True)
    for p in _live_predicates(f).values():
        cond = cond & p
    hits = rows.where(cond).select("id", "day", "clock").distinct()
    first = F.min(F.struct("day", F.coalesce("clock", F.lit("")).alias("clock")))
    return hits.groupBy("id").agg(first.alias("s"), F.count("*").alias("sessions")).select("id", F.col("s.day").alias("day"), F.col("s.clock").alias("clock"), "sessions")


def live_facets(rows: DataFrame, f: LiveFilter) -> DataFrame:
    """Values of region, venue, genre and platform with the number of events each would give.

    Every facet leaves out its own condition (the region also the venue's); all others hold for the
    same session, so each offered value returns at least one event.
    """
    predicates = _live_predicates(f)
    rest = predicates.pop("")
    entries = []
    for facet in predicates:
        cond = rest
        for other, p in predicates.items():
            if other != facet and not (facet == "region" and other == "venue"):
                cond = cond & p
        entries.append(F.when(cond, F.struct(F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("value"))))
    found = rows.select("id", F.explode(F.array_compact(F.array(*entries))).alias("x")).select("id", "x.*").distinct()
    return found.groupBy("facet", "value").agg(F.count("*").alias("n"))
