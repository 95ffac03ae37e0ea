"""Sessions and ticket scopes (joi_06, joi_18, agg_06, flt_06, flt_07, win_02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import dates as D, text as T, urls as U, values as V
from marquee.operators.ranking import first_per_key


SESSION_KEY = ("event", "day", "clock")


def join_sessions(left: DataFrame, right: DataFrame, how: str, keys: tuple[str, ...] = SESSION_KEY) -> DataFrame:
    """Join on the session key. The last key is null-safe: a NULL clock equals a NULL clock.

    The right keys are renamed first, so both sides may come from one table.
    """
    r = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    cond = F.col(keys[-1]).eqNullSafe(F.col("_r_" + keys[-1]))
    for k in keys[:-1]:
        cond = cond & (F.col(k) == F.col("_r_" + k))
    return left.join(r, cond, how).drop(*["_r_" + k for k in keys])


def covered_sessions(sessions: DataFrame, scopes: DataFrame) -> DataFrame:
    """joi_06: sessions within some ticket scope."""
    return join_sessions(sessions, scopes.select(*SESSION_KEY), "left_semi")


def uncovered_sessions(sessions: DataFrame, scopes: DataFrame) -> DataFrame:
    """flt_07: sessions no ticket covers."""
    return join_sessions(sessions, scopes.select(*SESSION_KEY), "left_anti")


def merge_tickets(tickets: DataFrame, sessions: DataFrame) -> DataFrame:
    """agg_06 in long form: ticket rows (event, url, price, sale_at, day, clock, ord, ...) reduced to
    one row per (event, url, price, sale_at) and valid distinct session; empty scopes vanish."""
    valid = sessions.select("event", "day", "clock").distinct()
    scoped = join_sessions(tickets, valid, "left_semi")
    return scoped.groupBy("event", "url", "price", "sale_at", "day", "clock").agg(F.min("ord").alias("ord"))


def normalize_nested(df: DataFrame) -> DataFrame:
    """agg_06 on nested columns: tickets array of an event document, no shuffle.

    Keeps checked tickets with a detail URL and a known or given platform, cuts each scope to the
    event's sessions, merges equal (url, price, saleAt), drops empty scopes.
    """
    key = lambda t: F.struct(t["url"].alias("url"), t["price"].alias("price"), t["saleAt"].alias("saleAt"))
    plain = F.transform("sessions", lambda s: F.struct(s["date"].alias("date"), s["time"].alias("time")))
    scoped = F.transform(
        F.col("tickets"),
        lambda t: F.struct(
            F.coalesce(U.platform_of(t["url"]), T.clean(t["platform"])).alias("platform"),
            t["url"].alias("url"), t["checkedAt"].alias("checkedAt"),
            F.array_distinct(
                F.filter(
                    F.transform(t["sessions"], lambda s: F.struct(s["date"].alias("date"), s["time"].alias("time"))),
                    lambda s: F.array_contains(F.col("_valid"), s),
                )
            ).alias("sessions"),
            t["price"].alias("price"), t["saleAt"].alias("saleAt"),
        ),
    )
    usable = F.filter(
        F.col("_scoped"),
        lambda t: U.is_detail(t["url"]) & (F.length(t["platform"]) > 0)
        & D.strict_date(t["checkedAt"]).isNotNull() & (F.size(t["sessions"]) > 0),
    )
    merged = F.transform(
        F.array_distinct(F.transform(F.col("_usable"), key)),
        lambda k: F.struct(
            F.get(F.filter(F.col("_usable"), lambda t: key(t) == k), F.lit(0)).alias("t"),
            F.array_distinct(
                F.flatten(F.transform(F.filter(F.col("_usable"), lambda t: key(t) == k), lambda t: t["sessions"]))
            ).alias("s"),
        ),
    )
    out = F.transform(
        F.col("_merged"),
        lambda m: F.struct(
            m["t"]["platform"].alias("platform"), m["t"]["url"].alias("url"), m["t"]["checkedAt"].alias("checkedAt"),
            m["s"].alias("sessions"), m["t"]["price"].alias("price"), m["t"]["saleAt"].alias("saleAt"),
        ),
    )
    return (
        df.withColumn("_valid", plain).withColumn("_scoped", scoped).withColumn("_usable", usable)
        .withColumn("_merged", merged).withColumn("tickets", out)
        .drop("_valid", "_scoped", "_usable", "_merged")
    )


def first_ticket_per_url(tickets: DataFrame, order: Column) -> DataFrame:
    """win_02: the first ticket of each URL within an event."""
    return first_per_key(tickets, ["event", "url"], order)


def with_session_facts(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """joi_18: per-session performers and host."""
    return join_sessions(sessions, facts.select(*SESSION_KEY, "performers", "host"), "left")


def matching_sessions(sessions: DataFrame, today: Column, view: str = "upcoming", day: str | None = None,
                      platform: str | None = None, tickets: DataFrame | None = None) -> DataFrame:
    """flt_06: every condition must hold for the same session.

    ``sessions`` has event, day, clock, cancelled; ``tickets`` has event, day, clock, platform.
    """
    out = sessions
    if day is not None:
        out = out.where(F.col("day") == F.lit(day).cast("date"))
    if view != "all":
        out = out.where(~F.col("cancelled") & (F.col("day") >= today))
    if platform == V.UNVERIFIED_PLATFORM:
        out = uncovered_sessions(out, tickets)
    elif platform:
        out = covered_sessions(out, tickets.where(F.col("platform") == platform))
    return out


def upcoming(sessions: DataFrame, today: Column) -> DataFrame:
    """flt_08: sessions from today on."""
    return sessions.where(F.col("day") >= today)
