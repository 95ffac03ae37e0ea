"""Status machine of live events as an associative fold (inc_02).

A listing of an event on a day has a fact (its sessions), the last day of its sessions and the status
that the crawl reports. Each step is a function on the five states:

* a listing reported as cancelled or rescheduled takes that state;
* any other listing with a changed fact becomes ``changed``; ``changed`` and ``rescheduled`` stay while
  the fact stays; all other states go back to ``scheduled``;
* a day without a listing makes an event with a session ahead ``unconfirmed``, but never a cancelled one.

Functions on states compose, so the history of a segment of days is summed up by its first and last
listing and one function (its value for each of the five states). Segments combine in any grouping: days
to blocks of days, blocks to the history. A key with a long history is folded block by block in
different tasks and only the sums meet.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

STATES = ["scheduled", "changed", "rescheduled", "unconfirmed", "cancelled"]
SCHEDULED, CHANGED, RESCHEDULED, UNCONFIRMED, CANCELLED = range(5)
SEGMENT = (
    "struct<first_day:date,first_fact:string,first_crawl:int,last_day:date,last_fact:string,open_until:date,then:array<int>>"
)
#: Days of a block of the first fold.
BLOCK_DAYS = 32


def next_state(state: int | None, moved: bool, crawl: int) -> int:
    """State after a listing; ``state`` is None before the first one."""
    if state is None or crawl in (CANCELLED, RESCHEDULED):
        return crawl
    if moved:
        return CHANGED
    return state if state in (CHANGED, RESCHEDULED) else SCHEDULED


def unlisted_state(state: int, ahead: bool) -> int:
    return UNCONFIRMED if ahead and state != CANCELLED else state


def sequential(listings: list[tuple], last_day: datetime.date) -> tuple[int, int]:
    """(state after the last listing, state on ``last_day``) of listings (day, fact, open_until, crawl) in order."""
    state, before = None, None
    for day, fact, open_until, crawl in listings:
        if before is not None and (day - before[0]).days > 1:
            state = unlisted_state(state, before[2] > before[0])
        state = next_state(state, before is not None and before[1] != fact, crawl)
        before = (day, fact, open_until)
    return state, unlisted_state(state, before[0] < last_day and before[2] > before[0])


def _ints(values: list[Column]) -> Column:
    return F.array(*[v.cast("int") for v in values])


def _step(moved: Column, crawl: Column, gap: Column) -> Column:
    """The function of a listing after a possible gap: its value for each of the five states."""
    out = []
    for s in range(5):
        stays = F.lit(s in (CHANGED, RESCHEDULED)) & ~gap
        rest = F.when(moved, CHANGED).when(stays, s).otherwise(SCHEDULED)
        out.append(F.when(crawl.isin(CANCELLED, RESCHEDULED), crawl).otherwise(rest))
    return _ints(out)


def _combined(a: Column, b: Column) -> Column:
    """Sum of two neighbouring segments."""
    # Unlisted on the day after the last listing, with a session on or after that day.
    gap = (F.datediff(b["first_day"], a["last_day"]) > 1) & (a["open_until"] > a["last_day"])
    step = _step(~a["last_fact"].eqNullSafe(b["first_fact"]), b["first_crawl"], gap)
    then = F.transform(a["then"], lambda x: F.get(b["then"], F.get(step, x)))
    return F.struct(
        a["first_day"].alias("first_day"), a["first_fact"].alias("first_fact"), a["first_crawl"].alias("first_crawl"),
        b["last_day"].alias("last_day"), b["last_fact"].alias("last_fact"), b["open_until"].alias("open_until"), then.alias("then"),
    ).cast(SEGMENT)


def _folded(parts: Column) -> Column:
    """Sum of an array of segments in order."""
    return F.reduce(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1).cast(SEGMENT), _combined)


def segments(listings: DataFrame, key: str, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, block, segment): the sum of every block of days.

    ``listings``: key, day, fact, open_until, crawl (a number of STATES); one row for a key and day. An
    ``open_until`` of null means that no session is ahead.
    """
    same = F.array(*[F.lit(s) for s in range(5)])
    one = F.struct(
        F.col("day").alias("first_day"), F.col("fact").cast("string").alias("first_fact"), F.col("crawl").cast("int").alias("first_crawl"),
        F.col("day").alias("last_day"), F.col("fact").cast("string").alias("last_fact"), F.coalesce("open_until", "day").alias("open_until"), same.alias("then"),
    ).cast(SEGMENT)
    block = F.floor(F.unix_date("day") / block_days).alias("block")
    # At most ``block_days`` listings meet.
    grouped = listings.select(key, block, one.alias("s")).groupBy(key, "block").agg(F.array_sort(F.collect_list("s")).alias("parts"))
    return grouped.select(key, "block", _folded(F.col("parts")).alias("segment"))


def added(state: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Stored sums (key, segment) with the sums of later days; what was folded is not read again."""
    both = state.select(key, F.lit(0).cast("bigint").alias("block"), "segment").unionByName(more.select(key, (F.col("block") + F.lit(1 << 40)).alias("block"), "segment"))
    return history(both, key)


def history(blocks: DataFrame, key: str) -> DataFrame:
    """(key, segment): the blocks of each key combined in order."""
    grouped = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "segment"))).alias("parts"))
    return grouped.select(key, _folded(F.transform("parts", lambda p: p["segment"])).alias("segment"))


def final_status(state: DataFrame, key: str, last_day: Column) -> DataFrame:
    """(key, last_day, listed_status, final_status) of summed-up histories.

    The first listing has no state before it and takes the one that the crawl reports.
    """
    names = F.array(*[F.lit(s) for s in STATES])
    listed = F.get(F.col("segment.then"), F.col("segment.first_crawl"))
    ahead = (F.col("segment.last_day") < last_day) & (F.col("segment.open_until") > F.col("segment.last_day"))
    rows = state.select(key, F.col("segment.last_day").alias("last_day"), listed.alias("_s"), ahead.alias("_a"))
    final = F.when(F.col("_a") & (F.col("_s") != CANCELLED), UNCONFIRMED).otherwise(F.col("_s"))
    return rows.select(key, "last_day", F.get(names, F.col("_s")).alias("listed_status"), F.get(names, final).alias("final_status"))
