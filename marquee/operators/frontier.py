"""Page frontier: discovery, fair queues, daily budgets, failure rotation (joi_13, win_03 to win_07, inc_04, inc_05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.functions import values as V
from marquee.operators.ranking import positions


def new_urls(listed: DataFrame, known: DataFrame, pending: DataFrame, key: str = "url") -> DataFrame:
    """joi_13: listed URLs neither read before nor already queued."""
    return listed.join(known.select(key), key, "left_anti").join(pending.select(key), key, "left_anti")


def interleave(queue: DataFrame, source: str, is_backlog: Column, order: list[Column]) -> DataFrame:
    """win_03: whole queue in round-robin order, new discoveries first, for sources of any size.

    ``turn`` orders each source's queue: new items take the odd turns, backlog the even ones.
    """
    numbered = positions(queue.withColumn("backlog", is_backlog), [source, "backlog"], order, "rn")
    return numbered.withColumn("turn", F.col("rn") * 2 - F.when(F.col("backlog"), 0).otherwise(1))


def used_budget(attempts: DataFrame, reserved: DataFrame, source: str, day: str, today: Column) -> DataFrame:
    """Attempts of the day plus the reserved amount, per source."""
    tried = attempts.where(F.col(day) == today).groupBy(source).agg(F.count("*").alias("used"))
    both = tried.unionByName(reserved.select(source, F.col("reserved").alias("used")))
    return both.groupBy(source).agg(F.sum("used").alias("used"))


def plan_reads(queue: DataFrame, used: DataFrame, source: str, order: list[Column], cap: int = V.DAILY_PAGE_BUDGET) -> DataFrame:
    """win_04: the next reads of each source within what is left of its daily budget.

    The literal ``rn <= cap`` is a group limit, applied before the shuffle, so at most ``cap``
    rows per source and task move.
    """
    w = Window.partitionBy(source).orderBy(*order)
    head = queue.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    left = used.select(source, "used")
    return (
        head.join(left, source, "left")
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(cap) - F.coalesce("used", F.lit(0))))
        .where(F.col("rn") <= F.col("remaining"))
        .drop("used", "remaining")
    )


def fair_head(queue: DataFrame, source: str, is_backlog: Column, order: list[Column], cap: int = V.DAILY_PAGE_BUDGET) -> DataFrame:
    """The first ``cap`` turns of each source's interleaved queue; needs only ``cap`` rows per class."""
    q = queue.withColumn("backlog", is_backlog)
    w = Window.partitionBy(source, "backlog").orderBy(*order)
    head = q.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    return head.withColumn("turn", F.col("rn") * 2 - F.when(F.col("backlog"), 0).otherwise(1)).drop("rn")


def run_day(state: DataFrame, listed: DataFrame, outcome_ok: Column, today: str, cap: int = V.DAILY_PAGE_BUDGET,
            source: str = "source", budgets: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """inc_04: one day of a frontier, from the old state and the day's listing to the new state.

    State columns: source, url, status (known, pending), queue_key (string, orders the backlog),
    last_attempt (date). Each URL is attempted at most once a day; failures go behind the backlog
    and are tried on a later day; known URLs are never read again. ``budgets`` lists the sources whose
    state already counts a day's reads: an older state can't tell what it read today, so a source with
    known pages that is missing there gets no reads on this day. ``key``: the columns that name a page,
    in the state and in the listing; without it a page is its source and URL.
    """
    day = F.lit(today).cast("date")
    key = key or [source, "url"]
    cols = [source, "url", *[k for k in key if k not in (source, "url")]]
    listed = listed.select(*cols).distinct()  # a page listed twice is one page
    kept = state.join(listed.select(*key), key, "left_semi")
    # A known URL stays known when the listing drops it; a dropped pending URL leaves the queue.
    known = state.where("status = 'known'")
    backlog = kept.where("status = 'pending'")
    fresh = listed.join(state.select(*key), key, "left_anti").select(*cols)
    queue = backlog.unionByName(
        fresh.select(
            *cols, F.lit("pending").alias("status"), F.col("url").alias("queue_key"),
            F.lit(None).cast("date").alias("last_attempt"),
        )
    )
    none = state.select(source, F.lit(0).cast("bigint").alias("reserved")).where("false")
    reserved = none
    if budgets is not None:
        reserved = known.select(source).distinct().join(budgets.select(source), source, "left_anti").select(source, F.lit(cap).cast("bigint").alias("reserved"))
    used = used_budget(state, reserved, source, "last_attempt", day)
    due = queue.where(F.col("last_attempt").isNull() | (F.col("last_attempt") < day))
    is_old = F.col("last_attempt").isNotNull() | (F.col("queue_key") != F.col("url"))
    turns = fair_head(due, source, is_old, [F.col("queue_key"), F.col("url")], cap)
    reads = plan_reads(turns, used, source, [F.col("turn")], cap).select(*key, F.lit(True).alias("_read"))
    marked = queue.join(reads, key, "left")
    was_read = F.coalesce(F.col("_read"), F.lit(False))
    ok = was_read & outcome_ok
    failed = was_read & ~outcome_ok
    updated = marked.select(
        *cols,
        F.when(ok, F.lit("known")).otherwise(F.col("status")).alias("status"),
        F.when(failed, F.concat(F.lit("~"), F.lit(today), F.lit("|"), F.col("url")))
        .when(was_read | (F.col("queue_key") != F.col("url")), F.col("queue_key"))
        .otherwise(F.concat(F.lit("+"), F.lit(today), F.lit("|"), F.col("url")))
        .alias("queue_key"),
        F.when(was_read, day).otherwise(F.col("last_attempt")).alias("last_attempt"),
    )
    return known.unionByName(updated)


def rotation(candidates: DataFrame, last_attempt: str, key: str, limit: int = V.RECHECK_LIMIT) -> DataFrame:
    """win_05: least recently attempted first, then key; a top-k, not a sort of everything."""
    return candidates.orderBy(F.col(last_attempt).asc_nulls_first(), F.col(key)).limit(limit)


def until_first_failure(df: DataFrame, batch: str, order: Column, failed: Column) -> DataFrame:
    """win_06: rows of each batch up to and including its first failure.

    The first failure is a map-side aggregate joined back, so a hot batch is never one window.
    """
    d = df.withColumn("_o", order).withColumn("_fail", failed)
    stop = d.groupBy(batch).agg(F.min(F.when(F.col("_fail"), F.col("_o"))).alias("_stop"))
    return d.join(stop, batch).where(F.col("_stop").isNull() | (F.col("_o") <= F.col("_stop"))).drop("_o", "_fail", "_stop")


def flush_completed(previous: DataFrame, completed: DataFrame, key: str = "url") -> DataFrame:
    """inc_05: buffered facts of finished pages replace or join the stored ones."""
    return previous.join(completed.select(key), key, "left_anti").unionByName(completed, allowMissingColumns=True)
