"""Snapshot merge, retention, upsert and history (joi_01 to joi_03, win_08 to win_10, inc_*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.functions import values as V

TRACKED = ["title", "start", "end", "price"]


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def merge_listings(previous: DataFrame, incoming: DataFrame, now: str, tracked: list[str] | None = None,
                   fallback: tuple[str, ...] = ("sourceUid", "venue", "address")) -> DataFrame:
    """joi_01 / inc_01: merge a daily batch into retained history.

    Matches on id, then on the fallback key; keeps the first-seen stamp; appends a revision when
    a tracked column changed; flags rows that the batch no longer has. ``previous`` carries
    firstSeen, lastSeen, missingFromSource and revisions.
    """
    merged = matched_rows(previous, incoming, now, tracked, fallback)
    seen = merged.select("id").union(merged.where("_matched IS NOT NULL").select(F.col("_matched").alias("id")))
    gone = previous.join(seen, "id", "left_anti").withColumn("missingFromSource", F.lit(True))
    return merged.drop("_matched").unionByName(gone, allowMissingColumns=True)


def matched_rows(previous: DataFrame, incoming: DataFrame, now: str, tracked: list[str] | None = None,
                 fallback: tuple[str, ...] = ("sourceUid", "venue", "address")) -> DataFrame:
    """The batch's rows with their history, and ``_matched``: the id of the retained row of each.

    Histories are small in files and large in memory, so their joins are merges: a broadcast chosen by the
    size of the files would bring all of them to the driver.
    """
    tracked = tracked or TRACKED
    spark_cols = incoming.columns
    before_cols = ["id", "firstSeen", "lastSeen", "revisions", *tracked]
    before = previous.select(F.struct(*before_cols).alias("_b"), F.col("id").alias("_pid"), *[F.col(c).alias("_f_" + c) for c in fallback])

    by_id = before.select("_b", F.col("_pid").alias("id"))
    step1 = incoming.join(by_id.hint("merge"), "id", "left")
    # The composite key may repeat in old data: the last id wins, as a combined aggregate.
    by_key = (
        before.where(F.length(F.col("_f_" + fallback[0])) > 0)
        .groupBy(*["_f_" + c for c in fallback])
        .agg(F.max_by("_b", "_pid").alias("_b2"))
    )
    condition = F.col("_b").isNull()
    for c in fallback:
        condition = condition & F.col(c).eqNullSafe(F.col("_f_" + c))
    step2 = step1.join(by_key.hint("merge"), condition, "left").withColumn("_b", F.coalesce("_b", "_b2"))

    b = F.col("_b")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | changed(b[c], F.col(c))
    revision = F.struct(*[b[c].alias(c) for c in tracked], b["lastSeen"].alias("lastSeen"))
    history = F.when(b.isNull(), F.slice(F.array(revision), 1, 0)).otherwise(
        F.when(differs, F.concat(b["revisions"], F.array(revision))).otherwise(b["revisions"])
    )
    return step2.select(
        *spark_cols,
        F.coalesce(b["firstSeen"], F.lit(now)).alias("firstSeen"),
        F.lit(now).alias("lastSeen"),
        F.lit(False).alias("missingFromSource"),
        history.alias("revisions"),
        b["id"].alias("_matched"),
    )


def retain_missing(previous: DataFrame, incoming: DataFrame, key: list[str], flag: str = "missing") -> DataFrame:
    """joi_02: incoming rows plus previous rows the batch lacks, flagged."""
    gone = previous.join(incoming.select(*key), key, "left_anti").withColumn(flag, F.lit(True))
    return incoming.withColumn(flag, F.lit(False)).unionByName(gone, allowMissingColumns=True)


def upsert(previous: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """joi_03: replace by key, keep everything else verbatim. Running it twice changes nothing."""
    return previous.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_live(previous: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """inc_02, batch form: status transitions of live events between two snapshots.

    Columns: id, sessions, status, statusNote, revisions. Changed sessions give 'changed' and a
    revision; 'changed' and 'rescheduled' stick while the sessions stay; an unlisted event with a
    session from today on becomes 'unconfirmed' and is never read as cancelled.
    """
    today = F.lit(now[:10]).cast("date")
    old = previous.select(
        "id", F.struct("sessions", "status", "statusNote", "revisions").alias("_b")
    )
    joined = incoming.drop("revisions", "statusNote").join(old, "id", "left")
    b = F.col("_b")
    moved = b.isNotNull() & (b["sessions"] != F.col("sessions"))
    sticky = b.isNotNull() & ~moved & b["status"].isin("rescheduled", "changed")
    revision = F.struct(F.lit(now).alias("at"), F.lit(V.NOTE_CHANGED).alias("note"), b["sessions"].alias("previousSessions"))
    none = F.slice(F.array(revision), 1, 0)
    kept = F.coalesce(b["revisions"], none)
    merged = joined.select(
        *[c for c in incoming.columns if c not in ("revisions", "statusNote", "status")],
        F.when(moved, F.lit("changed")).when(sticky, b["status"]).otherwise(F.col("status")).alias("status"),
        F.when(moved, F.lit(V.NOTE_STATUS_CHANGED)).when(sticky, b["statusNote"]).alias("statusNote"),
        F.when(moved, F.concat(kept, F.array(revision))).otherwise(kept).alias("revisions"),
    )
    open_ended = F.exists("sessions", lambda s: s["date"] >= today)
    gone = previous.join(incoming.select("id"), "id", "left_anti")
    gone = gone.withColumn("statusNote", F.when(open_ended, F.lit(V.NOTE_UNCONFIRMED)).otherwise(F.col("statusNote")))
    gone = gone.withColumn("status", F.when(open_ended, F.lit("unconfirmed")).otherwise(F.col("status")))
    return merged.unionByName(gone, allowMissingColumns=True)


def gated_disappearance(previous: DataFrame, incoming: DataFrame, complete: DataFrame, key: str = "id",
                        source: str = "source") -> DataFrame:
    """inc_08: only a complete scope may mark its unlisted rows unconfirmed; cancelled stays."""
    gone = previous.join(incoming.select(key), key, "left_anti")
    scope = complete.select(source, F.col("complete").alias("_complete"))
    mark = F.coalesce(F.col("_complete"), F.lit(False)) & (F.col("status") != "cancelled")
    gone = gone.join(scope, source, "left").withColumn("status", F.when(mark, F.lit("unconfirmed")).otherwise(F.col("status")))
    return incoming.unionByName(gone.drop("_complete"), allowMissingColumns=True)


def seen_range(df: DataFrame, key: str, day: str) -> DataFrame:
    """win_10: first and last day an entity was listed."""
    return df.groupBy(key).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))


def revisions(daily: DataFrame, key: str, day: str, tracked: list[str]) -> DataFrame:
    """win_08: changes between consecutive snapshots, with the prior values.

    ``daily`` has one row per entity and day, so a window holds at most one row per day.
    """
    w = Window.partitionBy(key).orderBy(day)
    prior = F.lag(F.struct(F.col(day).alias("last_seen"), *tracked)).over(w)
    differs = F.lit(False)
    for c in tracked:
        differs = differs | changed(F.col("_p")[c], F.col(c))
    return (
        daily.withColumn("_p", prior)
        .where(F.col("_p").isNotNull() & differs)
        .select(key, day, *tracked, *[F.col("_p")[c].alias("prior_" + c) for c in tracked], F.col("_p.last_seen").alias("prior_day"))
    )


def status_history(daily: DataFrame, key: str, day: str, fact: str, open_until: Column, last_day: Column) -> DataFrame:
    """inc_02 over a whole history of daily snapshots: status at each listed day and at the end.

    A change sticks until the entity was unlisted while it still had a session ahead
    (``open_until``), which resets the run. One row per entity and day, so windows are bounded
    by the number of days.
    """
    w = Window.partitionBy(key).orderBy(day)
    step = (
        daily.withColumn("_prev_day", F.lag(day).over(w))
        .withColumn("_prev_fact", F.lag(fact).over(w))
        .withColumn("_prev_open", F.lag(open_until).over(w))
        .withColumn("_next_day", F.lead(day).over(w))
    )
    was_gone = F.datediff(F.col(day), F.col("_prev_day")) > 1
    # Unlisted on the day after the previous listing, with a session on or after that day.
    reset = F.coalesce(was_gone & (F.col("_prev_open") >= F.date_add("_prev_day", 1)), F.lit(False))
    moved = F.coalesce(F.col("_prev_day").isNotNull() & changed(F.col("_prev_fact"), F.col(fact)), F.lit(False))
    run = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("_moved", moved.cast("int")).withColumn("_run", F.sum(reset.cast("int")).over(run))
    in_run = Window.partitionBy(key, "_run").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(F.max("_moved").over(in_run) == 1, F.lit("changed")).otherwise(F.lit("scheduled"))
    step = step.withColumn("status", status)
    final = F.when(
        F.col("_next_day").isNull() & (F.col(day) < last_day) & (open_until >= F.date_add(F.col(day), 1)), F.lit("unconfirmed")
    ).when(F.col("_next_day").isNull(), F.col("status"))
    return step.withColumn("final_status", final).drop("_prev_day", "_prev_fact", "_prev_open", "_next_day", "_moved", "_run")
