"""Reviewed facts over crawled facts, curated precedence, fingerprint dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import text as T, urls as U
from marquee.operators.ranking import first_per_key


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """set_01: union by name; ``prio`` keeps the order of the parts (0 first)."""
    out = None
    for i, part in enumerate(parts):
        p = part.withColumn("prio", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def curated_first(provider: DataFrame, curated: DataFrame, id_col: str = "id", uid_col: str = "sourceUid") -> DataFrame:
    """joi_05: drop provider rows whose id or uid is curated, then append the curated rows.

    Two anti joins instead of an OR condition, which would become a nested loop.
    """
    ids = curated.select(id_col)
    uids = curated.where(F.length(F.col(uid_col).cast("string")) > 0).select(uid_col)
    kept = provider.join(ids, id_col, "left_anti").join(uids, uid_col, "left_anti")
    return kept.unionByName(curated, allowMissingColumns=True)


def fingerprint_dedup(df: DataFrame, title: Column, others: list[str], order: Column) -> DataFrame:
    """win_01: one row per (title key, others); the last row in ``order`` wins."""
    return first_per_key(df.withColumn("fp", T.word_key(title)), ["fp", *others], order, last=True)


def review_overrides(df: DataFrame, reviews: DataFrame, fields: list[str]) -> DataFrame:
    """joi_04: reviewed columns replace the row's when the uid and the title agree and the URL is safe.

    A uid has one review, the last by check day and URL. Where reviews name ``sessions`` (array of date,
    time, venue), the ticket covers those of the event's venue only (``ticketSessions``).
    """
    scoped = "sessions" in reviews.columns
    r = first_per_key(reviews, ["uid"], F.struct(*[c for c in ("checkedAt", "url") if c in reviews.columns]), last=True)
    r = r.select(
        F.col("uid").alias("_uid"), F.col("title").alias("_title"), F.col("url").alias("_url"),
        *[F.col(f).alias("_r_" + f) for f in fields], *([F.col("sessions").alias("_s")] if scoped else []),
    ).where(U.is_safe(F.col("_url"), ("https",)))
    hit = (F.col("sourceUid") == F.col("_uid")) & (F.col("title") == F.col("_title"))
    joined = df.join(r, hit, "left")
    changes = {f: F.coalesce(F.col("_r_" + f), F.col(f)) for f in fields if f in df.columns}
    if scoped:
        own = F.filter("_s", lambda s: s["venue"] == F.col("venue"))
        changes["ticketSessions"] = F.transform(own, lambda s: F.struct(s["date"].alias("date"), s["time"].alias("time")))
    return joined.withColumn("reviewed", F.col("_url").isNotNull()).withColumns(changes).drop(
        "_uid", "_title", "_url", *["_r_" + f for f in fields], *(["_s"] if scoped else [])
    )


def recheck_candidates(candidates: DataFrame, current: DataFrame, verified: DataFrame) -> DataFrame:
    """joi_14: link candidates (uid, title) of events that are listed now under the same title and not verified yet.

    ``current``: sourceUid, title, missing.
    """
    listed = current.where(~F.coalesce("missing", F.lit(False))).select(F.col("sourceUid").alias("uid"), "title")
    return candidates.join(listed, ["uid", "title"], "left_semi").join(verified.select("uid"), "uid", "left_anti")


def overlay_matches(previous: DataFrame, raw: DataFrame) -> DataFrame:
    """joi_09: previous record of each crawled record.

    By id first; else the only previous record with the same title key and a shared date; else
    none. Columns: id, title_key, dates (array). Output: raw id, previous id, how.
    """
    by_id = raw.join(previous.select(F.col("id")), "id", "left_semi").select(
        F.col("id").alias("raw_id"), F.col("id").alias("prev_id"), F.lit("id").alias("how")
    )
    rest = raw.join(previous.select("id"), "id", "left_anti")
    days = lambda d: d.select("id", "title_key", F.explode("dates").alias("day"))
    # The previous side is one row per (title, day) before the join, so a popular title stays linear.
    held = days(previous).groupBy("title_key", "day").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    fallback = (
        days(rest).withColumnRenamed("id", "raw_id").join(held, ["title_key", "day"])
        .groupBy("raw_id")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where("lo = hi")
        .select("raw_id", F.col("lo").alias("prev_id"), F.lit("title_day").alias("how"))
    )
    found = by_id.unionByName(fallback)
    new = raw.select(F.col("id").alias("raw_id")).join(found, "raw_id", "left_anti")
    return found.unionByName(
        new.select("raw_id", F.lit(None).cast(raw.schema["id"].dataType).alias("prev_id"), F.lit("new").alias("how"))
    )


def reviewed_overlay(reviewed: DataFrame, crawled: DataFrame, key: str, crawler_owned: list[str], reviewed_owned: list[str]) -> DataFrame:
    """inc_03: crawler-owned columns are replaced, reviewed columns are kept unless empty, new records enter.

    A sale time filled from the crawl brings the crawl's note along.
    """
    c = crawled.select(key, F.lit(True).alias("_c_hit"), *[F.col(x).alias("_c_" + x) for x in crawled.columns if x != key])
    joined = reviewed.withColumn("_r_hit", F.lit(True)).join(c, key, "full")
    empty = lambda x: F.coalesce(F.length(F.col(x).cast("string")) == 0, F.lit(True))
    # A crawled NULL clears what the crawl owns; only unmatched rows keep it.
    changes = {x: F.when(F.col("_c_hit"), F.col("_c_" + x)).otherwise(F.col(x)) for x in crawler_owned}
    changes |= {x: F.when(empty(x), F.col("_c_" + x)).otherwise(F.col(x)) for x in reviewed_owned}
    if "saleAt" in reviewed_owned and "saleNote" in crawled.columns:
        filled = empty("saleAt") & ~empty("_c_saleAt")
        changes["saleNote"] = F.when(filled, F.col("_c_saleNote")).otherwise(F.col("saleNote"))
    # A crawled record without a reviewed one enters as it is.
    new = {x: F.when(F.col("_r_hit").isNull(), F.col("_c_" + x)).otherwise(changes.get(x, F.col(x))) for x in reviewed.columns if x != key and x in crawled.columns}
    return joined.withColumns({**changes, **new}).drop("_r_hit", *[x for x in joined.columns if x.startswith("_c_")])
