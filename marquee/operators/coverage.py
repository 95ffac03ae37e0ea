"""Coverage of sources and platforms (agg_07 to agg_09, agg_20, joi_10 to joi_12, joi_16, joi_19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import urls as U
from marquee.operators.tickets import join_sessions


def scope_report(events: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """agg_07: per key, distinct detail URLs, date range, event and session counts.

    ``events`` has the keys, event and url; ``sessions`` has event and day. Sessions are reduced
    per event before the join.
    """
    per_event = sessions.groupBy("event").agg(
        F.count("*").alias("_n"), F.min("day").alias("_lo"), F.max("day").alias("_hi")
    )
    return (
        events.join(per_event, "event", "left")
        .groupBy(*keys)
        .agg(
            F.count_distinct("url").alias("detail_urls"),
            F.min("_lo").alias("date_from"),
            F.max("_hi").alias("date_through"),
            F.count("*").alias("stored_events"),
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("stored_sessions"),
        )
    )


def source_rollup(scopes: DataFrame, key: str) -> DataFrame:
    """agg_08: latest review and success over kinds; unknown counts as empty text."""
    return scopes.groupBy(key).agg(
        F.max(F.coalesce("reviewed_at", F.lit(""))).alias("checked_at"),
        F.max(F.coalesce("last_success", F.lit(""))).alias("last_success"),
    )


def curated_stats(df: DataFrame, key: str, last_seen: Column, uncertain: Column) -> DataFrame:
    """agg_09: rows, latest check and uncertain rows per source."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.max(last_seen).alias("verified"), F.count_if(uncertain).alias("uncertain")
    )


def decorate(sources: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """joi_10: sources with their coverage columns, where present."""
    return sources.join(matrix, key, "left")


def coverage_only(matrix: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """joi_11: coverage rows of sources that are not active."""
    return matrix.join(sources.select(key), key, "left_anti")


def platform_coverage(sessions: DataFrame, tickets: DataFrame) -> DataFrame:
    """joi_12: per platform, events with a ticket on it and sessions its tickets cover."""
    t = tickets.select("event", "day", "clock", "platform").distinct()
    s = sessions.select("event", "day", "clock").distinct()
    hit = join_sessions(s, t, "inner")
    # Two counts over already distinct rows: events per platform need one more small reduction.
    per_event = hit.groupBy("platform", "event").agg(F.count("*").alias("_n"))
    return per_event.groupBy("platform").agg(
        F.count("*").alias("event_count"), F.sum("_n").cast("bigint").alias("session_count")
    )


def with_pending_status(registry: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """joi_19: registered sources; without a snapshot the state is pending and counters stay NULL."""
    return registry.join(snapshots, key, "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def legacy_sources(published: DataFrame, registry: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """joi_16: published sources missing in the registry, with a saved or placeholder status."""
    unknown = published.select(key).distinct().join(registry.select(key), key, "left_anti")
    return unknown.join(statuses, key, "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def bundle_by_source(rows: DataFrame, url: Column, ok: Column, hosts: dict[str, str], suffixes: dict[str, str] | None = None) -> DataFrame:
    """agg_20: one line per source of a batch: items, outcome; unmapped hosts get source NULL."""
    return (
        rows.withColumn("source_id", U.source_of(url, hosts, suffixes or {}))
        .withColumn("_ok", ok)
        .groupBy("source_id")
        .agg(F.count("*").alias("items"), F.bool_and("_ok").alias("ok"))
    )
