"""Reviewed and crawled facts of one record, column by column, as a policy table says (inc_03).

A policy is rows of (source, field, owner):

``crawl``        today's crawl replaces the value, also by nothing
``review``       the kept value stays unless it is empty
``shared``       three-way: the kept value stays where it differs from what the crawl said before (a person
                 changed it), else the crawl's is taken; both changed, and unlike: the kept one, as a conflict
``follows:<f>``  goes with field f: the crawl's where f was taken from the crawl, else the kept one

A field without a row stays as it was kept. Sources may differ in every field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CRAWL, REVIEW, SHARED, FOLLOWS = "crawl", "review", "shared", "follows:"


def _empty(c: Column) -> Column:
    return F.coalesce(F.length(c.cast("string")) == 0, F.lit(True))


def _policy(policy: DataFrame, source: str) -> DataFrame:
    """One map of owners for each source; the fields are as many as the record has."""
    return policy.groupBy(F.col("source").alias(source)).agg(F.map_from_entries(F.collect_list(F.struct("field", "owner"))).alias("_owner"))


def _joined(kept: DataFrame, base: DataFrame, crawled: DataFrame, policy: DataFrame, key: str, source: str) -> DataFrame:
    """The three sides as structs ``_k``, ``_b`` and ``_c``, with the source's owners."""
    side = lambda df, name: df.select(key, F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in df.columns if c != key]).alias(name))
    rows = side(kept, "_k").join(side(crawled, "_c"), key, "full").join(side(base, "_b"), key, "left")
    return rows.withColumn(source, F.coalesce(F.col("_k")[source], F.col("_c")[source])).join(_policy(policy, source), source, "left")


def _both() -> Column:
    return F.col("_k._there").isNotNull() & F.col("_c._there").isNotNull()


def _owned(rows: DataFrame, fields: list[str], nested: list[str]) -> DataFrame:
    """``rows`` with ``fields`` and ``nested`` by owner, and ``conflicts``."""
    k, b, c, both = F.col("_k"), F.col("_b"), F.col("_c"), _both()
    owner = lambda f: F.coalesce(F.element_at("_owner", F.lit(f)), F.lit(""))
    untouched = lambda f: k[f].eqNullSafe(b[f])

    def taken(f: str) -> Column:
        """Whether the crawl's value is taken; notes are decided by the field they follow."""
        fill = _empty(k[f]) & ~_empty(c[f])
        return F.when(owner(f) == CRAWL, F.lit(True)).when(owner(f) == REVIEW, fill).when(owner(f) == SHARED, untouched(f)).otherwise(F.lit(False))

    rows = rows.withColumn("_taken", F.create_map(*[x for f in fields for x in (F.lit(f), taken(f))]))
    lead = lambda f: F.when(owner(f).startswith(FOLLOWS), F.substring(owner(f), len(FOLLOWS) + 1, 255)).otherwise(F.lit(f))
    pick = lambda f, from_crawl: F.when(~both, F.coalesce(k[f], c[f])).when(from_crawl, c[f]).otherwise(k[f])
    clash = [F.when(both & (owner(f) == SHARED) & ~untouched(f) & ~c[f].eqNullSafe(b[f]) & ~c[f].eqNullSafe(k[f]), F.lit(f)) for f in fields]
    chosen = {f: pick(f, F.coalesce(F.element_at("_taken", lead(f)), F.lit(False))) for f in fields} | {f: pick(f, owner(f) == CRAWL) for f in nested}
    return rows.withColumns({**chosen, "conflicts": F.array_compact(F.array(*clash))})


def merge_owned(kept: DataFrame, base: DataFrame, crawled: DataFrame, policy: DataFrame, fields: list[str], nested: list[str] = (),
                key: str = "id", source: str = "source") -> DataFrame:
    """One row for each record of ``kept`` or ``crawled``: ``fields`` and ``nested`` by owner, and ``conflicts``.

    ``base`` has what the crawl said before; ``nested`` columns know the owner ``crawl`` and, without a row,
    the kept side. A record that only one side has is that side's, unchanged. ``conflicts`` lists the shared
    fields that a person and the crawl changed to unlike values.
    """
    rows = _owned(_joined(kept, base, crawled, policy, key, source), fields, list(nested))
    return rows.select(key, source, *fields, *nested, "conflicts")


def scoped_tickets(first: Column, then: Column, sessions: Column) -> Column:
    """Tickets (url, sessions) of both lists, each for sessions that are left; a URL counts where it comes first.

    A ticket without sessions goes, before its URL is looked at.
    """
    held = lambda s: F.exists(sessions, lambda x: x["date"].eqNullSafe(s["date"]) & x["time"].eqNullSafe(s["time"]))
    both = F.filter(F.array(first, then), lambda a: a.isNotNull())
    cut = F.transform(F.flatten(both), lambda t: F.struct(t["url"].alias("url"), F.filter(t["sessions"], held).alias("sessions")))
    left = F.filter(cut, lambda t: F.size(t["sessions"]) > 0)
    return F.aggregate(left, F.slice(left, 1, 0), lambda out, t: F.when(F.exists(out, lambda x: x["url"].eqNullSafe(t["url"])), out).otherwise(F.concat(out, F.array(t))))


def crawled_status(kept: Column, kept_note: Column, crawled: Column, crawled_note: Column, crawl_notes: list[str]) -> tuple[Column, Column]:
    """(status, note) of a record that the crawl lists.

    The crawl may cancel; it lifts its own cancellations, known by their notes, and ``unconfirmed``, but
    never a cancellation by a person.
    """
    cancels = F.coalesce(crawled == "cancelled", F.lit(False))
    own = (kept == "cancelled") & kept_note.isin(crawl_notes)
    lifted = F.coalesce(own | (kept == "unconfirmed"), F.lit(False))
    status = F.when(cancels, F.lit("cancelled")).when(lifted, F.lit("scheduled")).otherwise(kept)
    note = F.when(cancels, crawled_note).when(~lifted, kept_note)
    return status, note


def merge_reviewed(kept: DataFrame, base: DataFrame, crawled: DataFrame, policy: DataFrame, fields: list[str], crawl_notes: list[str],
                   key: str = "id", source: str = "source") -> DataFrame:
    """inc_03: ``merge_owned`` with sessions, tickets and status.

    Besides ``fields``, both sides have ``sessions`` (array of date, time), ``tickets`` (array of url,
    sessions), ``status`` and ``statusNote``. Tickets of both sides, the kept ones first, hold for the
    sessions that the record has after the merge. ``crawl_notes`` mark cancellations by the crawl.
    """
    rows = _owned(_joined(kept, base, crawled, policy, key, source), fields, ["sessions"])
    k, c, both = F.col("_k"), F.col("_c"), _both()
    status, note = crawled_status(k["status"], k["statusNote"], c["status"], c["statusNote"], crawl_notes)
    one = lambda f: F.coalesce(k[f], c[f])
    return rows.select(
        key, source, *fields, "sessions",
        F.when(both, scoped_tickets(k["tickets"], c["tickets"], F.col("sessions"))).otherwise(one("tickets")).alias("tickets"),
        F.when(both, status).otherwise(one("status")).alias("status"), F.when(both, note).otherwise(one("statusNote")).alias("statusNote"), "conflicts",
    )
