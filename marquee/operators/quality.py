"""Counters, guards and contract checks (agg_04, agg_05, agg_19, grd_*, chk_*)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import dates as D, values as V

DECISIONS = ["included", "excluded", "pending", "failed"]


def decision_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """agg_04: one row per key with a counter per decision."""
    aggs = [F.count("*").alias("discovered")]
    aggs += [F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS]
    return df.groupBy(*(keys or [])).agg(*aggs)


def reason_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """agg_04: reason histogram as rows."""
    return df.groupBy(*(keys or []), "decision", "reason").agg(F.count("*").alias("n"))


def reason_map(df: DataFrame, keys: list[str]) -> DataFrame:
    """agg_04: histogram as a map. Reasons are a fixed vocabulary, so the map stays small."""
    return (
        df.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    )


def reject_stats(df: DataFrame, rejected: Column, event_id: Column, keys: list[str] | None = None) -> DataFrame:
    """agg_05: input, valid, rejected and event counts in one pass."""
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("input_count"),
        F.count_if(~rejected).alias("valid_count"),
        F.count_if(rejected).alias("rejected_count"),
        F.count_distinct(F.when(~rejected, event_id)).alias("event_count"),
    )


def rejection_guard(rejected: Column, total: Column, floor: int | None = None, ratio: float = V.REJECT_RATIO) -> Column:
    """grd_02: TRUE when the batch must be refused. Strictly more than the allowed share."""
    allowed = total * F.lit(ratio)
    if floor is not None:
        allowed = F.greatest(F.lit(float(floor)), allowed)
    return rejected > allowed


def loss_guard(active: Column, incoming: Column, min_active: int = V.LOSS_MIN_ACTIVE, inclusive: bool = False,
               ratio: float = V.LOSS_RATIO) -> Column:
    """grd_03: TRUE when too many active rows vanished (strictly below the ratio)."""
    big_enough = (active >= min_active) if inclusive else (active > min_active)
    return F.coalesce(big_enough & (incoming < active * F.lit(ratio)), F.lit(False))


def calendar_guard(previous: Column, incoming: Column, floor: int = 15, ratio: float = 0.8) -> Column:
    """grd_03, calendar form."""
    return incoming < F.greatest(F.lit(floor), F.floor(previous * F.lit(ratio)))


def keep_last_good(previous: DataFrame, candidate: DataFrame, verdicts: DataFrame, key: str = "source") -> DataFrame:
    """grd_04: per source, the candidate when its verdict is ok, else the previous rows.

    A source without a verdict keeps its previous rows; sources never affect each other.
    """
    ok = verdicts.where("ok").select(key)
    return candidate.join(ok, key, "left_semi").unionByName(
        previous.join(ok, key, "left_anti"), allowMissingColumns=True
    )


def overall(verdicts: DataFrame) -> DataFrame:
    """grd_05: the run succeeds only when every source does."""
    return verdicts.agg(F.bool_and("ok").alias("all_ok"), F.count_if(~F.col("ok")).alias("failed_sources"))


def violations(df: DataFrame, rules: dict[str, Column], id_col: str = "id") -> DataFrame:
    """chk_*: one row per broken rule. A rule that evaluates to NULL counts as not broken."""
    broken = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    # The outer form with a later filter: a plain explode makes the optimizer evaluate the whole
    # array again in an inferred "not empty" filter.
    return df.select(F.col(id_col), F.explode_outer(F.array_compact(broken)).alias("violation")).where("violation IS NOT NULL")


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """chk_03: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("violation", F.lit(name))


def leak_scan(df: DataFrame, text: Column, keys: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """chk_05: rows matched per leak pattern, whole texts, one scan."""
    # Literals of which every match holds one gate the pattern: most texts are scanned by plain search.
    def gated(name, pattern):
        gates = V.LEAK_GATES.get(name) if patterns is None else None
        if not gates:
            return text.rlike(pattern)
        held = reduce(or_, [F.lower(text).contains(g) for g in gates])
        return F.when(held, text.rlike(pattern)).otherwise(F.lit(False))

    hits = F.array(*[F.when(gated(n, p), F.lit(n)) for n, p in (patterns or V.LEAK_PATTERNS).items()])
    return (
        df.select(*(keys or []), F.explode_outer(F.array_compact(hits)).alias("pattern"))
        .where("pattern IS NOT NULL")
        .groupBy(*(keys or []), "pattern")
        .agg(F.count("*").alias("n"))
    )


def multiset_digest(*values: Column) -> Column:
    """agg_19: digest of a group's rows, repeats counted, in any order: a sum that partial groups add up.

    Sixty bits of a hash for each row, summed as a decimal, so that no number of rows overflows.
    Values are told apart from each other by their lengths; null and empty text count as unlike.
    """
    part = lambda v: F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sum(F.conv(F.substring(F.md5(F.concat(*[part(v) for v in values]).cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)"))


def compared_totals(recorded: DataFrame, recomputed: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    """agg_19: (keys, recorded_x, recomputed_x for each total, agrees). A group on one side only disagrees."""
    side = lambda df, name: df.select(*keys, *[F.col(t).alias(f"{name}_{t}") for t in totals], F.lit(True).alias(f"_{name}"))
    both = side(recorded, "recorded").join(side(recomputed, "recomputed"), keys, "full")
    same = reduce(lambda a, b: a & b, [F.col(f"recorded_{t}").eqNullSafe(F.col(f"recomputed_{t}")) for t in totals])
    agrees = F.coalesce(F.col("_recorded") & F.col("_recomputed") & same, F.lit(False))
    return both.withColumn("agrees", agrees).drop("_recorded", "_recomputed")


def safe_reason(message: Column, allowed: list[str] | None = None) -> Column:
    """chk_09: known messages pass, any other becomes the generic code."""
    return F.when(message.isin(*(allowed or V.ITEM_REASONS)), message).otherwise(F.lit(V.GENERIC_REASON))


def extra_keys(keys: Column, allowed: list[str]) -> Column:
    """set_04: observed keys outside the allow-list."""
    return F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))


def traversal_state(expected: Column, visited: Column, claimed: Column) -> Column:
    """set_05 / chk_06: struct(valid, complete). The claim alone never proves completeness."""
    inside = F.size(F.array_except(visited, expected)) == 0
    all_seen = F.size(F.array_except(expected, visited)) == 0
    unique = (F.size(F.array_distinct(visited)) == F.size(visited)) & (
        F.size(F.array_distinct(expected)) == F.size(expected)
    )
    valid = inside & unique & (F.size(expected) > 0)
    return F.struct(valid.alias("valid"), (valid & all_seen & F.coalesce(claimed, F.lit(False))).alias("complete"))


def event_rules(today: Column | None = None) -> dict[str, Column]:
    """chk_01: rules over a live event row (columns as in ``schemas.LIVE_COLUMNS``)."""
    from marquee.functions import urls as U

    missing = lambda c: F.coalesce(F.length(F.col(c)) == 0, F.lit(True))
    # Set difference of equal structs: linear in the sessions, where a nested exists is quadratic.
    slots = lambda a: F.transform(a, lambda s: F.struct(s["date"].alias("date"), s["time"].alias("time")))
    no_tickets = F.coalesce(F.col("tickets"), F.array())
    return {
        "identity": missing("sourceUid") | missing("title") | missing("region") | missing("venue"),
        "sessions_empty": F.coalesce(F.size("sessions") == 0, F.lit(True)),
        "session_date": F.exists("sessions", lambda s: D.strict_date(s["date"]).isNull()),
        "session_time": F.exists("sessions", lambda s: s["time"].isNotNull() & ~s["time"].rlike(r"^(?:[01]?\d|2[0-3]):[0-5]?\d$")),
        "source_url": ~U.is_safe(F.col("sourceUrl"), ("https",)),
        "status": ~F.col("status").isin(*V.EVENT_STATUSES),
        "summary_length": F.length("summary") > 180,
        "ticket_url": F.exists(no_tickets, lambda t: ~U.is_detail(t["url"])),
        "ticket_platform": F.exists(
            no_tickets,
            lambda t: F.coalesce((F.length(t["platform"]) == 0) | (F.length(t["platform"]) > 80) | t["platform"].contains("<"), F.lit(True)),
        ),
        "ticket_checked": F.exists(no_tickets, lambda t: D.strict_date(t["checkedAt"]).isNull()),
        "ticket_scope": F.exists(
            no_tickets, lambda t: F.coalesce(F.size(t["sessions"]) == 0, F.lit(True)) | (F.size(F.array_except(slots(t["sessions"]), slots(F.col("sessions")))) > 0)
        ),
    }


def listing_rules() -> dict[str, Column]:
    """chk_02: rules over a published exhibition row."""
    from marquee.functions import urls as U

    return {
        "locations_empty": F.coalesce(F.size("locations") == 0, F.lit(True)),
        "location_region": F.exists("locations", lambda l: l["region"] != F.col("region")),
        "location_status": F.exists("locations", lambda l: ~l["status"].isin(*V.VENUE_STATUSES)),
        "summary_length": F.length("summary") > 180,
        "price_length": F.length("price") > 180,
        "summary_markup": F.col("summary").rlike("<[^>]+>"),
        "url": ~U.is_safe(F.col("url")),
    }


def race_rules(source_prefix: str) -> dict[str, Column]:
    """chk_04: rules over a calendar row."""
    return {
        "id_pattern": ~F.col("id").rlike("^[a-z0-9-]+$"),
        "status": ~F.col("status").isin("ok", "unconfirmed"),
        "dates_ordered": F.col("weekendStart") > F.col("weekendEnd"),
        "source": ~F.col("source").startswith(source_prefix),
        "utc_offset": F.exists("sessions", lambda s: ~s["start"].endswith("+00:00")),
    }
