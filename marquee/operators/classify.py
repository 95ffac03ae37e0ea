"""Classification ladders (cls_*)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions import values as V
from marquee.functions.dates import is_stale

UNICODE_CI = "(?iU)"


def ladder(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """First matching rule wins."""
    out = None
    for condition, value in rules:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return default if out is None else out.otherwise(default)


def evidence(columns: dict[str, Column]) -> Column:
    """Evidence text: the known fields in fixed order, missing ones empty."""
    return F.concat_ws(
        " ", *[F.coalesce(columns[f].cast("string"), F.lit("")) for f in V.EVIDENCE_FIELDS if f in columns]
    )


def verdict(decision: str, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))


def classify(
    kind: str,
    text: Column,
    reviewed_kind: Column | None = None,
    category: Column | None = None,
    patterns: dict[str, str] | None = None,
) -> Column:
    """cls_01: struct(decision, reason). ``patterns`` replaces the fixed patterns by name."""
    p = {
        "course": UNICODE_CI + V.COURSE_PATTERN,
        "fan": UNICODE_CI + V.FAN_MEETING_PATTERN,
        "other": UNICODE_CI + V.OTHER_FORMAT_PATTERN,
        "comedy": UNICODE_CI + V.STANDUP_PATTERN,
        "concerts": UNICODE_CI + V.CONCERT_PATTERN,
        **(patterns or {}),
    }
    reviewed = F.lit(None).cast("string") if reviewed_kind is None else reviewed_kind
    rules = [
        (text.rlike(p["course"]), verdict("excluded", "COURSE_OR_MUSICAL")),
        (text.rlike(p["fan"]), verdict("excluded", "FAN_MEETING_OR_UPGRADE")),
    ]
    if kind == "comedy":
        rules.append((text.rlike(p["other"]), verdict("excluded", "OTHER_PERFORMANCE_FORMAT")))
    rules += [
        (reviewed == kind, verdict("included", "OFFICIAL_REVIEWED_FORMAT")),
        (reviewed.isin(*V.KIND_CATEGORY), verdict("excluded", "OTHER_REVIEWED_FORMAT")),
    ]
    if kind == "comedy":
        rules.append((text.rlike(p["comedy"]), verdict("included", "MULTIFIELD_STANDUP_EVIDENCE")))
        return ladder(rules, verdict("pending", "INSUFFICIENT_STANDUP_EVIDENCE"))
    positive = text.rlike(p["concerts"])
    if category is not None:
        positive = positive | (category == V.KIND_CATEGORY["concerts"])
    rules.append((positive, verdict("included", "CONCERT_EVIDENCE")))
    return ladder(rules, verdict("pending", "INSUFFICIENT_CONCERT_EVIDENCE"))


def genre(
    text: Column,
    rules: list[tuple[str, str]] | None = None,
    fallback: tuple[str, str, str] = ("音樂會", V.GENRE_OTHER, V.GENRE_DEFAULT),
    flags: str = UNICODE_CI,
) -> Column:
    """cls_02: first matching rule; otherwise one of two defaults."""
    word, other, default = fallback
    pairs = [(text.rlike(flags + pattern), F.lit(label)) for label, pattern in (rules or V.GENRE_RULES)]
    return ladder(pairs, F.when(text.contains(word), F.lit(other)).otherwise(F.lit(default)))


def demote_unreviewed(decided: Column, reviewed: Column) -> Column:
    """cls_05: included without a detail review becomes pending."""
    return F.when(
        (decided["decision"] == "included") & ~F.coalesce(reviewed, F.lit(False)),
        verdict("pending", "DETAIL_FACTS_NOT_REVIEWED"),
    ).otherwise(decided)


def tag_prefilter(tag: Column, decided: Column, allowed: list[str]) -> Column:
    """cls_06: tags outside the list never need a detail read."""
    return F.when(~tag.isin(*allowed), verdict("excluded", "OTHER_REVIEWED_FORMAT")).otherwise(decided)


def feed_decision(
    start: Column, end: Column, today: Column, decided: Column, place_known: Column, has_sessions: Column
) -> Column:
    """cls_07: reasons a readable feed entry is not published."""
    return ladder(
        [
            (~has_sessions, verdict("excluded", "NO_STRUCTURED_EVENT")),
            (end != start, verdict("excluded", "MULTI_DAY_PARENT_LISTING")),
            (start < today, verdict("excluded", "PAST_EVENT")),
            (decided["decision"] != "included", decided),
            (~place_known, verdict("pending", "PLACE_NOT_STRUCTURED")),
        ],
        decided,
    )


def badge(start: Column, end: Column, note: Column, today: Column) -> Column:
    """cls_08: display badge of a listing."""
    return ladder(
        [
            (F.length(note) > 0, F.lit(V.BADGE_NOTE)),
            (end < today, F.lit(V.BADGE_ENDED)),
            (start.isNull() | end.isNull(), F.lit(V.BADGE_UNKNOWN)),
            (start > today, F.lit(V.BADGE_UPCOMING)),
            (F.datediff(end, today) <= 14, F.lit(V.BADGE_ENDING)),
        ],
        F.lit(V.BADGE_RUNNING),
    )


def sale_conflict(sale_at: Column, any_ticket_sale: Column, note: Column, pattern: str = V.SALE_CONFLICT_PATTERN) -> Column:
    """cls_09: a sale time exists while the note says none was announced."""
    has_time = (F.length(sale_at) > 0) | any_ticket_sale
    return F.coalesce(has_time, F.lit(False)) & F.coalesce(note.rlike(pattern), F.lit(False))


def sale_time_value(conflict: Column, ticket_sale: Column, event_sale: Column) -> Column:
    """fn_21: the contradiction text, else the ticket's time, else the event's."""
    some = lambda c: F.when(F.length(c) > 0, c)
    return F.when(conflict, F.lit(V.SALE_CONFLICT_TEXT)).otherwise(
        F.coalesce(some(ticket_sale), some(event_sale), F.lit(""))
    )


def stale(last_success: Column, now: Column) -> Column:
    return is_stale(last_success, now)


def state_label(status: Column, mode: Column) -> Column:
    """cls_11: label of a source state."""
    return ladder(
        [
            ((status == "ok") & (mode == "daily-crawl"), F.lit(V.STATE_DAILY)),
            (status == "ok", F.lit(V.STATE_DONE)),
            (status == "manual", F.lit(V.STATE_MANUAL)),
            (status == "pending", F.lit(V.STATE_PENDING)),
        ],
        F.lit(V.STATE_FAILED),
    )
