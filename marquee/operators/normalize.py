"""Provider rows to events (flt_12, prj_*, agg_01 to agg_03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import dates as D, text as T, urls as U, values as V
from marquee.operators import classify as C, venues


def some(c: Column) -> Column:
    """The value, or NULL when empty."""
    return F.when(F.length(c) > 0, c)


def accept_prefix(parsed: Column, is_bad, strict: bool = False) -> tuple[Column, Column]:
    """flt_12: (accepted items, first bad item) of an array of structs with a ``pos`` field.

    Items before the first bad one stay accepted unless ``strict``, which drops the whole row.
    """
    first_bad = F.get(F.filter(parsed, is_bad), F.lit(0))
    limit = F.coalesce(first_bad["pos"], F.lit(2**31 - 1))
    kept = F.filter(parsed, lambda s: s["pos"] < limit)
    if strict:
        kept = F.when(first_bad.isNull(), kept).otherwise(F.slice(kept, 1, 0))
    return kept, first_bad


def exhibitions(raw: DataFrame, links: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exhibition rows to (events, row verdicts).

    ``raw`` has the provider columns with ``shows`` and a total order ``ord``; ``links`` is the
    link-check table. One shuffle: the collapse by id, combined map-side.
    """
    title = T.clean(F.col("title"))
    parsed = F.transform(
        F.coalesce(F.col("shows"), F.array()),
        lambda s, i: F.struct(
            i.alias("pos"),
            D.lenient_date(F.coalesce(some(s["time"]), F.col("startDate"))).alias("start"),
            D.lenient_date(F.coalesce(some(s["endTime"]), F.col("endDate"))).alias("end"),
            T.clean(s["location"]).alias("address"),
            T.clean(s["locationName"]).alias("venue"),
            T.price_text(s["price"], s["onSales"]).alias("price"),
        ),
    )
    rows = raw.select(
        "ord", F.col("title").isNull().alias("_no_title"), title.alias("title"), "category", "startDate", "endDate",
        T.clean(F.col("UID")).alias("sourceUid"), T.clean(F.col("version")).alias("sourceVersion"),
        U.safe_or_empty(F.trim(T.unescape_named(T.or_empty(F.col("sourceWebPromote"))))).alias("promoteUrl"),
        parsed.alias("_shows"),
    )
    bad = lambda s: s["start"].isNull() | s["end"].isNull() | (s["end"] < s["start"])
    kept, first_bad = accept_prefix(F.col("_shows"), bad, strict)
    fb = F.col("_bad")
    reason = C.ladder(
        [
            (F.col("_no_title"), F.lit("MISSING_REQUIRED_FIELD")),
            ((F.col("title") == "") | ~F.col("category").eqNullSafe(F.lit(V.EXHIBITION_CATEGORY)), F.lit("CATEGORY_OR_TITLE_INVALID")),
            (F.size("_shows") == 0, F.lit("MISSING_VENUE")),
            (fb.isNotNull() & (fb["start"].isNull() | fb["end"].isNull()), F.lit("INVALID_DATE_OR_VALUE")),
            (fb.isNotNull(), F.lit("REVERSED_DATES")),
        ],
        F.lit(None).cast("string"),
    )
    rows = rows.withColumn("_kept", kept).withColumn("_bad", first_bad).withColumn("reject_reason", reason)
    verdicts = rows.select("ord", "sourceUid", "reject_reason")

    whole_row_bad = F.coalesce(
        F.col("reject_reason").isin("MISSING_REQUIRED_FIELD", "CATEGORY_OR_TITLE_INVALID", "MISSING_VENUE"), F.lit(False)
    )
    shows = (
        rows.where(~whole_row_bad)
        .select("ord", "title", "sourceUid", "sourceVersion", "promoteUrl", F.explode("_kept").alias("s"))
        .select("*", "s.*")
        .drop("s")
    )
    checks = links.select(
        F.col("uid").alias("sourceUid"), F.col("title").alias("_ct"), F.col("url").alias("_cu"),
        F.col("state").alias("_cs"), F.col("checkedAt").alias("_ca"),
    )
    key = F.when(
        F.length("sourceUid") > 0, T.stable_id(F.col("sourceUid"), F.col("venue"), F.col("address"))
    ).otherwise(
        T.stable_id(F.col("title"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("venue"), F.col("address"))
    )
    shows = (
        shows.join(checks, "sourceUid", "left")
        .withColumn("id", key)
        .withColumn("region", T.region_of(F.col("address")))
        .withColumn("park", T.park_of(F.col("venue"), F.col("address")))
        .withColumn("summary", T.listing_summary(F.col("region"), F.col("venue"), F.col("address")))
        .withColumn(
            "link",
            venues.resolve_link(F.col("sourceUid"), F.col("title"), F.col("promoteUrl"),
                                F.col("_ct"), F.col("_cu"), F.col("_cs"), F.col("_ca")),
        )
    )
    facts = ["title", "region", "venue", "address", "park", "price", "summary", "sourceUid", "sourceVersion", "promoteUrl", "link"]
    events = (
        shows.groupBy("id")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max_by(F.struct(*facts), F.struct("ord", "pos")).alias("f"),
        )
        .select("id", "start", "end", "f.*")
        .select(
            "*", F.lit("展覽").alias("category"), F.lit("moc").alias("source"), F.col("link.url").alias("url"),
            F.col("link.state").alias("sourceLinkState"), F.col("link.checkedAt").alias("sourceLinkCheckedAt"),
            F.col("link.type").alias("sourceLinkType"),
        )
        .drop("link")
    )
    return events, verdicts


def live(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Live rows of one kind to (events, row decisions).

    The first row of an event decides its facts; sessions are the distinct set; a later price
    that differs from the first one (a missing first price included) gives the fixed text.
    """
    title = T.clean(F.col("title"))
    text = C.evidence({"title": F.col("title"), "showUnit": F.col("showUnit"),
                       "descriptionFilterHtml": F.col("descriptionFilterHtml")})
    parsed = F.transform(
        F.coalesce(F.col("shows"), F.array()),
        lambda s, i: F.struct(
            i.alias("pos"),
            F.coalesce(some(T.clean(s["locationName"])), F.lit(V.VENUE_UNANNOUNCED)).alias("venue"),
            T.fold_tai(T.clean(s["location"])).alias("address"),
            D.session(F.coalesce(some(s["time"]), F.col("startDate"))).alias("session"),
            some(T.clean(s["price"])).alias("price"),
        ),
    )
    rows = raw.select(
        "ord", title.alias("title"), F.col("category"), F.col("startDate"), T.clean(F.col("UID")).alias("sourceUid"),
        T.clean(F.col("showUnit")).alias("performers"), parsed.alias("_shows"),
        C.classify(kind, text, category=F.col("category")).alias("_c"),
    )
    no_uid = F.col("sourceUid") == ""
    kept, first_bad = accept_prefix(F.col("_shows"), lambda s: s["session"].isNull() | no_uid)
    bad_title = (F.col("title") == "") | F.col("title").contains("�")
    invalid = (F.size("_shows") == 0) | F.col("_bad").isNotNull()
    final = C.ladder(
        [
            (~F.col("category").eqNullSafe(F.lit(V.KIND_CATEGORY[kind])), C.verdict("excluded", "OTHER_CATEGORY")),
            (bad_title, C.verdict("failed", "INVALID_PROVIDER_FACTS")),
            (F.col("_c.decision") != "included", F.col("_c")),
            (invalid, C.verdict("failed", "INVALID_PROVIDER_FACTS")),
        ],
        F.col("_c"),
    )
    rows = rows.withColumn("_kept", kept).withColumn("_bad", first_bad).withColumn("d", final)
    decisions = rows.select("ord", "sourceUid", "d.decision", "d.reason")
    # Shows before an invalid one stay accepted even though the row counts as failed.
    classified = (F.col("category") == V.KIND_CATEGORY[kind]) & ~bad_title & (F.col("_c.decision") == "included")
    shows = (
        rows.where(classified)
        .select("ord", "title", "performers", "sourceUid", F.explode("_kept").alias("s"))
        .select("ord", "title", "performers", "sourceUid", "s.*")
        .withColumn("id", T.stable_id(F.col("sourceUid"), F.col("venue")))
    )
    facts = ["sourceUid", "title", "performers", "venue", "address", "price"]
    label = {"concerts": "演唱會", "comedy": "單口喜劇"}[kind]
    first = F.min_by(F.struct(*facts), F.struct("ord", "pos"))
    events = (
        shows.groupBy("id")
        .agg(
            first.alias("f"),
            F.min("price").alias("_lo"),
            F.max("price").alias("_hi"),
            # Distinct sessions of one event are bounded by days times clock minutes.
            F.array_sort(F.collect_set("session")).alias("sessions"),
        )
        .select("id", "f.*", "_lo", "_hi", "sessions")
        .withColumn("price", collapsed_price(F.col("price"), F.col("_lo"), F.col("_hi")))
        .withColumn("region", T.region_of(F.col("address"), V.REGION_UNANNOUNCED))
        .withColumn("summary", T.live_summary(F.col("region"), F.col("venue"), label))
        .withColumn("source", F.lit("moc"))
        .withColumn("status", F.lit("scheduled"))
        .drop("_lo", "_hi")
    )
    return events, decisions


def collapsed_price(first: Column, low: Column, high: Column) -> Column:
    """agg_03 from three map-side aggregates: first price by order, minimum and maximum price."""
    conflict = F.coalesce(low != high, F.lit(False)) | (first.isNull() & high.isNotNull())
    return F.when(conflict, F.lit(V.PRICE_MIXED)).otherwise(first)


def collapse(df: DataFrame, key: str, start: str, end: str, order: Column) -> DataFrame:
    """agg_01: earliest start, latest end, every other column from the last row."""
    rest = [c for c in df.columns if c not in (key, start, end)]
    return (
        df.groupBy(key)
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.max_by(F.struct(*rest), order).alias("_r"))
        .select(key, start, end, "_r.*")
    )


def with_defaults(df: DataFrame) -> DataFrame:
    """prj_02: default texts of missing facts."""
    defaults = {
        "summary": V.SUMMARY_DEFAULT, "saleNote": V.SALE_NOTE_DEFAULT,
        "ticketStatus": V.TICKET_STATUS_DEFAULT, "status": "scheduled",
    }
    present = {k: v for k, v in defaults.items() if k in df.columns}
    absent = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.na.fill(present).withColumns(absent) if absent else df.na.fill(present)


def allow_listed(df: DataFrame, allowed: list[str]) -> DataFrame:
    """prj_01: keep named columns only."""
    return df.select(*[c for c in df.columns if c in set(allowed)])


def migrate_ticket(tickets: Column, url: Column, checked_at: Column, sessions: Column) -> Column:
    """prj_04: a single ticket URL with a check date becomes a one-element ticket list."""
    platform = U.platform_of(url)
    usable = tickets.isNull() & (F.length(checked_at) > 0) & platform.isNotNull() & U.is_safe(url, ("https",))
    ticket = F.struct(
        platform.alias("platform"), url.alias("url"), checked_at.alias("checkedAt"), sessions.alias("sessions")
    )
    return F.when(usable, F.array(ticket))


def session_facts(sessions: Column, performers: Column, host: Column) -> Column:
    """prj_05: the performers and host copied onto each session."""
    return F.transform(
        sessions,
        lambda s: F.struct(s["date"].alias("date"), s["time"].alias("time"),
                           performers.alias("performers"), host.alias("host")),
    )
