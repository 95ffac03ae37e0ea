"""Builds: the whole chains of the exhibition and the live topics, lazily composed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marquee.functions import urls as U, values as V
from marquee.operators import calendar as CAL, classify as C, normalize as N, overlay as O, quality as Q, reconcile as R, snapshot as P, tickets as K, venues as VN
from marquee.operators.ranking import first_per_key
from marquee.operators.steps import Steps


@dataclass
class ExhibitionBuild:
    events: DataFrame
    verdicts: DataFrame
    state: str
    reason: str | None
    counts: dict


EMPTY_REVISIONS = "cast(array() as array<struct<title:string,start:date,end:date,price:string,lastSeen:string>>)"


def exhibitions(raw: DataFrame, previous: DataFrame, curated: DataFrame, links: DataFrame, now: str) -> ExhibitionBuild:
    """Rows -> guards -> merge (or last good) -> link refresh -> curated precedence -> dedup -> venues.

    The guards need one small aggregate before anything is merged; everything else stays lazy.
    ``previous`` and ``curated`` have the published listing columns.
    """
    events, verdicts = N.exhibitions(raw, links)
    provider_before = previous.where("source = 'moc'")
    today = F.lit(now[:10]).cast("date")
    stats = verdicts.agg(F.count("*").alias("rows"), F.count("reject_reason").alias("rejected")).first()
    found = events.agg(F.count("*").alias("n")).first()["n"]
    active = provider_before.agg(
        F.count_if((F.col("end") >= today) & ~F.coalesce("missingFromSource", F.lit(False))).alias("n")
    ).first()["n"]
    reason = None
    if stats["rows"] == 0:
        reason = "EMPTY_INPUT"
    elif found == 0:
        reason = "NO_VALID_EVENTS"
    elif stats["rejected"] > stats["rows"] * V.REJECT_RATIO:
        reason = "REJECTION_RATE_OVER_20_PERCENT"
    elif active > V.LOSS_MIN_ACTIVE and found < active * V.LOSS_RATIO:
        reason = "SOURCE_LOSS_OVER_50_PERCENT"
    merged = provider_before if reason else P.merge_listings(provider_before, events, now)
    if not reason:
        merged = refresh_missing_links(merged, links)
    combined = O.curated_first(merged, curated)
    ranked = combined.withColumn("_prio", (F.col("source") != "moc").cast("int"))
    dedup = O.fingerprint_dedup(ranked, F.col("title"), ["region", "start", "end"], F.struct("_prio", "id")).drop("fp", "_prio")
    counts = {"inputCount": stats["rows"], "rejectedCount": stats["rejected"], "eventCount": found, "previousActiveCount": active}
    return ExhibitionBuild(VN.group_venues(dedup), verdicts, "error" if reason else "ok", reason, counts)


def refresh_missing_links(events: DataFrame, links: DataFrame) -> DataFrame:
    """Rows the batch no longer lists resolve their link again from the link-check table."""
    checks = links.select(
        F.col("uid").alias("_uid"), F.col("title").alias("_t"), F.col("url").alias("_u"), F.col("state").alias("_s"), F.col("checkedAt").alias("_c")
    )
    missing = F.coalesce(F.col("missingFromSource"), F.lit(False))
    link = VN.resolve_link(
        F.col("sourceUid"), F.col("title"), F.col("promoteUrl"), F.col("_t"), F.col("_u"), F.col("_s"), F.col("_c")
    )
    joined = events.join(checks, F.col("sourceUid") == F.col("_uid"), "left").withColumn("_l", link)
    pick = lambda field, col: F.when(missing, F.col("_l")[field]).otherwise(F.col(col))
    return joined.withColumns(
        {
            "url": pick("url", "url"), "sourceLinkState": pick("state", "sourceLinkState"),
            "sourceLinkCheckedAt": pick("checkedAt", "sourceLinkCheckedAt"), "sourceLinkType": pick("type", "sourceLinkType"),
        }
    ).drop("_uid", "_t", "_u", "_s", "_c", "_l")


def live_provider(raw: DataFrame, previous: DataFrame, kind: str, now: str) -> tuple[DataFrame, DataFrame, str | None]:
    """Provider rows of one kind merged into its snapshot, or the last good snapshot.

    Returns events, row decisions and the refusal reason.
    """
    rows = raw.agg(F.count("*").alias("n"), F.count_if(F.col("category") == V.KIND_CATEGORY[kind]).alias("own")).first()
    if rows["n"] == 0 or rows["own"] == 0:
        return previous, raw.limit(0), "UNEXPECTED_CATEGORY" if rows["n"] else "EMPTY_INPUT"
    events, decisions = N.live(raw, kind)
    failed = decisions.agg(F.count_if(F.col("decision") == "failed").alias("n")).first()["n"]
    if failed > rows["n"] * V.REJECT_RATIO:
        return previous, decisions, "MALFORMED_RECORDS"
    if kind == "concerts" and events.isEmpty():
        return previous, decisions, "NO_VALID_EVENTS"
    shaped = events.withColumn("statusNote", F.lit(None).cast("string")).withColumn(
        "revisions", F.expr("cast(array() as array<struct<at:string,note:string,previousSessions:array<struct<date:date,time:string>>>>)")
    )
    return P.merge_live(previous, shaped, now), decisions, None


def as_records(events: DataFrame) -> DataFrame:
    """Live events in the shape of the reconciliation: uid, program and the pages they cite.

    A dataset page describes no single event and is not evidence.
    """
    tickets = F.transform(F.coalesce("tickets", F.array()), lambda t: t["url"])
    own = F.when((F.length("sourceUrl") > 0) & ~F.col("sourceUrl").contains(V.DATASET_MARK), F.col("sourceUrl"))
    cols = set(events.columns)
    return events.withColumns(
        {
            "uid": F.col("sourceUid"),
            "program": F.col("programKey") if "programKey" in cols else F.lit(None).cast("string"),
            "urls": F.array_distinct(tickets),
            "page": own,
            "region": F.replace(F.col("region"), F.lit("台"), F.lit("臺")),
        }
    )


def live(parts: list[DataFrame], kind: str) -> dict[str, DataFrame]:
    """Reconcile all origins of one kind, first part first; adds the genre for concerts.

    Each part has ``pos``, its rows' unique position; parts and positions together are the
    priority order.
    """
    union = O.ordered_union([as_records(p) for p in parts])
    records = union.withColumn("ord", F.col("prio").cast("bigint") * F.lit(1 << 56) + F.col("pos")).drop("prio", "pos")
    out = R.merged(records, R.clusters(records))
    if kind == "concerts":
        text = F.concat_ws(" ", "title", F.coalesce("performers", F.lit("")))
        out["events"] = out["events"].withColumn("genre", C.genre(text))
    return out


def import_reviewed(items: DataFrame, kind: str, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed items (one row per item) to decisions and counters.

    ``items`` has sourceUid, officialFactsReviewed, evidence (map) and page_id.
    """
    evidence = {f: F.col("evidence")[f] for f in V.EVIDENCE_FIELDS}
    decided = C.classify(kind, C.evidence(evidence), F.col("evidence")["reviewedKind"], F.col("evidence")["category"])
    d = items.withColumn("d", C.demote_unreviewed(decided, F.col("officialFactsReviewed")))
    ledger = d.select("sourceUid", "page_id", F.col("d.decision").alias("decision"), F.col("d.reason").alias("reason"))
    return ledger, Q.decision_counts(ledger)


def calendar_seasons(raw: DataFrame, declared: DataFrame, previous: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Calendars of any number of seasons: each one is replaced as a whole, or stays as it was.

    ``raw``: calendar rows with ``tableSeason``, the season they were asked for. ``declared``: season and the
    ``total`` its response states. ``previous``: season, id, name, status, lastSuccess of all seasons. Returns
    the rows of all seasons and one verdict for each declared season: ok, reason. Races that an accepted
    season no longer lists stay, unconfirmed. A season of any size is counted by its ids first. The verdicts
    are written once: three joins on the season read them, and as a table of known size they are broadcast
    where they are few, so that the rows of a season are not gathered in one task.
    """
    rows = CAL.races(raw, F.col("tableSeason")).withColumn("season", F.col("tableSeason"))
    ids = rows.groupBy("season", "id").agg(F.count("*").alias("n"), F.bool_and("valid").alias("valid"))
    seen = ids.groupBy("season").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.bool_and("valid").alias("valid"))
    held = previous.groupBy("season").agg(F.count("*").alias("held"))
    n = F.coalesce("rows", F.lit(0))
    reason = (
        F.when(~n.eqNullSafe(F.col("total")), "INCOMPLETE_CALENDAR").when(~F.col("valid"), "INVALID_RACE")
        .when(F.col("most") > 1, "DUPLICATE_RACE").when(Q.calendar_guard(F.coalesce("held", F.lit(0)), n), "DIMINISHED_CALENDAR")
    )
    verdicts = declared.join(seen, "season", "left").join(held, "season", "left").select("season", reason.isNull().alias("ok"), reason.alias("reason"))
    verdicts = Steps(raw.sparkSession, "seasons").keep(verdicts)
    fresh = rows.withColumns({"name": F.col("raceName"), "status": F.lit("ok"), "lastSuccess": F.lit(now)})
    accepted = fresh.join(verdicts.where("ok").select("season"), "season", "left_semi").drop("tableSeason", "valid")
    # Of an accepted season, what it no longer lists; of any other season, everything.
    left = previous.join(accepted.select("season", "id"), ["season", "id"], "left_anti").join(verdicts.select("season", "ok"), "season", "left")
    kept = left.withColumn("status", F.when(F.coalesce("ok", F.lit(False)), F.lit("unconfirmed")).otherwise(F.col("status"))).drop("ok")
    return accepted.unionByName(kept, allowMissingColumns=True), verdicts


EVENT_KEY = ["sourceId", "kind", "id"]


def envelope_verdicts(envelopes: DataFrame, registry: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """One row for each reviewed envelope: what it covers, its item totals, and why it is refused.

    ``envelopes``: sourceId, kind, reviewedAt, traversal, pages (id, url). ``registry``: id, adapter, kinds.
    ``items``: sourceId, kind, decision. An envelope proves its scope complete only if every expected page
    was visited.
    """
    allowed = registry.where("adapter = 'reviewed-json'").select(F.col("id").alias("sourceId"), F.explode("kinds").alias("kind"), F.lit(True).alias("_known")).distinct()
    totals = items.groupBy("sourceId", "kind").agg(F.count("*").alias("discovered"), *[F.count_if(F.col("decision") == d).alias(d) for d in ("included", "excluded", "pending", "failed")])
    rows = envelopes.join(allowed, ["sourceId", "kind"], "left").join(totals, ["sourceId", "kind"], "left")
    expected, visited = F.coalesce("traversal.expectedPageIds", F.array()), F.coalesce(F.transform("pages", lambda p: p["id"]), F.array())
    unlike = lambda ids: F.size(F.array_distinct(ids)) < F.size(ids)
    day = F.col("reviewedAt").try_cast("date")
    found = F.coalesce("discovered", F.lit(0))
    reason = (
        F.when(F.col("_known").isNull(), "NOT_REGISTERED").when(day.isNull() | (day > F.lit(now[:10]).cast("date")), "REVIEW_DAY")
        .when((F.size(expected) == 0) | unlike(expected), "EXPECTED_PAGES").when(unlike(visited) | (F.size(F.array_except(visited, expected)) > 0), "VISITED_PAGES")
        .when(F.exists("pages", lambda p: ~U.is_safe(p["url"], ("https",))), "PAGE_URL").when(found == 0, "NO_ITEMS").when(F.col("failed") > 0, "INVALID_FACTS")
    )
    whole = reason.isNull() & F.coalesce("traversal.complete", F.lit(False)) & (F.size(F.array_except(expected, visited)) == 0)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("discovered", "included", "excluded", "pending", "failed")]
    return rows.select(
        "sourceId", "kind", reason.isNull().alias("ok"), reason.alias("reason"), whole.alias("coverageComplete"),
        F.size(visited).alias("pagesVisited"), F.size(expected).alias("expectedPages"), *counts,
    )


def reviewed_snapshots(verdicts: DataFrame, events: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """Events of all sources after their reviewed imports.

    ``events``: included events of the envelopes and ``previous``: those held before; both have sourceId,
    kind, id, sessions, status, statusNote and revisions. A refused envelope changes nothing. An unlisted
    event is never dropped; it becomes unconfirmed only where the scope was read completely. Of an id that
    an envelope repeats, the row with the greatest sessions counts.
    """
    ok = verdicts.where("ok").select("sourceId", "kind", "coverageComplete")
    fresh = first_per_key(events.join(ok.drop("coverageComplete"), ["sourceId", "kind"], "left_semi"), EVENT_KEY, F.struct("sessions", "status"), last=True)
    before = previous.select(*EVENT_KEY, F.struct("sessions", "revisions").alias("_b"))
    b = F.col("_b")
    moved = b.isNotNull() & ~b["sessions"].eqNullSafe(F.col("sessions"))
    revision = F.array(F.struct(F.lit(now).alias("at"), F.lit(V.NOTE_REVIEWED_CHANGED).alias("note"), b["sessions"].alias("previousSessions")))
    history = F.when(b.isNull(), F.col("revisions")).when(moved, F.concat(b["revisions"], revision)).otherwise(b["revisions"])
    listed = fresh.join(before, EVENT_KEY, "left").withColumns(
        {"status": F.when(moved & (F.col("status") == "scheduled"), "changed").otherwise(F.col("status")), "revisions": history}
    ).drop("_b")
    left = previous.join(fresh.select(*EVENT_KEY), EVENT_KEY, "left_anti").join(ok, ["sourceId", "kind"], "left")
    lost = F.coalesce("coverageComplete", F.lit(False)) & (F.col("status") != "cancelled")
    left = left.withColumns({"statusNote": F.when(lost, V.NOTE_NOT_LISTED).otherwise(F.col("statusNote")), "status": F.when(lost, "unconfirmed").otherwise(F.col("status"))})
    return listed.unionByName(left.drop("coverageComplete"))
