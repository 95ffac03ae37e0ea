"""Contracts of published JSON rows (chk_01 to chk_04): row, field, key and size rules in one place.

A contract is checked by one scan for everything that a row decides alone and one keyed count for what
rows decide together. Names outside an allow-list are seen in the raw text, before the schema drops them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import urls as U, values as V
from marquee.operators import quality as Q, venues

SLOTS = "array<struct<date: string, time: string, status: string>>"
TICKETS = "array<struct<platform: string, url: string, checkedAt: string, sessions: array<struct<date: string, time: string>>, price: string, saleAt: string>>"
EVENT = (
    "id string, source string, sourceUid string, title string, region string, venue string, sourceUrl string, status string, summary string,"
    f" ticketUrl string, ticketVerifiedAt string, genre string, sessions {SLOTS}, tickets {TICKETS}"
)
LISTING = (
    "id string, title string, region string, summary string, price string, verificationNote string, url string, source string, sourceUid string,"
    " promoteUrl string, sourceLinkState string, sourceLinkCheckedAt string, locations array<struct<id: string, name: string, region: string, status: string>>"
)
RACE = (
    "id string, weekendStart string, weekendEnd string, source string, dataSource string, status string,"
    " sessions array<struct<name: string, start: string, end: string>>"
)
PLATFORM = "name string, links array<struct<url: string>>"


@dataclass(frozen=True)
class Contract:
    """``rules``: violation to a condition that is TRUE where it is broken; ``fields``: violation to (path of an
    object or of an array of objects, allowed names); ``exact``: paths whose objects hold all allowed names;
    ``unique``: violation to a column whose value no two rows share; ``minimum``: rows a scope holds at least."""

    schema: str
    rules: dict[str, Column]
    fields: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    exact: tuple[str, ...] = ()
    unique: dict[str, str] = field(default_factory=dict)
    minimum: int = 0


def _wrong_names(path: str, allowed: list[str], exact: bool) -> Column:
    def wrong(names: Column) -> Column:
        extra = F.size(Q.extra_keys(names, allowed)) > 0
        return extra | (F.size(F.array_intersect(names, F.array(*[F.lit(a) for a in allowed]))) < len(allowed)) if exact else extra

    if path == "$":
        return wrong(F.json_object_keys("raw"))
    return F.exists(F.from_json(F.get_json_object("raw", path), "array<map<string,string>>"), lambda m: wrong(F.map_keys(m)))


def check(lines: DataFrame, contract: Contract, scope: list[str]) -> DataFrame:
    """(scope columns, id, violation) of ``lines`` (scope columns, raw).

    A raw text that is null or no JSON object gives ``unreadable`` and nothing else. A key that several
    rows of a scope share is reported once, with the key as id; a scope below the minimum once, with a
    null id. A scope without rows is reported only if there are no scope columns.

    The texts are read once: what a row breaks, under a number of its own, and the keys that it holds go
    through one count.
    """
    names = {n: _wrong_names(path, allowed, path in contract.exact) for n, (path, allowed) in contract.fields.items()}
    e = lines.select(*scope, "raw", F.from_json("raw", contract.schema).alias("e"), F.json_object_keys("raw").isNull().alias("unreadable"))
    rows = e.select(*scope, "raw", "unreadable", "e.*")
    rules = {"unreadable": F.col("unreadable")} | {n: ~F.col("unreadable") & c for n, c in {**contract.rules, **names}.items()}
    # Without null entries; a filter by lambda would interpret all rules.
    broken = F.array_except(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), F.array(F.lit(None).cast("string")))
    # The rules are a column of their own: inside a generator they would be interpreted, shared parts again for each rule.
    if not contract.unique and not contract.minimum:
        return rows.select(*scope, "id", broken.alias("_broken")).select(*scope, "id", F.explode_outer("_broken").alias("violation")).where("violation is not null")
    keys = {n: F.col(c) for n, c in contract.unique.items()} | ({"too_few_rows": F.lit(None).cast("string")} if contract.minimum else {})
    item = lambda violation, id, row: F.struct(violation.alias("violation"), id.cast("string").alias("id"), row.cast("bigint").alias("_row"))
    held = [F.when(~F.col("unreadable"), item(F.lit(n), c, F.lit(None))) for n, c in keys.items()]
    marked = rows.select(*scope, "id", broken.alias("_broken"), F.array_compact(F.array(*held)).alias("_held"), F.monotonically_increasing_id().alias("_row"))
    # Read twice here, so that the rules stay a column of the step before.
    found = F.concat(F.transform("_broken", lambda v: item(v, F.col("id"), F.col("_row"))), "_held")
    items = marked.select(*scope, F.when(F.size("_broken") > 0, found).otherwise(F.col("_held")).alias("_items")).select(*scope, F.inline("_items")).withColumn("_one", F.lit(1))
    if contract.minimum and not scope:
        none = lines.sparkSession.range(1).select(F.lit("too_few_rows").alias("violation"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("_row"), F.lit(0).alias("_one"))
        items = items.unionByName(none)
    count = items.groupBy(*scope, "violation", "id", "_row").agg(F.sum("_one").alias("n"))
    shared = F.when(F.col("violation") == "too_few_rows", F.col("n") < contract.minimum).otherwise(F.col("id").isNotNull() & (F.col("n") > 1))
    return count.where(F.col("_row").isNotNull() | shared).select(*scope, "id", "violation")


# Names that published objects may have.
SESSION_FIELDS = ["date", "time", "status"]
TICKET_FIELDS = ["platform", "url", "checkedAt", "sessions", "price", "saleAt"]
EVENT_FIELDS = [
    "id", "source", "sourceUid", "title", "performers", "region", "venue", "address", "sessions", "price", "saleAt", "saleNote", "ticketStatus",
    "ticketUrl", "ticketVerifiedAt", "tickets", "status", "statusNote", "summary", "verifiedAt", "revisions", "verificationMethod", "sessionFacts",
    "programKey", "sourceUrl",
]
LIVE_FIELDS = EVENT_FIELDS + ["cloudReviewPending", "sourceRefs", "genre"]
LISTING_FIELDS = [
    "id", "title", "start", "end", "region", "venue", "address", "park", "price", "category", "summary", "url", "source", "sourceUid", "sourceVersion",
    "firstSeen", "lastSeen", "missingFromSource", "revisions", "verificationNote", "venueName", "venueStatus", "locations", "sourceLinkState",
    "sourceLinkCheckedAt", "sourceLinkType", "promoteUrl",
]
REVISION_FIELDS = ["title", "start", "end", "price", "lastSeen"]
LOCATION_FIELDS = ["id", "name", "region", "status"]
RACE_FIELDS = ["id", "name", "weekendStart", "weekendEnd", "source", "dataSource", "sourceTimezone", "sessions", "missingTimes", "lastSuccess", "status"]
RACE_SESSION_FIELDS = ["name", "start", "end"]
PLATFORM_FIELDS = ["name", "region", "kind", "description", "conditions", "verified", "links"]


def event_import() -> Contract:
    """chk_01: a reviewed event before it enters the snapshot of its source."""
    rules = Q.event_rules() | {"session_status": F.exists("sessions", lambda s: ~s["status"].isin(*V.EVENT_STATUSES))}
    return Contract(EVENT, rules, {"event_field": ("$", EVENT_FIELDS), "session_field": ("$.sessions", SESSION_FIELDS), "ticket_field": ("$.tickets", TICKET_FIELDS)})


def published_listing() -> Contract:
    """chk_02: a published exhibition, its URL reproducible from the link facts that it carries."""
    checked = [F.col("title"), F.col("url"), F.col("sourceLinkState"), F.col("sourceLinkCheckedAt")]
    again = venues.resolve_link(F.col("sourceUid"), F.col("title"), F.col("promoteUrl"), *checked)["url"]
    rules = Q.listing_rules() | {
        "location_name": F.exists("locations", lambda l: F.coalesce(F.length(l["name"]) == 0, F.lit(True))),
        "note_length": F.length("verificationNote") > 180,
        "url_provenance": (F.col("source") == "moc") & (again != F.col("url")),
    }
    fields = {"listing_field": ("$", LISTING_FIELDS), "location_field": ("$.locations", LOCATION_FIELDS), "revision_field": ("$.revisions", REVISION_FIELDS)}
    return Contract(LISTING, rules, fields, exact=("$.locations",), unique={"duplicate_id": "id"})


def published_live(kind: str = "kind", genre_kinds: tuple[str, ...] = ("concerts",)) -> Contract:
    """chk_03: a published live event; rows of ``genre_kinds`` have a known genre, others none."""
    twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    slot = lambda s: F.struct(s["date"], s["time"])
    offer = lambda t: F.struct(t["url"], t["price"], t["saleAt"])
    rules = event_import().rules | {
        "session_twice": twice(F.transform("sessions", slot)),
        "ticket_twice": twice(F.transform("tickets", offer)),
        "tickets_missing": F.col("tickets").isNull(),
        "ticket_unverified": (F.length("ticketUrl") > 0) & F.coalesce(F.length("ticketVerifiedAt") == 0, F.lit(True)),
        "ticket_button": (F.length("ticketUrl") > 0) & ~U.is_safe(F.col("ticketUrl"), ("https",)),
        "genre": F.when(F.col(kind).isin(*genre_kinds), ~F.coalesce(F.col("genre").isin(*V.GENRE_ORDER), F.lit(False))).otherwise(F.col("genre").isNotNull()),
    }
    return replace(event_import(), rules=rules, unique={"duplicate_id": "id"}, fields=event_import().fields | {"event_field": ("$", LIVE_FIELDS)})


def calendar(source_prefix: str, data_source: str, minimum: int = 15) -> Contract:
    """chk_04: the races of a season; ends of sessions are named and null."""
    day = lambda c: F.coalesce(~F.col(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.lit(True)) | F.col(c).try_cast("date").isNull()
    rules = Q.race_rules(source_prefix) | {
        "date_form": day("weekendStart") | day("weekendEnd"),
        "data_source": F.coalesce(F.col("dataSource") != data_source, F.lit(True)),
        "session_end": F.exists("sessions", lambda s: s["end"].isNotNull()),
    }
    fields = {"race_field": ("$", RACE_FIELDS), "session_field": ("$.sessions", RACE_SESSION_FIELDS)}
    return Contract(RACE, rules, fields, exact=("$", "$.sessions"), unique={"duplicate_id": "id"}, minimum=minimum)


def platforms(hosts: list[str]) -> Contract:
    """chk_04: viewing platforms, linked to known hosts only."""
    known = lambda l: U.is_safe(l["url"], ("https",)) & U.host(l["url"]).isin(*hosts)
    return Contract("id string, " + PLATFORM, {"link_host": F.exists("links", lambda l: ~F.coalesce(known(l), F.lit(False)))}, {"platform_field": ("$", PLATFORM_FIELDS)}, exact=("$",))
