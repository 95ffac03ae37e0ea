"""Venue grouping (cls_03), venue and program identity (fn_14), link provenance (cls_04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions import text as T, urls as U, values as V
from marquee.operators.classify import ladder


def group_venues(df: DataFrame, exact: bool = True) -> DataFrame:
    """cls_03: adds venueName, venueStatus, venueId and locations; venue and address are tidied.

    Input columns: title, venue, address, region, park.
    """
    df = (
        df.withColumn("venue", T.tidy(F.col("venue"), exact))
        .withColumn("address", T.tidy(F.col("address"), exact))
        .withColumn("_title", T.tidy(F.col("title"), exact))
    )
    venue, address, park = F.col("venue"), F.col("address"), T.or_empty(F.col("park"))
    region = F.when(F.length(F.col("region")) > 0, F.col("region")).otherwise(F.lit(V.REGION_UNKNOWN))
    is_park = park.isin(*V.PARK_NAMES)
    is_online = venue.contains("線上") & venue.contains("展")
    no_place = (venue == "") | (T.place_key(venue) == T.place_key(F.col("_title")))
    # Tidied text may have ASCII or full-width brackets, depending on the exact flag.
    is_district = venue.rlike(r"^.+[鄉鎮市區][(（].+[市縣][)）]=?$")

    aliases = [(venue.rlike(p), F.lit(n)) for p, n in V.VENUE_ROOM_PATTERNS]
    aliases.append((T.place_key(venue) == V.VENUE_KING_CAR, F.lit(V.VENUE_KING_CAR)))
    aliases += [(venue == k, F.lit(n)) for k, n in V.VENUE_EXACT.items()]
    grouped = ladder(aliases, venue)

    name = ladder(
        [
            (is_park, T.lookup(park, V.PARK_NAMES)),
            (is_online, F.lit(V.VENUE_ONLINE)),
            (no_place & (address != ""), F.concat(F.lit("地址地點："), address)),
            (no_place, F.lit(V.VENUE_MISSING)),
            (is_district, F.concat(F.lit("地點待確認（"), F.regexp_extract(venue, r"^([^(（]*)", 1), F.lit("）"))),
        ],
        grouped,
    )
    status = ladder(
        [
            (is_park, F.lit("named")),
            (is_online, F.lit("online")),
            (no_place & (address != ""), F.lit("address")),
            (no_place, F.lit("missing")),
            (is_district, F.lit("uncertain")),
        ],
        F.lit("named"),
    )
    # Floors are left out of the identity only; the address column keeps them.
    floorless = F.trim(F.regexp_replace(address, r"(?:\d+F|\d+樓|[一二三四五六七八九十]+樓).*$", ""))
    street = ladder(
        [
            (is_park | is_online, F.lit("")),
            (no_place | is_district, address),
            (
                (grouped == V.VENUE_KING_CAR) & floorless.contains(V.VENUE_KING_CAR_STREET),
                F.lit(V.VENUE_KING_CAR_STREET),
            ),
        ],
        floorless,
    )
    identity = F.when(is_park & (region == T.lookup(park, V.PARK_REGION)), park)
    out = df.withColumn("venueName", name).withColumn("venueStatus", status).withColumn("_street", street)
    venue_id = F.coalesce(
        identity,
        F.concat(
            F.lit("venue-"),
            T.stable_id(region, T.place_key(F.col("venueName")), T.place_key(F.col("_street")), length=16),
        ),
    )
    out = out.withColumn("venueId", venue_id)
    location = F.struct(
        F.col("venueId").alias("id"), F.col("venueName").alias("name"), region.alias("region"),
        F.col("venueStatus").alias("status"),
    )
    return out.withColumn("locations", F.array(location)).drop("_street", "_title")


def venue_identity(venue: Column, exact: bool = False) -> Column:
    """fn_14: venue key; one reviewed building drops its English name."""
    stripped = F.when(
        venue.contains("西門紅樓"), F.regexp_replace(venue, r"(?i)The\s+Red\s+House", "")
    ).otherwise(venue)
    return T.normalized_exact(stripped) if exact else T.normalized(stripped)


def program_identity(title: Column, program_key: Column | None = None) -> Column:
    """fn_14: declared program key, else the fixed title rules; NULL when neither."""
    folded = T.casefold(title)
    rules = [
        F.when(title.contains(mark) & folded.contains(phrase), F.lit(key))
        for key, mark, phrase in V.PROGRAM_RULES
    ]
    declared = [] if program_key is None else [F.when(F.length(program_key) > 0, program_key)]
    return F.coalesce(*declared, *rules)


def resolve_link(
    uid: Column, title: Column, promote: Column,
    checked_title: Column, checked_url: Column, checked_state: Column, checked_at: Column,
    valid_uid: Column | None = None,
) -> Column:
    """cls_04: struct(url, state, checkedAt, type) by the provenance ladder.

    Verified page, then the URL given by the provider, then the dataset page. The checked
    columns come from a left join of the link-check table on the uid.
    """
    ok_uid = F.coalesce(uid.rlike("^[0-9a-f]{24}$") if valid_uid is None else valid_uid, F.lit(False))
    url, offered = T.or_empty(checked_url), T.or_empty(promote)
    q = U.query(url)
    pair = F.concat(F.lit("uid="), uid)
    culture = (
        (U.scheme(url) == "https")
        & (F.lower(U.authority(url)) == V.CULTURE_HOST)
        & (U.path(url) == V.CULTURE_PATH)
        & ((q == F.concat(F.lit("method=showEventDetail&"), pair)) | (q == F.concat(pair, F.lit("&method=showEventDetail"))))
    )
    promoted = (url == offered) & U.is_safe(url)
    verified = ok_uid & (culture | promoted) & (checked_state == "verified") & (checked_title == title)
    provided = ok_uid & U.is_safe(offered) & (offered != V.DATASET_URL)

    def link(u, state, at, kind):
        return F.struct(u.alias("url"), state.alias("state"), at.alias("checkedAt"), kind.alias("type"))

    at = T.or_empty(checked_at)
    return ladder(
        [
            (verified, link(url, F.lit("verified"), at, F.when(culture, F.lit("culture")).otherwise(F.lit("promote")))),
            (provided, link(offered, F.lit("source-provided"), F.lit(""), F.lit("promote"))),
        ],
        link(
            F.lit(V.DATASET_URL),
            F.when(ok_uid, F.lit("unavailable")).otherwise(F.lit("invalid-id")),
            at,
            F.lit("dataset"),
        ),
    )
