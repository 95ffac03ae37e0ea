"""Ladders: kinds, genres, venues, links, badges, sale times."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.functions import values as V
from marquee.operators import classify as C, venues as VN


def decide(spark, kind, text, reviewed=None, category=None):
    df = spark.createDataFrame([(text, reviewed, category)], "t string, r string, c string")
    d = df.select(C.classify(kind, F.col("t"), F.col("r"), F.col("c")).alias("d")).first()["d"]
    return d["decision"], d["reason"]


def test_comedy(spark):
    assert decide(spark, "comedy", "Riverside Comedy Night")[0] == "included"
    assert decide(spark, "comedy", "Tides, a stand-up special")[0] == "included"
    assert decide(spark, "comedy", "No genre", "comedy") == ("included", "OFFICIAL_REVIEWED_FORMAT")
    assert decide(spark, "comedy", "No genre", "concerts") == ("excluded", "OTHER_REVIEWED_FORMAT")
    for text in ("Stand-up workshop", "Comedy Musical", "單口喜劇課程"):
        assert decide(spark, "comedy", text) == ("excluded", "COURSE_OR_MUSICAL")
    assert decide(spark, "comedy", "相聲失控") == ("excluded", "OTHER_PERFORMANCE_FORMAT")
    assert decide(spark, "comedy", "A generic show") == ("pending", "INSUFFICIENT_STANDUP_EVIDENCE")


def test_concerts(spark):
    assert decide(spark, "concerts", "Fan Meeting", category="17") == ("excluded", "FAN_MEETING_OR_UPGRADE")
    assert decide(spark, "concerts", "X", category="17") == ("included", "CONCERT_EVIDENCE")
    assert decide(spark, "concerts", "新年音樂會") == ("included", "CONCERT_EVIDENCE")
    assert decide(spark, "concerts", "看live夜") == ("pending", "INSUFFICIENT_CONCERT_EVIDENCE")
    assert decide(spark, "concerts", "國家歌劇院 演唱會")[0] == "included"


GENRES = {
    "夏夜樂團 World Tour": "流行／搖滾演唱會", "晨星弦樂與馬勒第二號": "古典／室內樂", "林小河鋼琴獨奏會": "古典／室內樂",
    "春之國樂作品音樂會": "國樂／傳統", "古琴夜譚音樂會": "國樂／傳統", "海岸合唱團歌聲": "合唱／聲樂", "港都爵士大樂隊": "爵士", "秋日音樂會": "其他音樂會",
}


def test_genres(spark):
    df = spark.createDataFrame([(t,) for t in GENRES], "t string")
    got = {r["t"]: r["g"] for r in df.select("t", C.genre(F.col("t")).alias("g")).collect()}
    assert got == GENRES


def venue(spark, name="", address="", region="臺北市", park="", title="測試活動"):
    df = spark.createDataFrame([(title, name, address, region, park)], "title string, venue string, address string, region string, park string")
    return VN.group_venues(df).first()


def test_places_are_one_by_region_name_and_street(spark):
    at = lambda name, street, region: venue(spark, name, street, region)["venueId"]
    same = {at("河岸館", "臺南市東區一路7號", "臺南市"), at("河岸館", "臺南市東區一路7號", "臺南市")}
    other = {at("河岸館", "臺南市東區一路7號", "臺中市"), at("河岸館", "臺南市西區三路7號", "臺南市"), at("湖畔館", "臺南市東區一路7號", "臺南市")}
    assert len(same) == 1 and len(other) == 3 and not same & other


def test_place_states(spark):
    assert venue(spark, "河岸館", "臺南市東區一路7號", "臺南市")["venueStatus"] == "named"
    assert venue(spark)["venueStatus"] == "missing"
    assert venue(spark, "東區（臺南市）=", "臺南市東區", "臺南市")["venueStatus"] == "uncertain"
    assert venue(spark, "木刻展", "三路8號", title="木刻展")["venueStatus"] == "address"
    online = venue(spark, "《海風》線上展", "臺南市一路2號", "臺南市")
    assert online["venueStatus"] == "online" and "無實體" in online["venueName"]


UID = "0123456789abcdef01234567"
PAGE = f"https://{V.CULTURE_HOST}{V.CULTURE_PATH}?method=%s&uid={UID}"
OWN = "https://gallery.example.org/woodcuts"


def link(spark, uid=UID, title="木刻展", promote="", checked=(None, None, None, None)):
    df = spark.createDataFrame([(uid, title, promote, *checked)], "u string, t string, p string, ct string, cu string, cs string, ca string")
    cols = [F.col(x) for x in ("u", "t", "p", "ct", "cu", "cs", "ca")]
    return df.select(VN.resolve_link(*cols).alias("l")).first()["l"].asDict()


def test_a_checked_page_counts_for_its_own_title_only(spark):
    checked = ("木刻展", PAGE % "showEventDetail", "verified", "2025-02-03")
    assert link(spark, checked=checked) == {"url": checked[1], "state": "verified", "checkedAt": "2025-02-03", "type": "culture"}
    assert link(spark, title="版畫展", checked=checked)["type"] == "dataset"
    assert link(spark, checked=("木刻展", PAGE % "list", "verified", ""))["state"] == "unavailable"


@pytest.mark.parametrize("host", ["who:knows@" + V.CULTURE_HOST, V.CULTURE_HOST + ":99"])
def test_a_checked_page_has_no_credentials_or_port(spark, host):
    url = (PAGE % "showEventDetail").replace(V.CULTURE_HOST, host)
    assert link(spark, checked=("木刻展", url, "verified", ""))["state"] == "unavailable"


def test_the_providers_own_page(spark):
    assert link(spark, promote=OWN, checked=("木刻展", OWN, "verified", ""))["state"] == "verified"
    assert link(spark, promote=OWN)["state"] == "source-provided"
    assert link(spark, uid="short", promote=OWN)["state"] == "invalid-id"
    for bad in ("ftp://gallery.example.org/x", OWN.replace("//", "//who:knows@"), V.DATASET_URL):
        assert link(spark, promote=bad)["url"] == V.DATASET_URL


def test_badges(spark):
    day = F.lit("2026-11-17").cast("date")
    rows = [
        ("a", dt.date(2026, 11, 1), dt.date(2026, 11, 17), None), ("b", dt.date(2026, 11, 1), None, None), ("c", None, dt.date(2026, 11, 16), None),
        ("d", dt.date(2026, 11, 18), dt.date(2027, 1, 1), None), ("e", dt.date(2026, 11, 1), dt.date(2027, 1, 1), None), ("f", None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "k string, s date, e date, n string")
    got = {r["k"]: r["b"] for r in df.select("k", C.badge(F.col("s"), F.col("e"), F.col("n"), day).alias("b")).collect()}
    assert got == {"a": V.BADGE_ENDING, "b": V.BADGE_UNKNOWN, "c": V.BADGE_ENDED, "d": V.BADGE_UPCOMING, "e": V.BADGE_RUNNING, "f": V.BADGE_NOTE}


def test_sale_conflict(spark):
    rows = [("2026-10-01", False, "一般開賣時間未公布"), ("2026-10-01", False, ""), (None, True, "一般開賣：未提供。"), (None, False, "一般開賣時間未公布"), ("x", False, "一般開賣。未公布")]
    df = spark.createDataFrame(rows, "s string, t boolean, n string")
    assert [r[0] for r in df.select(C.sale_conflict(F.col("s"), F.col("t"), F.col("n"))).collect()] == [True, False, True, False, False]
