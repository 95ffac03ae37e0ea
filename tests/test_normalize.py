"""Provider rows, snapshot merge and the builds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee import schemas as S
from marquee.functions import values as V
from marquee.operators import normalize as N, snapshot as P, tickets as K
from marquee.plans import builds
from marquee.sources.readers import unify_spellings

NOW = "2026-10-06T07:40:00+08:00"


def exhibition(uid="row-9", title="河邊木刻展", start="2026/10/03", end="2026/10/24", on_sales="N", category="6", shows=None, promote=None):
    shows = shows if shows is not None else [dict(time=start + " 10:00:00", endTime=end + " 18:00:00", location="台北市士林區", locationName="河岸館", price=None, onSales=on_sales)]
    return dict(UID=uid, version="2.0", title=title, category=category, startDate=None, endDate=None, showUnit=None, descriptionFilterHtml=None, sourceWebPromote=promote, showInfo=shows)


def raw(spark, rows):
    df = spark.createDataFrame([dict(r, ord=i) for i, r in enumerate(rows)], "ord bigint, " + S.PROVIDER_ROW)
    return unify_spellings(df)


def links(spark, rows=()):
    return spark.createDataFrame(list(rows), S.LINK_CHECK)


def run(spark, rows, **kw):
    return N.exhibitions(raw(spark, rows), links(spark), **kw)


def test_collapse_and_region(spark):
    events, verdicts = run(spark, [exhibition(), exhibition()])
    got = events.collect()
    assert len(got) == 1 and got[0]["region"] == "臺北市" and got[0]["price"] == V.PRICE_FREE
    assert verdicts.where("reject_reason IS NOT NULL").count() == 0


def test_rejections(spark):
    rows = [exhibition(end="2026/09/01"), exhibition(title=None), exhibition(title=""), exhibition(category="17"), exhibition(shows=[]), exhibition(start="bad")]
    events, verdicts = run(spark, rows)
    assert events.count() == 0
    assert [r["reject_reason"] for r in verdicts.orderBy("ord").collect()] == [
        "REVERSED_DATES", "MISSING_REQUIRED_FIELD", "CATEGORY_OR_TITLE_INVALID", "CATEGORY_OR_TITLE_INVALID", "MISSING_VENUE", "INVALID_DATE_OR_VALUE"]


def test_shows_before_a_bad_one_stay_unless_strict(spark):
    good = exhibition()["showInfo"][0]
    rows = [exhibition(shows=[good, dict(good, endTime="2026/01/01"), dict(good, locationName="B")])]
    assert [r["venue"] for r in run(spark, rows)[0].collect()] == ["河岸館"]
    assert run(spark, rows, strict=True)[0].count() == 0


def test_missing_price_is_not_free(spark):
    assert "未提供" in run(spark, [exhibition(on_sales="Y")])[0].first()["price"]


def empty_previous(spark, events):
    cols = {"firstSeen": "string", "lastSeen": "string", "missingFromSource": "boolean", "revisions": "array<struct<title:string,start:date,end:date,price:string,lastSeen:string>>"}
    out = events.limit(0)
    for c, t in cols.items():
        out = out.withColumn(c, F.lit(None).cast(t))
    return out


def test_history_revisions_and_disappearance(spark):
    a = run(spark, [exhibition()])[0]
    b = run(spark, [exhibition(end="2026/11/01")])[0]
    one = P.merge_listings(empty_previous(spark, a), a, "2026-10-01")
    two = P.merge_listings(one, a, "2026-10-02")
    r = two.first()
    assert (r["firstSeen"], r["lastSeen"], len(r["revisions"])) == ("2026-10-01", "2026-10-02", 0)
    three = P.merge_listings(two, b, "2026-10-03").collect()
    assert len(three) == 1 and three[0]["firstSeen"] == "2026-10-01"
    assert three[0]["revisions"][0]["end"] == dt.date(2026, 10, 24) and three[0]["end"] == dt.date(2026, 11, 1)
    gone = P.merge_listings(two, a.limit(0), "2026-10-03").collect()
    assert len(gone) == 1 and gone[0]["missingFromSource"] is True


def curated_row(spark, events, **kw):
    cols = {c: F.lit(kw.get(c)).cast(events.schema[c].dataType) for c in events.columns}
    return spark.range(1).select(*[v.alias(c) for c, v in cols.items()])


def test_build_guards_and_curated(spark):
    rows = [exhibition(uid=f"{i}", title=f"展{i}", end="2099/01/01") for i in range(30)]
    first = run(spark, rows)[0]
    state = empty_previous(spark, first)
    curated = curated_row(spark, state, id="c", source="pier2", sourceUid="3", title="Official", region="高雄市", venue="駁二", address="", price="免費", url="https://p.example/a", firstSeen="2026-10-01", lastSeen="2026-10-02", missingFromSource=False)
    b1 = builds.exhibitions(raw(spark, rows), state, curated, links(spark), NOW)
    assert b1.state == "ok" and b1.counts["eventCount"] == 30
    out = b1.events.collect()
    assert len(out) == 30 and [r["title"] for r in out if r["sourceUid"] == "3"] == ["Official"]
    assert all(len(r["locations"]) == 1 for r in out)
    saved = b1.events.select(*state.columns)
    b2 = builds.exhibitions(raw(spark, rows[:2]), saved, curated, links(spark), "2026-10-07T09:00:00+08:00")
    assert (b2.state, b2.reason) == ("error", "SOURCE_LOSS_OVER_50_PERCENT")
    assert b2.events.where("source = 'moc'").count() == 29
    b3 = builds.exhibitions(raw(spark, rows[:7] + [exhibition(uid=f"x{i}", category="9") for i in range(3)]), state, curated, links(spark), NOW)
    assert b3.reason == "REJECTION_RATE_OVER_20_PERCENT"
    b4 = builds.exhibitions(raw(spark, []), saved, curated, links(spark), NOW)
    assert b4.reason == "EMPTY_INPUT" and b4.events.where("source = 'moc'").count() == 29


def live_row(uid="x", time="2026/11/01 18:15:00", venue="A", price="", title="海風演唱會", category="17", extra=()):
    shows = [dict(time=t, endTime=None, location="台北市大安區", locationName=venue, price=p, onSales=None) for t, p in [(time, price), *extra]]
    return dict(exhibition(uid=uid, title=title, category=category, shows=shows))


def live_events(spark, rows, kind="concerts"):
    return N.live(raw(spark, rows), kind)


def test_live_sessions_and_price(spark):
    r = live_row(extra=[("2026/11/01 18:15:00", ""), ("2026/11/02 19:00:00", "")])
    got = live_events(spark, [r, r])[0].collect()
    assert len(got) == 1 and len(got[0]["sessions"]) == 2 and got[0]["price"] is None and got[0]["region"] == "臺北市"
    for prices, want in (((None, "5"), V.PRICE_MIXED), (("5", None), "5"), (("5", "5"), "5"), (("5", "6"), V.PRICE_MIXED)):
        r = live_row(price=prices[0], extra=[("2026/11/02 19:00:00", prices[1])])
        assert live_events(spark, [r])[0].first()["price"] == want


def test_live_decisions(spark):
    rows = [live_row(), live_row(uid="", title="演唱會 2"), live_row(category="11"), live_row(title="Fan Meeting"), live_row(title="�")]
    got = [(r["decision"], r["reason"]) for r in live_events(spark, rows)[1].orderBy("ord").collect()]
    assert got == [("included", "CONCERT_EVIDENCE"), ("failed", "INVALID_PROVIDER_FACTS"), ("excluded", "OTHER_CATEGORY"),
                   ("excluded", "FAN_MEETING_OR_UPGRADE"), ("failed", "INVALID_PROVIDER_FACTS")]


def snapshot(spark, rows):
    e = live_events(spark, rows)[0]
    return e.withColumn("statusNote", F.lit(None).cast("string")).withColumn(
        "revisions", F.expr("cast(array() as array<struct<at:string,note:string,previousSessions:array<struct<date:date,time:string>>>>)"))


def test_live_status(spark):
    before = snapshot(spark, [live_row()])
    moved = P.merge_live(before, snapshot(spark, [live_row(time="2026/11/02 20:00:00")]), NOW).collect()
    assert len(moved) == 1 and moved[0]["status"] == "changed" and len(moved[0]["revisions"]) == 1
    again = P.merge_live(P.merge_live(before, snapshot(spark, [live_row(time="2026/11/02 20:00:00")]), NOW), snapshot(spark, [live_row(time="2026/11/02 20:00:00")]), NOW).first()
    assert again["status"] == "changed" and len(again["revisions"]) == 1
    other = P.merge_live(before, snapshot(spark, [live_row(venue="B")]), NOW)
    assert {r["venue"]: r["status"] for r in other.collect()} == {"A": "unconfirmed", "B": "scheduled"}
    past = P.merge_live(before, before.limit(0), "2027-01-01T00:00:00+08:00").first()
    assert past["status"] == "scheduled"


def test_live_provider_guards(spark):
    before = snapshot(spark, [live_row()])
    assert builds.live_provider(raw(spark, []), before, "concerts", NOW)[2] == "EMPTY_INPUT"
    assert builds.live_provider(raw(spark, [live_row(category="11")]), before, "concerts", NOW)[2] == "UNEXPECTED_CATEGORY"
    events, _, reason = builds.live_provider(raw(spark, [live_row(title="�")]), before, "concerts", NOW)
    assert reason == "MALFORMED_RECORDS" and events.count() == 1
    events, _, reason = builds.live_provider(raw(spark, [live_row(time="2026/11/05 19:00:00")]), before, "concerts", NOW)
    assert reason is None and events.first()["status"] == "changed"


def test_nested_tickets(spark):
    s = "struct<date:string,time:string>"
    schema = f"sessions array<{s}>, tickets array<struct<platform:string,url:string,checkedAt:string,sessions:array<{s}>,price:string,saleAt:string>>"
    one = ("2026-11-01", "19:00")
    t = (None, "https://deck.kktix.cc/events/night", "2026-10-06", [one, one], "500", None)
    rows = [([one], [t, t, (None, "https://tixcraft.com/", "2026-10-06", [one], None, None), (None, "javascript:alert(1)", "2026-10-06", [one], None, None),
                     (None, t[1], "2026-10-06", [("2026-11-02", "19:00")], "500", None)])]
    out = K.normalize_nested(spark.createDataFrame(rows, schema)).first()["tickets"]
    assert len(out) == 1 and out[0]["platform"] == "KKTIX" and [tuple(x) for x in out[0]["sessions"]] == [one]


def test_live_build_reconciles(spark):
    base = snapshot(spark, [live_row()]).withColumns({
        "sourceUrl": F.lit("https://data.gov.tw/dataset/6013"),
        "tickets": F.expr("cast(array() as array<struct<platform:string,url:string,checkedAt:string,sessions:array<struct<date:date,time:string>>,price:string,saleAt:string>>)"),
        "pos": F.lit(0).cast("bigint"),
    })
    manual = base.withColumn("source", F.lit("manual")).withColumn("id", F.lit("m")).withColumn("region", F.lit("台北市"))
    out = builds.live([manual, base], "concerts")
    e = out["events"].collect()
    assert len(e) == 1 and e[0]["id"] == "m" and e[0]["records"] == 2 and e[0]["genre"] == "流行／搖滾演唱會"
    assert out["refs"].count() == 2 and out["sessions"].count() == 1


def test_reviewed_import(spark):
    rows = [("one", True, {"title": "Riverside English Stand-up Comedy"}, "1"), ("p", False, {"title": "Riverside English Stand-up Comedy"}, "1"), ("c", True, {"title": "Stand-up workshop"}, "1")]
    items = spark.createDataFrame(rows, "sourceUid string, officialFactsReviewed boolean, evidence map<string,string>, page_id string")
    _, counts = builds.import_reviewed(items, "comedy", None)
    r = counts.first()
    assert (r["discovered"], r["included"], r["excluded"], r["pending"], r["failed"]) == (3, 1, 1, 1, 0)
