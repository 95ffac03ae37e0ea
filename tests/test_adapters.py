"""Per-source rules: unlike pages give the same facts, by registry rows alone."""

import datetime as dt

from marquee.functions import values as V
from marquee.operators import adapters as A

SOURCES = [("s1", "Hall One", "r1", "a1", "iso"), ("s2", "Hall Two", "r2", "a2", "year_day"), ("s3", "Hall Three", "r3", "a3", "edges"), ("s4", "No rules", "r4", "a4", "iso")]
RULES = [
    ("s1", "title", r'(?s)<p class="inner">(.*?)</p>'), ("s1", "date", r"(\d{4}-\d{2}-\d{2})"), ("s1", "venue", r'<p class="place">(.*?)</p>'), ("s1", "period", r'<p class="date">(.*?)</p>'),
    ("s2", "title", r"<h1>(.*?)</h1>"), ("s2", "year", r'<span class="y">(\d{4})</span>'), ("s2", "day", r'<span class="md">([\d.]+)</span>'), ("s2", "venue", r"<h3>at</h3><i>(.*?)</i>"),
    ("s3", "title", r"<h1>(.*?)</h1>"), ("s3", "start_year", r'<b class="sy">(.*?)</b>'), ("s3", "start_day", r'<b class="sd">(.*?)</b>'), ("s3", "end_year", r'<b class="ey">(.*?)</b>'), ("s3", "end_day", r'<b class="ed">(.*?)</b>'),
]
PAGES = [
    (1, "s1", '<p class="inner">A &amp; B</p><p class="date">2026-01-05 ~ 2026-02-01</p><p class="place">Hall One · Room 1</p>', None, None, None),
    (2, "s1", '<p class="inner">C</p><p class="date">2026-01-05 起</p><p class="place">Room 2</p>', None, "free", "50"),
    (3, "s1", '<p class="inner">D</p><p class="date">2026-01-05</p><p class="place">Room 2</p>', None, None, "50"),
    (4, "s2", '<h1>E</h1><span class="y">2025</span><span class="md">12.30</span><span class="y">2026</span><span class="md">1.4</span><h3>at</h3><i>Yard</i>', None, "paid", None),
    (5, "s2", '<h1>F</h1><span class="y">2025</span><span class="md">12.30</span><h3>at</h3><i>Yard</i>', None, None, V.DETAIL_UNCHECKED + "x"),
    (6, "s3", '<h1>G</h1><b class="sy">2026</b><b class="sd">3.1</b><b class="ey">2026</b><b class="ed"></b>', "Hall Three · Deck", None, None),
    (7, "s3", "<h1>H</h1>", None, None, None),
    (8, "s1", '<p class="inner"> </p>', "x", None, None),
    (9, "s4", "<h1>I</h1>", "x", None, None),
    (10, "s9", "<h1>J</h1>", "x", None, None),
    (11, "s1", '<p class="inner">K</p><p class="date">2026-13-05</p>', "x", None, None),
    (12, "s3", None, "x", None, None),
]


def facts(spark, pages=PAGES):
    registry = A.registry(spark.createDataFrame(SOURCES, "source string, name string, region string, address string, dates string"), spark.createDataFrame(RULES, "source string, field string, pattern string"))
    df = spark.createDataFrame(pages, "page long, source string, html string, venue_hint string, badge string, prior_price string")
    return {r["page"]: r for r in A.detail_facts(df, registry).collect()}


def test_facts_of_unlike_sources(spark):
    got = facts(spark)
    d = lambda *x: dt.date(*x)
    assert {p: (r["title"], r["start"], r["end"], r["venue"]) for p, r in got.items() if r["reason"] is None} == {
        1: ("A & B", d(2026, 1, 5), d(2026, 2, 1), "Hall One · Room 1"), 2: ("C", d(2026, 1, 5), None, "Hall One · Room 2"),
        3: ("D", d(2026, 1, 5), d(2026, 1, 5), "Hall One · Room 2"), 4: ("E", d(2025, 12, 30), d(2026, 1, 4), "Hall Two · Yard"),
        5: ("F", d(2025, 12, 30), None, "Hall Two · Yard"), 6: ("G", d(2026, 3, 1), None, "Hall Three · Deck"),
    }
    assert {p: r["reason"] for p, r in got.items() if r["reason"]} == {7: "missing title or venue", 8: "missing title or venue", 11: "bad date", 12: "missing title or venue"}
    assert [got[p]["price"] for p in (1, 2, 3, 4, 5)] == [V.DETAIL_UNKNOWN, V.DETAIL_FREE, V.DETAIL_LAST_REVIEW + "50", V.DETAIL_PAID, V.DETAIL_UNCHECKED + "x"]
    assert got[4]["region"] == "r2" and got[4]["address"] == "a2"


def test_no_pages(spark):
    assert facts(spark, [p for p in PAGES if p[0] > 20] or [(1, "none", "", None, None, None)]) == {}
