"""Reconciliation against a plain sequential model of its rule."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from marquee.operators import components as CC, reconcile as R

SCHEMA = (
    "ord bigint, source string, uid string, title string, region string, venue string, program string,"
    " sessions array<struct<date:date,time:string>>, urls array<string>, page string"
)


def sequential(records):
    """The rule read literally, one record at a time."""
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    clusters = []
    for ord_, source, uid, title, region, venue, program, sessions, urls, page in sorted(records, key=lambda r: r[0]):
        me = dict(region=norm(region), venue=norm(venue), title=norm(title), program=program, refs={(source, uid)} if uid else set(),
                  sessions=set(sessions), urls=set(urls), cited={*urls, *([page] if page else [])}, members=[ord_])
        for c in clusters:
            if c["region"] != me["region"]:
                continue
            common = c["sessions"] & me["sessions"]
            if c["venue"] != me["venue"]:
                fits = c["title"] == me["title"] and any(t for _, t in common)
            else:
                a, b = c["title"], me["title"]
                alike = a == b or bool(c["urls"] & me["cited"]) or (min(len(a), len(b)) >= 8 and (a in b or b in a))
                fits = bool(c["refs"] & me["refs"]) or bool(program and program == c["program"]) or (
                    alike and bool(common) and me["venue"] not in ("unknown", ""))
            if fits:
                for k in ("sessions", "urls", "refs"):
                    c[k] |= me[k]
                c["members"].append(ord_)
                break
        else:
            me["urls"] = set(me["cited"])
            clusters.append(me)
    return {m: c["members"][0] for c in clusters for m in c["members"]}


def random_records(seed, n):
    rnd = random.Random(seed)
    titles = ["long evening show", "the long evening show part two", "Other", "evening", "long evening"]
    out = []
    for i in range(n):
        sessions = list({(dt.date(2026, 11, rnd.randint(1, 2)), rnd.choice(["19:00", None])) for _ in range(rnd.randint(1, 2))})
        out.append((
            i, rnd.choice("ab"), rnd.choice(["1", "2", "3", None, "4", "5", str(i)]), rnd.choice(titles), rnd.choice(["r1", "r2", "r3"]),
            rnd.choice(["Hall A", "Hall　A", "B", "unknown"]), rnd.choice([None, None, None, None, "p"]), sessions,
            [rnd.choice(["u1", "u2", "u3", f"x{i}"]) for _ in range(rnd.randint(0, 2))],
            rnd.choice([None, "u1", "u2", f"y{i}"]),
        ))
    return out


def test_equals_the_sequential_scan(spark):
    # Many independent inputs in one run: the region carries the number of the input.
    records = []
    for k in range(150):
        for r in random_records(k, 12):
            records.append((k * 100 + r[0], *r[1:4], f"{r[4]}x{k}", *r[5:]))
    got = {r["ord"]: r["cluster"] for r in R.clusters(spark.createDataFrame(records, SCHEMA).repartition(7), exact=True).collect()}
    want = {}
    for k in range(150):
        want |= sequential([r for r in records if r[0] // 100 == k])
    assert got == want
    assert len(set(want.values())) < len(want)


def test_hot_group_of_copies(spark):
    day = dt.date(2026, 11, 1)
    copies = [(i, "s", f"u{i}", "the same show title", "r", "Hall", None, [(day, "19:00")], [f"x{i}"], None) for i in range(3000)]
    homeless = [(10_000 + i, "s", f"v{i}", "nowhere show", "r", "unknown", None, [(day, "20:00")], [], None) for i in range(50)]
    # A record elsewhere with a title and time of the homeless copies, between them.
    bridge = [(10_010_5 // 10, "t", "w", "nowhere show", "r", "Place", None, [(day, "20:00")], [], None)]
    records = [r for r in copies + homeless if r[0] != 10_010] + bridge
    df = spark.createDataFrame(records, SCHEMA)
    _, sigs = R.signatures(R.features(df, exact=False))
    assert sigs.count() == 3
    got = {r["ord"]: r["cluster"] for r in R.clusters(df, exact=False).collect()}
    assert got == sequential(records)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 201)]
    got = {r["node"]: r["part"] for r in CC.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[103] == got[100] == 100 and got[201] == 200


def test_star_edges_are_linear(spark):
    rows = [(i, 7) for i in range(1000)] + [(5000, 8)]
    assert CC.star_edges(spark.createDataFrame(rows, "node bigint, key bigint")).count() == 999


def test_merge_keeps_status_facts_and_references(spark):
    day = dt.date(2025, 4, 5)
    schema = ("ord long, source string, uid string, title string, sessions array<struct<date:date,time:string,status:string>>, urls array<string>, page string, "
              "sessionFacts array<struct<date:date,time:string,host:string>>, sourceRefs array<struct<source:string,uid:string>>")
    rows = [(1, "a", "1", "t", [(day, "19:00", "cancelled")], [], None, [], [("z", "9")]), (2, "b", "2", "t", [(day, "19:00", None), (day, "21:00", None)], [], None, [(day, "21:00", "Kim")], None)]
    members = spark.createDataFrame([(1, 1), (2, 1)], "ord long, cluster long")
    out = R.merged(spark.createDataFrame(rows, schema), members)
    assert {(r["time"], r["status"]) for r in out["sessions"].collect()} == {("19:00", "cancelled"), ("21:00", None)}
    assert [(r["time"], r["host"]) for r in out["facts"].collect()] == [("21:00", "Kim")]
    assert {(r["source"], r["uid"]) for r in out["refs"].collect()} == {("a", "1"), ("b", "2"), ("z", "9")}


def test_one_large_component(spark):
    """A chain through pages and times, a crowd at one time, and repeated turns of choice, all linked."""
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    n = 1000
    chain = [(i, "s", f"c{i}", f"t{i}", "r", "Hall", None, [(day(i), "19:00"), (day(i + 1), "19:00")], [f"u{i}", f"u{i + 1}"], None) for i in range(n)]
    crowd = [(n + i, "s", f"d{i}", "crowd", "r", f"Place {i % 50}", None, [(day(0), "20:00"), (day(i), "21:00")], [], None) for i in range(n)]
    # Title and page change in turn: a record that leaves its own cluster lets the next one keep its own.
    turns = [(2 * n + i, "s", f"e{i}", f"w{(i + 1) // 2}", "r", "Hall", None, [(day(i // 2), "18:00"), (day(i // 2 + 1), "18:00")], [f"v{i // 2}"], None) for i in range(8)]
    records = chain + crowd + turns
    got = {r["ord"]: r["cluster"] for r in R.clusters(spark.createDataFrame(records, SCHEMA).repartition(5), exact=False).collect()}
    assert got == sequential(records)
    assert {got[i] for i in range(n)} == {0}


def test_no_task_holds_a_component(spark):
    records = random_records(5, 40)
    plan = R.clusters(spark.createDataFrame(records, SCHEMA), exact=False)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "PythonUDF" not in plan


def test_later_rounds_decide_only_where_givers_changed(spark, monkeypatch):
    """Turns of choice take several rounds; records that share nothing with them choose in the first two only."""
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    turns = [(i, "s", f"e{i}", f"w{(i + 1) // 2}", "r", "Hall", None, [(day(i // 2), "18:00"), (day(i // 2 + 1), "18:00")], [f"v{i // 2}"], None) for i in range(8)]
    quiet = [(100 + i, "s", f"q{i}", f"quiet {i // 2}", "r", "Hall", None, [(day(i % 2), "20:00"), (day(2), "20:00")], [], None) for i in range(200)]
    asked, decided = [], R._decided
    monkeypatch.setattr(R, "_decided", lambda gone, s, asks, *a: asked.append(asks.select("node").distinct().count()) or decided(gone, s, asks, *a))
    got = {r["ord"]: r["cluster"] for r in R.clusters(spark.createDataFrame(turns + quiet, SCHEMA), exact=False).collect()}
    assert got == sequential(turns + quiet)
    assert len(asked) > 2 and min(asked[:2]) >= 200 and max(asked[2:]) <= 8
