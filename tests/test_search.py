"""Views, session filters, facets, ordering, frontier, ranking and guards on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.functions import values as V
from marquee.functions.dates import covers
from marquee.operators import frontier as FR, quality as Q, ranking as RK, search as S, tickets as K

D = dt.date
NEXT = {17: D(2026, 11, 17), 18: D(2026, 11, 18)}


def listings(spark):
    base = dict(title="活動", start_day=D(2026, 11, 1), end_day=D(2026, 11, 17), first_seen=D(2026, 11, 17), region="臺北市", missing=False, note=None)
    rows = [dict(base, id="full"), dict(base, id="no_end", end_day=None), dict(base, id="none", start_day=None, end_day=None), dict(base, id="no_start", start_day=None)]
    return spark.createDataFrame(rows, "id string, title string, start_day date, end_day date, first_seen date, region string, missing boolean, note string")


@pytest.mark.parametrize(
    "view, day, want",
    [
        ("all", 17, {"full", "no_end", "none", "no_start"}), ("all", 18, {"no_end", "none"}), ("history", 17, set()), ("history", 18, {"full", "no_start"}),
        ("ending", 17, {"full"}), ("recommended", 17, {"full"}), ("new", 17, {"full", "no_end", "none", "no_start"}), ("new", 18, set()),
    ],
)
def test_views(spark, view, day, want):
    got = listings(spark).where(S.view_predicate(view, F.lit(NEXT[day])))
    assert {r["id"] for r in got.collect()} == want


def test_exact_day_needs_both_dates(spark):
    got = listings(spark).where(covers(F.col("start_day"), F.col("end_day"), F.lit(NEXT[17])))
    assert [r["id"] for r in got.collect()] == ["full"]


def test_order(spark):
    rows = [("未知", None, "臺北市"), ("晚開", D(2026, 11, 10), "臺北市"), ("早開", D(2026, 11, 1), "臺北市"), ("他縣", D(2026, 1, 1), "高雄市")]
    df = spark.createDataFrame([(t, t, s, None, r) for t, s, r in rows], "id string, title string, start_day date, end_day date, region string")
    got = [r["title"] for r in S.page(df, S.order_for("all", ["臺北市", "新北市"])).collect()]
    assert got == ["早開", "晚開", "未知", "他縣"]


def split(spark):
    s = [(1, D(2030, 1, 1), "16:00", False), (1, D(2030, 1, 1), "19:00", False), (1, D(2030, 1, 2), "19:00", False), (2, D(2030, 1, 1), None, True), (3, D(2020, 1, 1), None, False)]
    t = [(1, D(2030, 1, 1), "16:00", "A"), (1, D(2030, 1, 1), "19:00", "B"), (1, D(2030, 1, 1), "19:00", "C"), (2, D(2030, 1, 1), None, "A")]
    return spark.createDataFrame(s, "event int, day date, clock string, cancelled boolean"), spark.createDataFrame(t, "event int, day date, clock string, platform string")


def test_session_conditions_meet_in_one_session(spark):
    s, t = split(spark)
    today = F.lit(D(2026, 10, 6))
    pick = lambda **kw: K.matching_sessions(s, today, tickets=t, **kw)
    assert pick(view="all", platform="A", day="2030-01-02").count() == 0
    assert pick(view="all", platform="B").count() == 1
    assert {r["event"] for r in pick(view="all", platform="A").collect()} == {1, 2}
    assert {r["event"] for r in pick().collect()} == {1}
    assert {r["event"] for r in pick(view="all", platform=V.UNVERIFIED_PLATFORM).collect()} == {1, 3}
    values = S.session_platforms(s.where(F.col("day") == F.lit(D(2030, 1, 2))), t)
    assert [r["platform"] for r in values.collect()] == [V.UNVERIFIED_PLATFORM]
    # A NULL clock equals a NULL clock.
    assert K.covered_sessions(s.where("event = 2"), t).count() == 1


def test_facet_values_each_give_a_result(spark):
    rows = [(r, v, p) for r in "xy" for v in "ab" for p in "mn" if (r, v, p) != ("x", "a", "m")]
    df = spark.createDataFrame(rows, "region string, venue string, source string")
    chosen = {"region": "x", "venue": "a", "source": "n"}
    got = S.facets(df, {k: F.col(k) == v for k, v in chosen.items()}, {"region": ["venue"]})
    for r in got.collect():
        f = dict(chosen, **{r["facet"]: r["value"]})
        if r["facet"] == "region":
            f.pop("venue")
        cond = F.lit(True)
        for k, v in f.items():
            cond = cond & (F.col(k) == v)
        assert df.where(cond).count() == r["n"] > 0


def test_dependent_venue_is_cleared(spark):
    df = spark.createDataFrame([("x", "a"), ("y", "b")], "region string, venue string")
    f, cleared = S.clear_incompatible(df, S.Filter(region="x", venue="b"))
    assert cleared and f.venue == ""
    assert S.clear_incompatible(df, S.Filter(region="x", venue="a"))[1] is False


def test_genre_order(spark):
    df = spark.createDataFrame([("爵士",), ("流行／搖滾演唱會",), ("?",)], "g string")
    assert [r["g"] for r in df.orderBy(S.genre_rank(F.col("g"))).collect()] == ["流行／搖滾演唱會", "爵士", "?"]


def test_positions_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    got = RK.positions(df, ["k"], [F.col("o")])
    from pyspark.sql import Window

    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert got.count() == 5000 and got.select("k", "o", "pos").exceptAll(want.select("k", "o", F.col("pos").cast("bigint"))).count() == 0


def frontier_state(spark):
    return spark.createDataFrame([], "source string, url string, status string, queue_key string, last_attempt date")


def listed(spark, ids):
    return spark.createDataFrame([("s", f"https://a.example/e/{i:04d}") for i in ids], "source string, url string")


def test_budget_over_days(spark):
    ids = range(1, 252)
    state, total = frontier_state(spark), []
    for day, order in (("2026-11-17", ids), ("2026-11-17", ids), ("2026-11-18", reversed(ids)), ("2026-11-19", ids), ("2026-12-19", ids)):
        state = RK.checkpointed(FR.run_day(state, listed(spark, order), F.lit(True), day))
        total.append(state.where("status = 'known'").count())
    assert total == [100, 100, 200, 251, 251]


def test_failed_page_waits_for_the_next_day(spark):
    ok = ~F.col("url").endswith("0003")
    state = RK.checkpointed(FR.run_day(frontier_state(spark), listed(spark, [1, 2, 3]), ok, "2026-11-18"))
    same_day = RK.checkpointed(FR.run_day(state, listed(spark, [1, 2, 3]), F.lit(True), "2026-11-18"))
    assert same_day.where("status = 'pending'").count() == 1
    next_day = FR.run_day(same_day, listed(spark, [1, 2, 3]), F.lit(True), "2026-11-19")
    assert next_day.where("status = 'pending'").count() == 0


def test_stop_at_first_failure(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False)], "b string, o int, f boolean")
    got = {(r["b"], r["o"]) for r in FR.until_first_failure(df, "b", F.col("o"), F.col("f")).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1)}


def test_guards_are_strict(spark):
    df = spark.createDataFrame([(20, 100, 21, 10), (21, 100, 20, 9), (2, 5, 22, 11)], "rejected int, total int, active int, incoming int")
    r = df.select(Q.rejection_guard(F.col("rejected"), F.col("total")).alias("a"), Q.rejection_guard(F.col("rejected"), F.col("total"), 2).alias("b"),
                  Q.loss_guard(F.col("active"), F.col("incoming")).alias("c")).collect()
    assert [x["a"] for x in r] == [False, True, True] and [x["b"] for x in r] == [False, True, False] and [x["c"] for x in r] == [True, False, False]


def test_traversal_needs_proof(spark):
    df = spark.createDataFrame([(["1", "2"], ["1"], True), (["1", "2"], ["2", "1"], True), (["1"], ["1"], False), (["1"], ["9"], True)], "e array<string>, v array<string>, c boolean")
    got = [tuple(r[0]) for r in df.select(Q.traversal_state(F.col("e"), F.col("v"), F.col("c"))).collect()]
    assert got == [(True, False), (True, True), (True, False), (False, False)]


def test_last_good_per_source(spark):
    prev = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source string, v int")
    cand = spark.createDataFrame([("a", 2), ("b", 2)], "source string, v int")
    ok = spark.createDataFrame([("a", True), ("b", False)], "source string, ok boolean")
    got = {r["source"]: r["v"] for r in Q.keep_last_good(prev, cand, ok).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}
    assert Q.overall(ok).first()["all_ok"] is False
