"""The status fold, its sums and the keyed stream against one sequential rule."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import status as S
from marquee.streaming.status import next_status

START = dt.date(2026, 1, 1)


def histories(seed, n):
    rnd = random.Random(seed)
    out = {}
    for k in range(n):
        days = sorted(rnd.sample(range(120), rnd.randint(1, 25)))
        out[k] = [
            (START + dt.timedelta(days=d), rnd.choice("aab"), START + dt.timedelta(days=d + rnd.choice([0, 0, 1, 9])), rnd.choice([0, 0, 0, 0, S.CANCELLED, S.RESCHEDULED]))
            for d in days
        ]
    return out


def frame(spark, hist):
    rows = [(k, *x) for k, own in hist.items() for x in own]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "id long, day date, fact string, open_until date, crawl int")


LAST = START + dt.timedelta(days=120)


@pytest.mark.parametrize("block_days", [1, 7, 400])
def test_fold_equals_the_sequential_rule(spark, block_days):
    hist = histories(1, 300)
    got = S.final_status(S.history(S.segments(frame(spark, hist), "id", block_days), "id"), "id", F.lit(LAST)).collect()
    want = {k: tuple(S.STATES[s] for s in S.sequential(v, LAST)) for k, v in hist.items()}
    assert {r["id"]: (r["listed_status"], r["final_status"]) for r in got} == want
    assert {s for pair in want.values() for s in pair} == set(S.STATES)


def test_later_days_are_added_to_the_stored_sum(spark):
    hist = histories(2, 200)
    cut = START + dt.timedelta(days=60)
    first = {k: [x for x in v if x[0] < cut] for k, v in hist.items()}
    rest = {k: [x for x in v if x[0] >= cut] for k, v in hist.items()}
    stored = S.history(S.segments(frame(spark, first), "id", 7), "id")
    got = S.final_status(S.added(stored, S.segments(frame(spark, rest), "id", 7), "id"), "id", F.lit(LAST)).collect()
    want = {k: tuple(S.STATES[s] for s in S.sequential(v, LAST)) for k, v in hist.items()}
    assert {r["id"]: (r["listed_status"], r["final_status"]) for r in got} == want


def test_stream_step_equals_the_sequential_rule():
    for own in histories(3, 300).values():
        last = None
        for day, fact, open_until, crawl in own:
            last = (day, fact, open_until, next_status(last, day, fact, S.STATES[crawl]))
        assert last[3] == S.STATES[S.sequential(own, LAST)[0]]


def test_null_facts_and_dates(spark):
    rows = [(1, START, None, None, 0), (1, START + dt.timedelta(days=5), None, None, 0), (2, START, None, None, 0), (2, START + dt.timedelta(days=1), "a", None, 0)]
    df = spark.createDataFrame(rows, "id long, day date, fact string, open_until date, crawl int")
    got = S.final_status(S.history(S.segments(df, "id"), "id"), "id", F.lit(LAST)).collect()
    assert {r["id"]: r["final_status"] for r in got} == {1: "scheduled", 2: "changed"}
    assert S.final_status(S.history(S.segments(df.where("false"), "id"), "id"), "id", F.lit(LAST)).count() == 0
