"""Contracts over JSON rows: what one row, its field names, its keys and its scope break."""

import json

from marquee.operators import contracts as K

SCHEMA = "kind string, raw string"


def found(spark, rows, contract, scope=("kind",)):
    lines = [(k, r if r is None or isinstance(r, str) else json.dumps(r)) for k, r in rows]
    return sorted((tuple(r) for r in K.check(spark.createDataFrame(lines, SCHEMA), contract, list(scope)).collect()), key=repr)


def event(**more):
    ticket = {"platform": "P", "url": "https://t.example/e/1", "checkedAt": "2026-01-02", "sessions": [{"date": "2026-01-03", "time": "19:30"}]}
    row = {"id": "1", "sourceUid": "u", "title": "t", "region": "r", "venue": "v", "sourceUrl": "https://s.example/1", "status": "scheduled", "summary": "s",
           "sessions": [{"date": "2026-01-03", "time": "19:30"}, {"date": "2026-01-03"}], "tickets": [ticket]}
    return {**row, **more}


def test_event_rules_alone(spark):
    contract = K.event_import()
    assert found(spark, [("a", event())], contract) == []
    cases = {
        "sessions_empty": event(sessions=[], tickets=[]), "session_status": event(sessions=[{"date": "2026-01-03", "time": "19:30", "status": "gone"}]),
        "session_field": event(sessions=[{"date": "2026-01-03", "time": "19:30", "seat": {"row": 1}}]), "event_field": event(poster=None), "summary_length": event(summary="x" * 181),
    }
    for name, row in cases.items():
        assert found(spark, [("a", row)], contract) == [("a", "1", name)], name


def test_unreadable_and_null(spark):
    assert found(spark, [("a", None), ("a", "{broken"), ("a", "[1]")], K.event_import()) == [("a", None, "unreadable")] * 3


def test_live_kinds_and_repeats(spark):
    live = K.published_live()
    ok = event(genre="爵士")
    assert found(spark, [("concerts", ok), ("comedy", event())], live) == []
    assert found(spark, [("concerts", event()), ("comedy", ok)], live) == [("comedy", "1", "genre"), ("concerts", "1", "genre")]
    assert found(spark, [("comedy", event())] * 3 + [("concerts", ok)], live) == [("comedy", "1", "duplicate_id")]
    again = event(sessions=[{"date": "2026-01-03", "time": "19:30"}] * 2, tickets=event()["tickets"] * 2, ticketUrl="https://t.example/e/1")
    assert [v for _, _, v in found(spark, [("comedy", again)], live)] == ["session_twice", "ticket_twice", "ticket_unverified"]


def test_season_size(spark):
    race = {"id": "r", "name": "n", "weekendStart": "2026-01-01", "weekendEnd": "2026-01-03", "source": "https://c.example/1", "dataSource": "d", "sourceTimezone": "UTC",
            "sessions": [{"name": "race", "start": "2026-01-03T10:00:00+00:00", "end": None}], "missingTimes": 0, "lastSuccess": "x", "status": "ok"}
    contract = K.calendar("https://c.example/", "d", minimum=2)
    assert found(spark, [("a", {**race, "id": "r1"}), ("a", race), ("b", race)], contract) == [("b", None, "too_few_rows")]
    assert found(spark, [], contract) == [] and found(spark, [], contract, ()) == [(None, "too_few_rows")]
    assert found(spark, [("a", race), ("a", {k: v for k, v in race.items() if k != "name"} | {"id": "s"})], contract) == [("a", "s", "race_field")]
