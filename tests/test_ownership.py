"""Columns by owner: three-way merge, notes, tickets, status."""

from marquee.operators import ownership as OW

FACTS = "id int, source string, title string, saleAt string, saleNote string"
NESTED = ", sessions array<struct<date: string, time: string>>, tickets array<struct<url: string, sessions: array<struct<date: string, time: string>>>>, status string, statusNote string"
POLICY = [("a", "title", "shared"), ("a", "saleAt", "review"), ("a", "saleNote", "follows:saleAt"), ("a", "sessions", "crawl"), ("b", "title", "crawl")]


def merged(spark, kept, base, crawled):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    policy = frame(POLICY, "source string, field string, owner string")
    out = OW.merge_reviewed(frame(kept, FACTS + NESTED), frame(base, FACTS), frame(crawled, FACTS + NESTED), policy, ["title", "saleAt", "saleNote"], ["auto"])
    return {r["id"]: r for r in out.collect()}


def row(i, source="a", title="t", sale="", note="n", sessions=(), tickets=(), status="scheduled", status_note=None):
    return (i, source, title, sale, note, list(sessions), list(tickets), status, status_note)


def test_fields(spark):
    base = [(i, "a", "t", None, None) for i in range(1, 6)] + [(6, "b", "t", None, None)]
    kept = [row(1), row(2, title="mine"), row(3, title="mine"), row(4, title=None, sale="s"), row(6, source="b", title="mine"), row(7, source="c", title="mine")]
    crawled = [row(1, title="new", sale="x", note="cn"), row(2, title="t"), row(3, title="new"), row(4, sale="x", note="cn"), row(6, source="b", title=None, sale="x"), row(7, source="c", title="new", sale="x"), row(8, title="entered")]
    got = merged(spark, kept, base, crawled)
    told = {i: (r["title"], r["saleAt"], r["saleNote"], r["conflicts"]) for i, r in got.items()}
    assert told == {
        1: ("new", "x", "cn", []), 2: ("mine", "", "n", []), 3: ("mine", "", "n", ["title"]), 4: (None, "s", "n", []),
        # The crawl owns it, also where it says nothing; a field without a row and a source without rows stay.
        6: (None, "", "n", []), 7: ("mine", "", "n", []), 8: ("entered", "", "n", []),
    }


def test_tickets_and_status(spark):
    x, y, z = ("1", None), ("1", "10:00"), ("2", None)
    kept = [
        row(1, sessions=[x, y], tickets=[("u", [x, y]), ("u", [y]), ("w", [x])]), row(2, status="cancelled", status_note="auto"), row(3, status="cancelled", status_note="hand"),
        row(4, status="unconfirmed", status_note="gone"), row(5, status="changed", status_note="c"), row(6, status="changed", status_note="c"),
    ]
    crawled = [row(1, sessions=[y, z], tickets=[("w", [z, x]), ("u", [z]), ("v", [x])]), row(2), row(3), row(4), row(5), row(7, status="cancelled", status_note="auto")]
    crawled.append(row(6, status="cancelled", status_note="auto"))
    got = merged(spark, kept, [], crawled)
    tickets = [(t["url"], [tuple(s) for s in t["sessions"]]) for t in got[1]["tickets"]]
    assert [tuple(s) for s in got[1]["sessions"]] == [y, z] and tickets == [("u", [y]), ("w", [z])]
    assert {i: (r["status"], r["statusNote"]) for i, r in got.items() if i > 1} == {
        2: ("scheduled", None), 3: ("cancelled", "hand"), 4: ("scheduled", None), 5: ("changed", "c"), 6: ("cancelled", "auto"), 7: ("cancelled", "auto"),
    }
