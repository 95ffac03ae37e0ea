import hashlib
import zlib

from brute import docs_frame
from hypothesis import given, settings, strategies as st

from marquee.llm import periodic


def smallest(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def plain_runs(w, least=6, times=4):
    """Runs by trying every period at every word."""
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            if n >= max(least, times * q) and smallest(w[start : start + n]) == q:
                out.append((start, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


unit = st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=5)
block = st.tuples(unit, st.integers(1, 9), st.integers(0, 4)).map(lambda x: x[0] * x[1] + x[0][: x[2]])
text = st.lists(block, max_size=5).map(lambda x: [w for b in x for w in b])


@settings(max_examples=1500, deadline=None)
@given(st.lists(text, max_size=4))
def test_runs(docs):
    assert periodic.runs_in(docs) == [plain_runs(d) for d in docs]


@settings(max_examples=60, deadline=None)
@given(st.lists(text, max_size=4), st.integers(2, 8), st.integers(2, 5))
def test_runs_of_other_lengths(docs, least, times):
    assert periodic.runs_in(docs, least, times) == [plain_runs(d, least, times) for d in docs]


def test_long_runs():
    assert periodic.runs_in([["a"] * 60_000]) == [[(0, 60_000, 1)]]
    w = [str(i) for i in range(3000)]
    assert periodic.runs_in([w * 5, w]) == [[(0, 15_000, 3000)], []]


def rows(df):
    got = periodic.digested(df).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))


def test_query_rows(spark):
    line = "x y z " * 9 + "tail"
    texts = [None, "", " \n\t", line, line, "a", "a b c " * 7, "é\x0bé\x0cé\ré é é", "one two three four five six seven"] + [f"w{i} " * 3 + f"u{i} v{i} " * (i % 7) + "end " * (i % 11) for i in range(120)]
    ids = [None, 10, 20, 7, 7, *range(100, 100 + len(texts) - 5)]
    df = docs_frame(spark, texts, ids, extra=("runs", "_g", "_w", "collapsed"))
    want = sorted((plain_row(d, t) for d, t in zip(ids, texts)), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))
    assert rows(periodic.periodic(periodic.planted(df))) == want
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.where("length(text) < 3000").collect()), key=lambda r: r[0])
    assert rows(periodic.periodic(periodic.planted(docs.where("length(text) < 3000")))) == want


def test_empty_table_and_own_texts(spark):
    assert periodic.digested(periodic.periodic(docs_frame(spark, []))).count() == 0
    found = {r["doc_id"]: r for r in periodic.periodic(docs_frame(spark, ["go  go go go\ngo go stop", "a b a b"], [1, 2])).collect()}
    assert found[1]["collapsed"] == "go stop" and [tuple(r) for r in found[1]["runs"]] == [(0, 6, 1)]
    assert found[2]["collapsed"] == "a b a b" and found[2]["runs"] == []
