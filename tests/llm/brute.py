"""Plain models of the corpus operators, and small tables with awkward rows."""

import hashlib

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"


def docs_frame(spark, texts, ids=None, extra=()):
    """Documents of the texts; ``extra`` adds columns with names that operators use inside."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def components(ids, edges):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def repeated(docs, units, size, join):
    """{doc_id: (units, removed, spans, sha256)} by a table of all windows."""
    first = {}
    for d, t in docs:
        u = units(t)
        for i in range(len(u) - size + 1):
            w = tuple(u[i : i + size])
            first[w] = min(d, first.get(w, d))
    out = {}
    for d, t in docs:
        u = units(t)
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if first[tuple(u[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = join([x for x, g in zip(u, gone) if not g])
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def as_kept(docs):
    """Texts without bytes of 50-byte strings that a smaller doc_id holds; whole characters stay."""
    first = {}
    for d, t in docs.items():
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(d, first.get(raw[i : i + 50], d))
    out = {}
    for d, t in docs.items():
        raw, gone = (t or "").encode(), set()
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            if not gone.issuperset(range(at, at + n)):
                kept.append(c)
            at += n
        out[d] = "".join(kept)
    return out
