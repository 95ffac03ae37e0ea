import random

import xxhash
from brute import components, docs_frame

from marquee.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_groups(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("red blue green Grün big small old new".split()) for _ in range(60)) for _ in range(30)]
    texts = base + [t + " extra" for t in base] + [t.upper() for t in base[:5]] + [None, "", "\t", "one", "one two", "One Two", base[0] * 300]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = docs_frame(spark, texts, ids, extra=("fp", "id", "part", "b"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fp = {d: plain(t) for d, t in zip(ids, texts)}
    near = components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {d: (f"{fp[d]:016x}", near[d]) for d in ids}


def test_links_of_chosen_fingerprints(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ 7 << rng.randrange(60)}
    signed = {simhash._signed(f): f for f in fps}
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(s, s) for s in signed], "id long, fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 2}
    assert got == want


def test_repeats_nulls_empty(spark):
    df = docs_frame(spark, ["a b c", "a b c", "a b c", "x y z", "x y z"], [4, 4, None, None, None])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(4, 4), (4, 4), (None, 4), (None, None), (None, None)]
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0
