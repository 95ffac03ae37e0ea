import random
import zlib

import numpy as np
from brute import LABELS, docs_frame

from marquee.llm import quality, toxicity


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8)))
    texts, good, toxic = [], [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(15, 60))]
        bad = rng.random() < 0.2
        rude = not bad and rng.random() < 0.2
        if rude:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "Nitwit,", "twerp", "dolt"]))
        texts.append(rng.choice([" ", " "]).join(w.upper() + "!!" if bad else w for w in words))
        good.append(int(not bad))
        toxic.append(int(rude))
    return texts, good, toxic


def test_quality_on_held_out_rows(spark):
    texts, good, _ = made(1200, 1)
    df = docs_frame(spark, texts, extra=("score", "quality", "x"))
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % 2], LABELS)
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    out = [i for i in range(len(texts)) if held(i) or not i % 2]
    assert np.mean([got[i]["predicted"] == good[i] for i in out]) > 0.97
    assert all(got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1 for i in got)


def test_quality_ignores_held_out_labels(spark):
    texts, good, _ = made(300, 2)
    df = docs_frame(spark, texts)
    rows = [(i, g, 0) for i, g in enumerate(good)]
    turned = [(i, 1 - g if held(i) else g, 0) for i, g, _ in rows]
    one, two = (quality.classify(df, spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect() for x in (rows, turned))
    assert one == two


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(2, 1, 5000), rng.normal(-2, 1, 5000)
    for share in (0.3, 0.6, 0.9):
        n = int(5000 * share)
        assert abs(quality.prior(good, np.concatenate([rng.normal(2, 1, n), bad[: 5000 - n]])) - share) < 0.05


def test_risk_needs_no_negatives():
    rng = np.random.default_rng(5)
    x = np.zeros((2000, quality.DIMS), np.float32)
    y = rng.random(2000) < 0.7
    x[:, 0] = np.where(y, 1, -1) + rng.normal(0, 0.5, 2000)
    trusted = y & (rng.random(2000) < 0.4)  # most positives are unlabelled too
    model = quality.learn(x, trusted, share=0.7)
    s = quality._sigmoid(((x - model.mean) / model.scale) @ model.w[:-1] + model.w[-1])
    assert np.mean((s >= 0.5) == y) > 0.93


def test_quality_of_odd_rows(spark):
    df = docs_frame(spark, [None, "", "a" * 3_000_000, "\x00", "same", "same"], [1, 2, 3, None, 4, 4])
    labels = spark.createDataFrame([(3, 1, None), (4, None, 1), (None, 1, 1), (4, 0, 0)], LABELS)
    got = quality.classify(df, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert quality.classify(docs_frame(spark, []), labels).count() == 0
    assert quality.classify(df, spark.createDataFrame([], LABELS)).count() == 6


def test_toxicity_on_held_out_rows(spark):
    texts, _, toxic = made(1500, 6)
    df = docs_frame(spark, texts, extra=("t", "toxic", "grade"))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    got = {r["doc_id"]: r for r in toxicity.severity(df, labels).collect()}
    out = [i for i in got if held(i)]
    assert np.mean([got[i]["toxic"] == bool(toxic[i]) for i in out]) > 0.98
    assert not any(got[i]["toxic"] for i in out if not toxic[i])
    severe = [r["expected_severity"] for r in got.values() if r["toxic"]]
    assert min(severe) > max(r["expected_severity"] for r in got.values() if not r["toxic"])


def test_thresholds_are_ordered_and_shared():
    texts, _, toxic = made(800, 7)
    model = toxicity.learn(texts, np.array(toxic, bool))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == toxicity.GRADES - 1
    p = model.grades(["plain", "blockhead nitwit", "blockhead nitwit twerp dolt"])
    assert np.allclose(p.sum(axis=1), 1)
    mean = p @ np.arange(toxicity.GRADES)
    assert mean[0] < mean[1] < mean[2]


def test_toxicity_of_odd_rows(spark):
    df = docs_frame(spark, [None, "", "a b", "a b"], [1, 2, None, None])
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 1)], LABELS)
    got = toxicity.severity(df, labels).collect()
    assert len(got) == 4 and not any(r["toxic"] for r in got)
    assert toxicity.severity(docs_frame(spark, []), labels).count() == 0


def test_a_repeated_labelled_row_does_not_displace_others(spark):
    texts = [f"good plain words number {i}. " * 5 if i % 2 else f"BUY!! {i} $$$ NOW ### " * 9 for i in range(40)]
    ids = [100 + i for i in range(40)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d in ids], "doc_id long, quality int, toxic int")
    low = next(i for i in range(40) if zlib.crc32(str(ids[i]).encode()) % 5)
    plain = quality.fit(docs_frame(spark, texts, ids), labels, sample=40)
    again = quality.fit(docs_frame(spark, texts + [texts[low]] * 100, ids + [ids[low]] * 100), labels, sample=40)
    assert np.allclose(plain.w, again.w) and np.allclose(plain.mean, again.mean)


def test_toxicity_on_few_rows(spark):
    # Ten toxic rows of seventy: a word in four of them is learned, one in a single row isn't.
    plain = [f"alpha{i % 7} beta{i % 5} gamma" for i in range(60)]
    rude = [f"alpha{i % 7} blockhead gamma" for i in range(4)] + [f"gamma dunce beta{i % 5}" for i in range(5)] + ["gamma oddity"]
    texts, toxic = plain + rude, [0] * 60 + [1] * 10
    index = toxicity._telling(texts, np.array(toxic, bool))
    assert {"blockhead", "dunce"} <= set(index) and "oddity" not in index and "gamma" not in index
    df = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)
    known = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 0]
    model = toxicity.fit(df, labels)
    assert model.index == toxicity._telling([texts[i] for i in known], np.array(toxic, bool)[known]) and model.index
    got = {r["doc_id"]: r["toxic"] for r in toxicity.severity(df, labels).collect()}
    assert not any(got[i] for i in range(60)) and any(got[i] for i in range(60, 70))


def test_ordinal_likelihood_has_its_least_value_at_the_fit():
    texts, _, toxic = made(300, 9)
    bad = np.array(toxic, bool)
    model = toxicity.learn(texts, bad, steps=4000, rate=0.02, decay=1e-2)
    hits = np.array([len(toxicity.terms(t) & model.index.keys()) for t in texts])
    y = np.where(bad, 1 + np.searchsorted(np.quantile(hits[bad], [1 / 3, 2 / 3]), hits, "right"), 0)

    def loss(w, cut):
        p = toxicity.Model(model.index, w, cut).grades(texts)
        return -np.mean(np.log(np.maximum(p[np.arange(len(y)), y], 1e-9))) + 0.5e-2 * (w @ w)

    best = loss(model.w, model.thresholds)
    for j in range(0, len(model.w), max(1, len(model.w) // 10)):
        for step in (-0.1, 0.1):
            moved = model.w.copy()
            moved[j] += step
            assert loss(moved, model.thresholds) > best - 1e-4
