from collections import Counter

import numpy as np
import pytest
from brute import components

from marquee.llm import embeddings

NAN, INF = float("nan"), float("inf")


def clusters(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, d))
    out = []
    for c in centres:
        for _ in range(int(rng.integers(1, 6))):
            noise = rng.standard_normal(d)
            noise -= noise @ c / (c @ c) * c
            angle = np.arccos(rng.choice([0.99, 0.93, 0.85]))
            out.append(c / np.linalg.norm(c) * np.cos(angle) + noise / np.linalg.norm(noise) * np.sin(angle))
    return [[float(x) for x in v] for v in out]


@pytest.mark.parametrize("block", [2048, 6])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_links(spark, monkeypatch, block, kind):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "GROUP_ROWS", 300)
    vectors = clusters(60, 32, 1)
    vectors += [vectors[0]] * 20 + [[2 * x for x in vectors[0]], None, [], [0.0] * 32, [NAN] * 32, [INF] + [0.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [1.0, 2.1]]
    ids = np.random.default_rng(0).permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, [0] * len(ids), [1] * len(ids))), f"vec_id long, embedding array<{kind}>, label int, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    unit = {}
    for i, v in zip(ids, vectors):
        a = np.array(v if v else [0.0], np.float64)
        if not (np.isfinite(a).all() and a.any()):
            continue
        a = a.astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
        unit[i] = a / np.linalg.norm(a)
    n, edges = Counter(), []
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                n[a] += 1
                n[b] += 1
                edges.append((a, b))
    part = components(ids, edges)
    assert sum(n.values()) > 100
    assert got == {i: (n[i], part[i], part[i] == i) for i in ids}


def test_recall_and_no_link_below(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3000, 64))
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) / (base**2).sum(1, keepdims=True) * base
    angle = np.arccos(rng.uniform(0.9, 0.93, (3000, 1)))
    near = base / np.linalg.norm(base, axis=1, keepdims=True) * np.cos(angle) + noise / np.linalg.norm(noise, axis=1, keepdims=True) * np.sin(angle)
    x = np.concatenate([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df).collect()
    found = sum(r["n_links"] for r in got) / 2
    assert 0.99 * 3000 <= found <= 3000


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    d = 64
    a, b = rng.standard_normal((2, 4000, d))
    b = a + 0.7 * b
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    code, factor = embeddings.codes(b)
    signs = np.unpackbits(code, axis=1)[:, :d] * 2.0 - 1
    est, error = embeddings.estimates(a @ embeddings.rotation(d, 0), signs, factor, 4.0)
    real = (a * b).sum(1)
    assert abs((est - real).mean()) < 0.01 and (np.abs(est - real) <= error).mean() > 0.995


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(None, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(one).collect()) == [(0, 0, None, False), (2, 0, 2, True)]
