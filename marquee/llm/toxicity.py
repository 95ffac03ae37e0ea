"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

P(grade <= k) is the logistic function of (threshold k - weights x features), with one set of weights
for all ordered thresholds. Labels say only toxic or not; the grades of toxic rows follow the number of
distinct features that tell toxic from other labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import mapped

#: Labelled rows for fitting, those of the smallest hashes of doc_id.
SAMPLE = 12_000
GRADES = 4
#: Evidence that a telling feature is not toxic by chance, and the log of how much more frequent it is there.
#: With evidence e, a feature unrelated to the label would look so one-sided with a chance of at most exp(-e).
EVIDENCE, ODDS = 5.0, 2.5
MARKS = ".,!?;:|%$#&*\"'()[]{}<>-_"
PREFIXES = (4, 5, 6)


def terms(text: str | frozenset | None) -> set[str] | frozenset:
    """Distinct words of the whole text, in lower case without marks, and their beginnings.

    A set is taken as the terms themselves.
    """
    if isinstance(text, frozenset):
        return text
    words = {w.strip(MARKS) for w in set((text or "").lower().split())}
    words.discard("")
    return words | {f"{w[:n]}~" for w in words for n in PREFIXES if len(w) > n}


def _evidence(yes: float, no: float, share: float) -> float:
    """Rows times the divergence of their toxic share from ``share``; no floor on either count."""
    n = yes + no
    return (yes * math.log(yes / n / share) if yes else 0.0) + (no * math.log(no / n / (1 - share)) if no else 0.0)


def _telling(texts: list[str | None], toxic: np.ndarray, evidence: float = EVIDENCE, odds: float = ODDS) -> dict[str, int]:
    """Features at least ``exp(odds)`` times as frequent in toxic rows, on that evidence, by rank."""
    yes, no = Counter(), Counter()
    n_yes, n_no = int(toxic.sum()), int((~toxic).sum())
    for text, bad in zip(texts, toxic):
        if bad:
            yes.update(terms(text))
    for text, bad in zip(texts, toxic):
        if not bad:
            no.update(terms(text) & yes.keys())
    share = (n_yes + 0.5) / (n_yes + n_no + 1)
    found = []
    for t in yes:
        lift = math.log((yes[t] + 0.5) / (n_yes + 1) / ((no[t] + 0.5) / (n_no + 1)))
        if lift >= odds and _evidence(yes[t], no[t], share) >= evidence:
            found.append((-lift, t))
    return {t: i for i, (_, t) in enumerate(sorted(found))}


class Model:
    def __init__(self, index: dict[str, int], w: np.ndarray, thresholds: np.ndarray):
        self.index, self.w, self.thresholds = index, w, thresholds

    def grades(self, texts) -> np.ndarray:
        """Probability of every grade, a row per text."""
        known = self.index.keys()
        s = np.array([sum(self.w[self.index[t]] for t in terms(x) & known) for x in texts], float)
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))
        edges = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], axis=1)
        return np.diff(edges, axis=1)


def learn(texts: list[str | None], toxic: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch likelihood of the ordinal model. Without toxic rows every text gets grade 0."""
    index = _telling(texts, toxic) if toxic.any() else {}
    if not index:
        return Model({}, np.zeros(0), np.array([8.0 + k for k in range(GRADES - 1)]))
    rows, columns = [], []
    for i, text in enumerate(texts):
        for t in terms(text):
            if t in index:
                rows.append(i)
                columns.append(index[t])
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    hits = np.bincount(rows, minlength=len(texts))
    cuts = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    y = np.where(toxic, 1 + np.searchsorted(cuts, hits, "right"), 0)
    w, base, gaps = np.zeros(len(index)), 1.0, np.zeros(GRADES - 2)
    state = np.zeros((2, len(w) + GRADES - 1))
    for t in range(1, steps + 1):
        cut = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])  # ordered by construction
        s = np.bincount(rows, w[columns], len(texts))
        below = np.concatenate([np.zeros((len(s), 1)), 1 / (1 + np.exp(-np.clip(cut[None, :] - s[:, None], -40, 40))), np.ones((len(s), 1))], axis=1)
        slope = below * (1 - below)
        i = np.arange(len(s))
        p = np.maximum(below[i, y + 1] - below[i, y], 1e-9)
        up, low = slope[i, y + 1] / p, slope[i, y] / p
        d_s = (up - low) / len(s)
        d_cut = np.zeros(GRADES - 1)
        np.add.at(d_cut, y[y < GRADES - 1], -up[y < GRADES - 1] / len(s))
        np.add.at(d_cut, y[y > 0] - 1, low[y > 0] / len(s))
        g_w = np.bincount(columns, d_s[rows], len(w)) + decay * w
        g_gap = np.array([d_cut[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(gaps)
        g = np.concatenate([g_w, [d_cut.sum()], g_gap])
        state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, base, gaps = w - step[: len(w)], base - step[len(w)], gaps - step[len(w) + 1 :]
    return Model(index, w, base + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled documents; held-out rows (crc32(doc_id) mod 5 = 0) are not used."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    # Only the telling terms of the sample reach the driver.
    own = mapped(rows, lambda f: pd.DataFrame({"doc_id": f["doc_id"], "toxic": f["toxic"], "t": [" ".join(sorted(terms(t))) for t in f["text"]]}), "doc_id long, toxic int, t string")
    each = own.select("doc_id", "toxic", F.explode(F.split("t", " ")).alias("t"))
    n = chosen.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("yes"), F.sum((F.col("toxic") != 1).cast("long")).alias("no")).first()
    yes, no = F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") != 1).cast("long"))
    lift = F.log((F.col("yes") + 0.5) / ((n["yes"] or 0) + 1) / ((F.col("no") + 0.5) / ((n["no"] or 0) + 1)))
    share = ((n["yes"] or 0) + 0.5) / ((n["yes"] or 0) + (n["no"] or 0) + 1)
    part = lambda c, of: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (F.col("yes") + F.col("no")) / of)).otherwise(0.0)
    telling = each.groupBy("t").agg(yes.alias("yes"), no.alias("no")).where((lift >= ODDS) & (part("yes", share) + part("no", 1 - share) >= EVIDENCE)).select("t")
    small = each.join(telling, "t").groupBy("doc_id", "toxic").agg(F.array_join(F.sort_array(F.collect_list("t")), " ").alias("t"))
    got = chosen.join(small.select("doc_id", "t"), "doc_id", "left").orderBy("doc_id").toPandas()
    texts = [frozenset((t or "").split(" ")) - {""} for t in got["t"].where(got["t"].notna(), None)]
    return learn(texts, (got["toxic"] == 1).to_numpy(bool))


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every row.

    ``expected_severity`` is the mean grade (0 to 3), ``grade`` the likeliest one, ``toxic`` whether any
    grade above 0 is likelier than none. Null and empty texts have no features and get grade 0 unless
    the thresholds say otherwise; rows are kept with null or repeated doc_id.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))  # bounded by the sample's repeated terms

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        p = model.value.grades(frame["text"])
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "expected_severity": p @ np.arange(GRADES), "grade": p.argmax(axis=1).astype("int32"), "toxic": p[:, 0] < 0.5})

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, expected_severity double, grade int, toxic boolean")
