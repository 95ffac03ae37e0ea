"""Quality scores by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1; the unlabelled side is labelled rows whatever their
label, standing for web text. The class prior is estimated from the two by the ratio of their upper
tails. A linear model on byte and shape features of the whole text minimises the non-negative
unbiased logistic risk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from marquee.llm.common import mapped, release

#: Labelled rows used for fitting, those of the smallest hashes of doc_id; the rest is only scored.
SAMPLE = 12_000
BINS = 512
DIMS = 256 + BINS + 10
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Bytes of a text, and rows, taken at once.
LONG, ROWS = 1 << 20, 500


def features(text: str | None) -> np.ndarray:
    """Shares of bytes and of hashed neighbouring byte classes, and shape ratios; zeros for no text."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(DIMS, np.float32)
    if not raw:
        return out
    counts, pairs = np.zeros(256), np.zeros(BINS)
    b = np.frombuffer(raw, np.uint8)
    for at in range(0, len(b), LONG):
        part = b[at : at + LONG + 1]
        counts += np.bincount(part[:LONG], minlength=256)
        pairs += np.bincount((part[:-1].astype(np.uint16) * 157 + part[1:]) % BINS, minlength=BINS)
    words, lines = raw.split(), raw.split(b"\n")
    n = len(b)
    out[:256] = np.sqrt(counts / n)
    out[256 : 256 + BINS] = np.sqrt(pairs / n)
    upper, mark = counts[65:91].sum(), counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    out[256 + BINS :] = [
        np.log1p(n) / 10, len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), len(words) / n * 4,
        upper / n, mark / n, counts[48:58].sum() / n, np.log1p(n / len(lines)) / 10,
        np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))), np.sqrt(sum(not w.strip(MARKS) for w in words) / max(1, len(words))),
    ]
    return out


def prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled scores: the least ratio of upper tails.

    Tails hold at least half of the positives; a part of the ratio's standard error offsets the minimum.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0, 0.5, 51))
    tail_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    tail_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    ratio = tail_u / np.maximum(tail_p, 1e-9)
    odds = lambda t, n: (1 - t) / np.maximum(t, 1e-9) / n
    return float(np.clip(np.min(ratio * (1 + 0.2 * np.sqrt(odds(tail_p, len(p)) + odds(tail_u, len(u))))), 0.02, 0.99))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(x: np.ndarray, gradient, steps: int, rate: float = 0.05, decay: float = 3e-3) -> np.ndarray:
    """Mean of the last third of the steps, as the risk's switch keeps single steps moving."""
    mean = np.zeros(x.shape[1] + 1)
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        part = gradient(x @ w[:-1].astype(np.float32) + w[-1])
        g = np.append(x.T @ part.astype(np.float32), part.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps - steps // 3:
            mean += w / (steps // 3)
    return mean


class Model:
    """Standardised linear scorer."""

    def __init__(self, mean, scale, w, share: float):
        self.mean, self.scale, self.w, self.share = mean, scale, w, share

    def score(self, texts: pd.Series) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), ROWS):
            x = (np.stack([features(t) for t in texts.iloc[at : at + ROWS]]) - self.mean) / self.scale
            out[at : at + ROWS] = _sigmoid(x @ self.w[:-1] + self.w[-1])
        return out


def learn(x: np.ndarray, positive: np.ndarray, steps: int = 300, share: float | None = None) -> Model:
    """Fit on rows ``x``; ``positive`` marks trusted positives, all rows together are the unlabelled side.

    Without any positive, every text scores the prior's floor; ``share`` overrides the estimated prior.
    """
    mean = x.mean(axis=0) if len(x) else np.zeros(DIMS, np.float32)
    scale = x.std(axis=0) + 0.02 if len(x) else np.ones(DIMS, np.float32)
    if not positive.any():
        return Model(mean, scale, np.append(np.zeros(DIMS), -4.0), 0.02)
    z = ((x - mean) / scale).astype(np.float32)
    n_p, n_u = int(positive.sum()), len(x)
    if share is None:
        # Positives against the unlabelled: a ranking by the density ratio, which the prior needs.
        def against(s):
            p = _sigmoid(s)
            return (p - 1) * positive / n_p + p / n_u

        share = prior((s := z @ (w := _adam(z, against, steps // 2))[:-1])[positive], s)

    def risk(s):
        p = _sigmoid(s)
        gain, loss_p, loss_u = (p - 1) * positive / n_p * share, p * positive / n_p * share, p / n_u
        soft = np.logaddexp(0, s)
        negative = soft.mean() - share * soft[positive].mean()
        # The unbiased negative part must not fall below zero; if it does, its step is undone.
        return gain + loss_u - loss_p if negative >= 0 else loss_p - loss_u

    return Model(mean, scale, _adam(z, risk, steps), share)


def is_held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled documents that aren't held out."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.where(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    # One text of every chosen doc_id, however often it repeats, so at most `sample` rows reach the driver.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "x": [features(t).astype(np.float16).tobytes() for t in frame["text"]]})

    got = mapped(rows, work, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, DIMS).astype(np.float32)
    return learn(x, (got["quality"] == 1).to_numpy(bool))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score`` between 0 and 1; null and empty texts get the score of no features."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(sent.value.score(texts))
        release()
        return out

    return docs.withColumn("_score", score("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null doc_id gives null held_out. Repeats stay."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"))
