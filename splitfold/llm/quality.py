"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text fit a small network under the non-negative unbiased risk
    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),
with the logistic loss l; where the second part goes below zero, its gradient is turned round. The class prior is estimated
first: among high scores of a plain classifier of positives against unlabelled text, few negatives are left, so the ratio
of the two tail shares bounds the prior from above.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import held_out, sample_of_each, scored
from splitfold.llm.toxicity import fit_logistic

#: Rows that the model is fitted on, at most: trusted positives and unlabelled ones.
POSITIVES, UNLABELLED = 3000, 6000
HIDDEN, STEPS, RATE, DECAY = 16, 400, 0.02, 1e-4
FEATURES = ["words", "length", "upper", "digits", "symbols", "bangs", "bars", "points", "distinct", "top", "again", "dup_lines", "line"]


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return [
        np.log1p(len(words)),
        letters / n,
        raw[65:91].sum() / letters,
        raw[48:58].sum() / letters,
        np.log1p(100 * raw[[35, 36, 37, 38, 42, 60, 62]].sum() / n),
        np.log1p(100 * raw[33] / n),
        np.log1p(100 * raw[124] / n),
        raw[[44, 46, 59, 63]].sum() / n,
        np.log(max(1, len(seen)) / n) / max(1.0, np.log(n + 1)),
        max(seen.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(chars / max(1, len(lines))),
    ]


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((rows - self.mean) / self.scale, -5, 5) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """An estimate from scores of both sets: the least ratio of their shares above a threshold, each with a margin for chance."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 46))
    p = np.array([(positive >= t).mean() for t in cuts])
    u = np.array([(unlabelled >= t).mean() for t in cuts])
    margin = lambda x, n: np.sqrt(np.maximum(x * (1 - x), 1e-4) / n)
    ratio = (u + margin(u, len(unlabelled))) / np.maximum(p - margin(p, len(positive)), 1e-3)
    return float(np.clip(ratio.min(), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Model:
    """The non-negative risk, minimised by Adam over all rows at once from a fixed seed."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (np.clip((x - mean) / scale, -5, 5) for x in (positive, unlabelled))
    w, b = fit_logistic(np.vstack([xp, xu]), np.r_[np.ones(len(xp)), np.zeros(len(xu))])
    prior = class_prior(xp @ w + b, xu @ w + b)
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 0.3, (xp.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    def forward(x):
        h = np.tanh(x @ theta[0] + theta[1])
        return h, h @ theta[2] + theta[3][0]

    def back(x, h, gz):
        gh = gz[:, None] * theta[2][None, :] * (1 - h * h)
        return [x.T @ gh, gh.sum(0), h.T @ gz, np.array([gz.sum()])]

    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        (hp, zp), (hu, zu) = forward(xp), forward(xu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_positive = -prior * sig(-zp) / len(zp)
        g_neg_p, g_neg_u = -prior * sig(zp) / len(zp), sig(zu) / len(zu)
        if negative >= 0:
            grads = [a + c for a, c in zip(back(xp, hp, g_positive + g_neg_p), back(xu, hu, g_neg_u), strict=True)]
        else:
            grads = [-(a + c) for a, c in zip(back(xp, hp, g_neg_p), back(xu, hu, g_neg_u), strict=True)]
        for k, g in enumerate(grads):
            g = g + DECAY * theta[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(prior, mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From at most POSITIVES learnable documents with quality 1 and at most UNLABELLED learnable ones, whose labels aren't
    looked at; None without either.

    The bounds are of different ids: repeated rows, in either table, take no other's place, but each row of a drawn id counts in
    the fit. Null ids and labels teach nothing; null and empty texts have the features of an empty one; only doc_id, text and
    quality are read, whatever other columns there are.
    """
    good = sample_of_each(labels.where(~held_out() & (F.col("quality") == 1)), "quality", POSITIVES, "quality").select("doc_id", F.lit(1).alias("p"))
    web = sample_of_each(docs.where(~held_out()).select("doc_id", F.lit(0).alias("p")), "p", UNLABELLED, "web")
    ids = good.unionAll(web).groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    # A positive may also be drawn as web text: p and u say in which sets a document is.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    made = scored("text", "f array<double>", lambda: lambda batch: pd.DataFrame({"f": [features(t) for t in batch]}))
    rows = sample.select("doc_id", "p", "u", made.alias("r")).select("doc_id", "p", "u", "r.f").collect()
    rows.sort(key=lambda r: (r.doc_id, r.f))  # a bounded sample; sorting it in Spark would compute the features twice
    positive, unlabelled = np.array([r.f for r in rows if r.p == 1]), np.array([r.f for r in rows if r.u == 0])
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else None


def score(text_col: str | Column, model: Model | None) -> Column:
    """A struct of score, the probability of good quality; a null text scores like an empty one, every text 0.5 without a model.
    Whole texts count, whatever their length; equal texts score alike."""

    def load():
        def run(batch: pd.Series) -> pd.DataFrame:
            if model is None:
                return pd.DataFrame({"score": [0.5] * len(batch)})
            rows = np.array([features(t) for t in batch]).reshape(-1, len(FEATURES))
            return pd.DataFrame({"score": model.scores(rows)})

        return run

    return scored(text_col, "score double", load)
