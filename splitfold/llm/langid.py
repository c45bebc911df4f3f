"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then calibrated by a temperature on rows kept from
training. Document frequencies are counted over all learnable documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import class_sizes, held_out, sample_of_each, scored
from splitfold.shipping import ship

#: Hashed n-grams; labelled rows of each language that weights are fitted on, at most.
DIMENSIONS, NGRAMS, PER_LANGUAGE = 1 << 16, (1, 2, 3), 800
#: And labelled rows in all, at most, or LEAST_EACH of each language if that is more: no language goes unlearned.
MOST_ROWS, LEAST_EACH = 6400, 20
#: N-grams of a labelled row that weights are fitted on: its commonest. Predictions use all.
FIT_NGRAMS = 2048
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 3
#: Characters that are hashed at a time, so that a very long text needs little memory.
CHUNK = 1 << 20
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text, ascending, and how often each occurs."""
    low = " " + text.lower() + " "
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(low), CHUNK):
        part = low[max(0, at - NGRAMS[-1] + 1) : at + CHUNK]
        skip = min(at, NGRAMS[-1] - 1)
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in NGRAMS:
            h = np.full(max(0, len(c) - n + 1), n, np.uint64)
            for k in range(n):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ c[k : len(c) - n + 1 + k]
                h ^= h >> np.uint64(29)
            h = h[max(0, skip - n + 1) :]
            total += np.bincount((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64), minlength=DIMENSIONS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    starts: np.ndarray  # of each n-gram, where its weights that aren't zero start
    columns: np.ndarray  # their languages
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        f, n = counts(text)
        return f, tfidf(f, n, self.idf)

    def logits(self, f: np.ndarray, x: np.ndarray) -> np.ndarray:
        n = self.starts[f + 1] - self.starts[f]
        at = np.repeat(self.starts[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.columns[at], np.repeat(x, n) * self.weights[at], len(self.bias)) + self.bias


def sparse(languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> Model:
    """A model of the weights that aren't zero; weights: DIMENSIONS x languages."""
    f, columns = np.nonzero(weights)
    starts = np.searchsorted(f, np.arange(len(weights) + 1))
    return Model(languages, idf.astype(np.float32), starts, columns.astype(np.int32), weights[f, columns].astype(np.float32), bias.astype(np.float32))


def tfidf(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[f]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            df[counts(text.as_py() or "")[0]] += 1
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.r_[n, df])], ["f", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """IDF of each hashed n-gram over all rows of texts (text); DIMENSIONS numbers reach the driver, whatever the input."""
    ship(texts.sparkSession)
    rows = texts.select("text").mapInArrow(_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = {r.f: r.n for r in rows}
    total = df.get(-1, 0)
    return np.log((1 + total) / (1 + np.array([df.get(k, 0) for k in range(DIMENSIONS)], float))) + 1


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader with elastic net, one document at a time in a fixed order."""
    z, s = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(f):
        zf = z[f]
        return np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(s[f])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            f, x, y = rows[k]
            f, x = np.r_[f, DIMENSIONS], np.r_[x, 1.0]
            w = weights(f)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            grown = s[f] + g * g
            z[f] += g - (np.sqrt(grown) - np.sqrt(s[f])) / ALPHA * w
            s[f] = grown
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1], w[-1]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature that makes the labels y likeliest under logits z, by a search on a logarithmic grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame) -> Model | None:
    """From text and non-null lang of the learnable rows of docs (doc_id, text, lang); None if there are none.

    At most PER_LANGUAGE different ids of each language, fewer where there are many languages, fit the weights, by their
    FIT_NGRAMS commonest n-grams; a fifth of them fits the temperature instead. Document frequencies are of all learnable rows,
    repeated ones included. A null text counts as empty; an id with several languages may teach each; ids and languages that
    tie are taken in order of hash, id and name; other columns are ignored.
    """
    learn = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = class_sizes(learn, "lang")
    if not sizes:
        return None
    languages = sorted(sizes)
    ids = sample_of_each(learn.select("doc_id", "lang"), "lang", max(LEAST_EACH, min(PER_LANGUAGE, MOST_ROWS // len(languages))), "language", sizes)
    idf = inverse_frequencies(learn)

    def load():
        def one(text: str | None) -> tuple[bytes, bytes]:
            f, n = counts(text or "")
            if len(f) > FIT_NGRAMS:
                most = np.sort(np.lexsort((f, -n))[:FIT_NGRAMS])
                f, n = f[most], n[most]
            return f.astype("<i4").tobytes(), n.astype("<i4").tobytes()

        return lambda batch: pd.DataFrame([one(t) for t in batch], columns=["f", "n"])

    sample = learn.join(F.broadcast(ids), ["doc_id", "lang"])
    got = sample.select("doc_id", "lang", scored("text", "f binary, n binary", load).alias("r")).select("doc_id", "lang", "r.*").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang, r.f, r.n))  # a bounded sample; sorting it in Spark would compute it twice
    rows, number = [], {name: k for k, name in enumerate(languages)}
    for r in got:
        f = np.frombuffer(r.f, "<i4").astype(np.int64)
        rows.append((f, tfidf(f, np.frombuffer(r.n, "<i4"), idf), number[r.lang]))
    fit = [r for k, r in enumerate(rows) if k % 5 or len(rows) < 5]
    model = sparse(languages, idf, *ftrl(fit, len(languages)))
    kept = rows[::5]
    z = np.array([model.logits(f, x) for f, x, _ in kept]).reshape(-1, len(languages))
    model.temperature = temperature(z, np.array([y for _, _, y in kept]))
    return model


def predict(text_col: str | Column, model: Model | None) -> Column:
    """A struct of lang_pred and score, the calibrated probability; und with score 0 for null, texts without a letter, or no model.
    Whole texts count; languages that tie go by name; equal texts get equal values."""

    def load():
        def one(text: str | None) -> tuple[str, float]:
            if model is None or not text or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0
            p = softmax(model.logits(*model.vector(text)) / model.temperature)
            k = int(np.argmax(p))
            return model.languages[k], min(1.0, float(p[k]))

        return lambda batch: pd.DataFrame([one(t) for t in batch], columns=["lang_pred", "score"])

    return scored(text_col, "lang_pred string, score double", load)
