"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows around each hit.

The states of the product automaton are sets of (trie node, edits so far); they are built when first reached and kept, so a
word costs one look-up for each of its characters, and most words die after a few. Terms match whole words with up to one
edit: those of the lexicon and words that are learned from labelled rows. Stems match exactly at the start of a word; they are
learned where several endings bear them out. Words that labelled rows show to be harmless match only as terms. A hit counts as
quotation if quotes enclose it or a word of speaking stands near it, and as abuse otherwise, more so beside a word of address.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import bounded_sample, cut, fresh, scored
from splitfold.shipping import ship

#: Labelled rows of each class that the model is fitted on, at most; learned stems, and learned words, at most; harmless words, at most.
SAMPLE_PER_CLASS, MAX_STEMS, MAX_HARMLESS = 3000, 400, 4000
#: Stems have so many characters; a stem or word needs this G-squared against chance and so many toxic documents.
STEM_LENGTHS, MIN_G2, MIN_DOCS = range(4, 10), 20.0, 4
#: A stem needs so many endings, each in so many toxic documents, and at least half of all endings; a longer stem with this share of its evidence replaces it.
MIN_ENDINGS, ENDING_DOCS, SAME_EVIDENCE = 3, 2, 0.9
#: A word is harmless if so many clean documents have it and the log of the odds is under this; it is toxic from MIN_ODDS on.
HARMLESS_DOCS, HARMLESS_ODDS, MIN_ODDS = 3, 1.0, 2.0
#: Words on each side of a hit that are its context; terms shorter than FUZZY_FROM must match exactly.
CONTEXT, FUZZY_FROM = 6, 5
# The lexicon and the context words.
TERMS = ["asshole", "bastard", "bitch", "clown", "coward", "creep", "crybaby", "cunt", "dickhead", "disgusting", "dumbass", "filth", "fool", "freak", "fucker", "garbage", "halfwit", "idiot", "imbecile", "jerk", "loser", "moron", "motherfucker", "nitwit", "parasite", "pathetic", "pig", "retard", "scum", "scumbag", "shithead", "slut", "stupid", "trash", "twat", "vermin", "wanker", "whore", "worthless"]
SPEAKING = {"called", "calls", "definition", "quote", "quoted", "quotes", "said", "says", "slur", "term", "word", "words", "wrote"}
ADDRESS = {"u", "you", "your", "youre", "yourself", "ur", "tu", "du", "te", "dich"}
WORD = re.compile(r"[^\W_]+")
OPEN, CLOSE = "\"“”„«»‹›'‘’`", "\"“”„«»‹›'‘’`"


class Matcher:
    """The product of a trie of terms and stems with Levenshtein automata of one edit, determinised lazily."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem = [0], [False]  # 1: exact only, 2: with edits
        for words, kind in ((stems, 0), (terms, 1)):
            for w in words:
                node = 0
                for ch in w:
                    if ch not in self.next[node]:
                        self.next[node][ch] = len(self.next)
                        self.next.append({})
                        self.term.append(0)
                        self.stem.append(False)
                    node = self.next[node][ch]
                if kind:
                    self.term[node] = 2 if len(w) >= FUZZY_FROM else 1
                else:
                    self.stem[node] = True
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.verdict: list[int] = []  # of a word that ends here: 0 none, 1 exact, 2 with an edit
        self.passed: list[bool] = []  # a stem ends here
        self.start = self._state(frozenset(self._closed({(0, 0)})))

    def _closed(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With the pairs that skip a character of the term."""
        return pairs | {(n, 1) for node, e in pairs if e == 0 for n in self.next[node].values()}

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.ids:
            self.ids[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            best = 0
            if any(e == 0 and self.term[n] for n, e in pairs):
                best = 1
            elif any(e == 1 and self.term[n] == 2 for n, e in pairs):
                best = 2
            self.verdict.append(best)
            self.passed.append(any(e == 0 and self.stem[n] for n, e in pairs))
        return self.ids[pairs]

    def _move(self, state: int, ch: str) -> int:
        if len(self.sets) > 100_000:  # rebuilt when reached again
            keep = self.sets[state]
            self.ids, self.sets, self.moves, self.verdict, self.passed = {}, [], [], [], []
            self.start = self._state(frozenset(self._closed({(0, 0)})))
            state = self._state(keep)
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if (n := self.next[node].get(ch)) is not None:
                out.add((n, e))
            if e == 0:
                out.add((node, 1))  # a character too many
                out.update((n, 1) for n in self.next[node].values())  # another character
        out = {(n, e) for n, e in self._closed(out) if not (e == 1 and (n, 0) in out)}
        to = self._state(frozenset(out)) if out else -1
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> int:
        """0: no hit, 1: a term, 2: a term with one edit, 3: no term, but starts with a stem."""
        state, stem = self.start, 0
        for ch in word:
            to = self.moves[state].get(ch)
            if to is None:
                to = self._move(state, ch)
            if to < 0:
                return stem
            if self.passed[to]:
                stem = 3
            state = to
        return self.verdict[state] or stem


FEATURES = ["abuse", "edited", "stems", "quoted", "rate"]


@dataclass
class Model:
    stems: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    harmless: list[str] = field(default_factory=list)
    mean: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [1.0, 0.5, 0.5, 0.0, 1.0])
    bias: float = -1.0


class Scorer:
    def __init__(self, model: Model, terms: list[str] | None = None):
        self.model, self.matcher = model, Matcher((TERMS if terms is None else terms) + model.words, model.stems)
        self.harmless = frozenset(model.harmless)
        self.hit: dict[str, int] = {}

    def kind(self, word: str) -> int:
        k = self.matcher.match(word)
        return 0 if k > 1 and word in self.harmless else k

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, float]], int]:
        """(start, end, kind, abuse) of each hit, and the number of words; abuse: 0.1 in a quotation, 1, or 1.5 beside an address."""
        low = text.lower()
        words = WORD.findall(low)
        known = self.hit
        bad = False
        for w in set(words):
            k = known.get(w)
            if k is None:
                if len(known) > 300_000:
                    known.clear()
                k = known[w] = self.kind(w)
            bad = bad or k > 0
        if not bad:
            return [], len(words)
        spans = list(WORD.finditer(low))
        out = []
        for i, m in enumerate(spans):
            if k := known.get(m.group()) or self.kind(m.group()):
                near = {words[j] for j in range(max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)) if j != i}
                enclosed = low[m.start() - 1 : m.start()] in OPEN and low[m.end() : m.end() + 1] in CLOSE and m.start() > 0 and m.end() < len(low)
                opened = low.rfind('"', max(0, m.start() - 60), m.start()) >= 0 and low.find('"', m.end(), m.end() + 60) >= 0
                quoted = enclosed or (opened and bool(near & SPEAKING)) or len(near & SPEAKING) > 1
                out.append((m.start(), m.end(), k, 0.1 if quoted else 1.5 if near & ADDRESS else 1.0))
        return out, len(words)

    def features(self, text: str | None) -> list[float]:
        found, n = self.hits(text or "")
        if not found:
            return [0.0] * len(FEATURES)
        total = lambda kinds: sum(a for _, _, k, a in found if k in kinds)
        quoted = sum(a < 0.5 for *_, a in found)
        return [np.log1p(total((1,))), np.log1p(total((2,))), np.log1p(total((3,))), np.log1p(quoted), np.log1p(100 * total((1, 2, 3)) / max(n, 1))]

    def score(self, rows: np.ndarray) -> np.ndarray:
        m = self.model
        z = ((rows - np.array(m.mean)) / np.array(m.scale)) @ np.array(m.weights) + m.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole words and stems with the number of documents of each label that have them; counted here before the shuffle.

    Words of the lexicon are left out: they need no learning, and their beginnings are no evidence.
    """
    n = [Counter(), Counter()]
    terms = frozenset(TERMS)

    def made():
        keys = list(n[0].keys() | n[1].keys())
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([n[x][k] for k in keys], pa.int64()) for x in (1, 0))]
        n[0].clear()
        n[1].clear()
        return pa.RecordBatch.from_arrays(columns, ["stem", "whole", "pos", "neg"])

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            words = {w for w in WORD.findall((text.as_py() or "").lower()) if len(w) >= STEM_LENGTHS[0]} - terms
            n[label.as_py()].update({(w, True) for w in words} | {(w[:k], False) for w in words for k in STEM_LENGTHS if len(w) >= k})
            if len(n[0]) + len(n[1]) > 1_000_000:
                yield made()
    yield made()


def _longest(evidence: dict[str, int]) -> list[str]:
    """Of stems that begin alike, the shortest one, made as long as nearly all its evidence lets it be."""
    kept: list[str] = []
    for s in sorted(evidence, key=lambda s: (len(s), s)):
        if not any(s.startswith(k) for k in kept):
            kept.append(max((q for q in evidence if q.startswith(s) and evidence[q] >= SAME_EVIDENCE * evidence[s]), key=len))
    return sorted(set(kept), key=lambda s: (-evidence[s], s))[:MAX_STEMS]


def learned(sample: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """From sample (text, label): stems and words of toxic documents that chance doesn't explain, at most MAX_STEMS of each,
    and harmless words that they or the lexicon would otherwise hit by an edit or a stem, at most MAX_HARMLESS."""
    ship(sample.sparkSession)
    totals = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n1, n0 = totals[0] or 0, totals[1] or 0
    if not n1 or not n0:
        return [], [], []
    made = sample.select("text", "label").mapInArrow(_counts, "stem string, whole boolean, pos long, neg long")
    counts = cut(made.groupBy("stem", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    both = F.col("pos") + F.col("neg")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (both * p))).otherwise(0.0)
    g2 = 2 * (part(F.col("pos"), n1 / (n1 + n0)) + part(F.col("neg"), n0 / (n1 + n0)))
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1) / ((F.col("neg") + 0.5) / (n0 + 1)))
    counts = counts.withColumns({"g2": g2, "odds": odds})
    whole, toxic = counts.where("whole"), (F.col("pos") >= MIN_DOCS) & (F.col("g2") >= MIN_G2) & (F.col("odds") >= MIN_ODDS)
    words = [r.stem for r in whole.where(toxic).orderBy(F.desc("g2"), "stem").limit(MAX_STEMS).collect()]
    bears = (F.col("pos") >= ENDING_DOCS) & (F.col("odds") >= MIN_ODDS)
    starts = F.explode(F.array_distinct(F.array(*(F.substring("stem", 1, k) for k in STEM_LENGTHS)))).alias("start")
    of_words = whole.where(both >= ENDING_DOCS).select(starts, bears.cast("int").alias("bears"), "pos").groupBy("start")
    endings = of_words.agg(F.sum("bears").alias("n"), F.count("*").alias("of"), F.sum(F.col("bears") * F.col("pos")).alias("evidence"))
    endings = endings.where((F.col("n") >= MIN_ENDINGS) & (2 * F.col("n") >= F.col("of")))
    found = counts.where(~F.col("whole") & toxic).join(endings, F.col("stem") == F.col("start")).orderBy(F.desc("g2"), "stem").limit(4 * MAX_STEMS)
    stems = _longest({r.stem: r.evidence for r in found.collect()})
    hit = scored("stem", "k int", lambda: _kinds(Model(stems, words)))
    clean = whole.where((F.col("neg") >= HARMLESS_DOCS) & (F.col("odds") < HARMLESS_ODDS)).select("stem", "neg", hit.alias("hit"))
    harmless = [r.stem for r in clean.where("hit.k > 1").select("stem", "neg").orderBy(F.desc("neg"), "stem").limit(MAX_HARMLESS).collect()]
    return stems, words, harmless


def _kinds(model: Model):
    scorer = Scorer(model)
    return lambda batch: pd.DataFrame({"k": [scorer.kind(w) for w in batch]}, dtype="int32")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; classes weigh alike."""
    a = np.c_[x, np.ones(len(x))]
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (share * (p - y)) + l2 * np.r_[w[:-1], 0]
        h = (a * (share * p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w[:-1], float(w[-1])


def fit_hits(x: np.ndarray, unseen: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and bias; more hits never lower the score. unseen: x as if no word had been learned.

    Labelled rows hold hardly any altered term, so each row with terms is fitted once more with all of them altered. And
    learned words hide the stems they begin with, so each row with such words is fitted once more as unseen.
    """
    altered = x[x[:, 0] > 0].copy()
    altered[:, 1] = np.log1p(np.expm1(altered[:, 0]) + np.expm1(altered[:, 1]))
    altered[:, 0] = 0
    hidden = unseen[:, 2] > x[:, 2]
    x, y = np.r_[x, altered, unseen[hidden]], np.r_[y, y[x[:, 0] > 0], y[hidden]]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    hits = [k for k, name in enumerate(FEATURES) if name != "quoted"]
    while True:
        w, bias = fit_logistic(z, y)
        least = min(hits, key=lambda k: w[k])
        if w[least] > -1e-9:
            return mean, scale, np.where(np.isin(np.arange(len(w)), hits), np.maximum(w, 0), w), bias
        z[:, least] = 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learns stems, words and weights from at most SAMPLE_PER_CLASS labelled, learnable documents of each class.

    With one class only, or none, the lexicon's default weights hold. Of repeated rows each counts, while their id is drawn once;
    null ids teach nothing; only doc_id, text and the label are read, whatever other columns there are.
    """
    ids = bounded_sample(labels, label, SAMPLE_PER_CLASS)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label"))
    model = Model(*learned(sample))
    made = scored("text", "f array<double>, unseen array<double>", lambda: _features(model))
    rows = sample.select("label", made.alias("r")).select("label", "r.*").collect()
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return model
    x = np.array([r.f for r in rows])
    mean, scale, w, bias = fit_hits(x, np.array([r.unseen for r in rows]), y)
    model.mean, model.scale, model.weights, model.bias = mean.tolist(), scale.tolist(), w.tolist(), bias
    return model


def _features(model: Model):
    scorer, unseen = Scorer(model), Scorer(replace(model, words=[]))
    return lambda batch: pd.DataFrame({"f": [scorer.features(t) for t in batch], "unseen": [unseen.features(t) for t in batch]})


def score(text_col: str | Column, model: Model) -> Column:
    """A struct of score (0 to 1; null and empty texts score like any text without hits) and hits."""

    def load():
        scorer = Scorer(model)

        def run(batch: pd.Series) -> pd.DataFrame:
            rows = np.array([scorer.features(t) for t in batch]).reshape(-1, len(FEATURES))
            return pd.DataFrame({"score": scorer.score(rows), "hits": rows[:, :3].any(axis=1)})

        return run

    return scored(text_col, "score double, hits boolean", load)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs whose text scores below the threshold; all columns stay, whatever their names. Null and empty texts have no hits and
    stay unless all texts without hits go; repeated rows share their fate."""
    name = fresh("score")
    return docs.withColumn(name, score("text", model)).where(F.col(f"{name}.score") < threshold).drop(name)
