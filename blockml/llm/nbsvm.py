"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the classes' log-count ratios, and a linear hinge-loss model is
fitted to them by dual coordinate descent. N-grams run over surface tokens (words, runs of
symbols, and two marks: a word in capitals, a word said twice in a row).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockml.session import col, fresh

TOKEN = re.compile(r"\w+|[^\w\s]+")
CAPITALS, AGAIN = "\x01", "\x02"


_LOW = (1 << 32) - 1


def _marks(text: str) -> list[str]:
    """A text's surface tokens, with marks for words in capitals and repeated ones."""
    words = TOKEN.findall(text)
    return [CAPITALS if w.isupper() and len(w) > 1 else AGAIN if w == v else w for v, w in zip([None, *words], words)]


def _coded(text: str, numbers: dict[str, int]) -> np.ndarray:
    """The grams as sorted numbers: a token's own, or in the upper half one more than the first one's."""
    marks = _marks(text)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in marks), np.int64, len(marks))
    return np.unique(np.concatenate([ids, (ids[:-1] + 1) << 32 | ids[1:]]))


def grams(text: str) -> set:
    """Distinct unigrams and bigrams of a text's surface tokens."""
    marks = _marks(text)
    out = set(marks)
    out.update(zip(marks, marks[1:]))
    return out


def fit(texts: list[str], bad: np.ndarray, min_df: int = 3, alpha: float = 1.0, C: float = 1.0, epochs: int = 20, seed: int = 0) -> dict:
    """Weights by n-gram, and under None the intercept; a positive sum means ``bad``."""
    return solve(texts, bad, min_df, alpha, C, epochs, seed)[0]


def solve(texts: list[str], bad: np.ndarray, min_df: int = 3, alpha: float = 1.0, C: float = 1.0, epochs: int = 20, seed: int = 0) -> tuple[dict, dict]:
    """The model, and what it was solved from: rows (n-gram numbers), their scale, ratio, y, cost, the dual
    variables a, weights w and intercept b of the scaled features.

    Minimises (|w|^2 + b^2) / 2 + sum of cost * max(0, 1 - y (w x + b s)) over rows x of unit length with
    a constant feature; a row's cost is ``C`` times what evens out the classes.
    """
    numbers: dict[str, int] = {}
    coded = [_coded(t, numbers) for t in texts]  # as numbers: sets of tuples take ten times the memory
    codes, df = np.unique(np.concatenate([np.zeros(0, np.int64), *coded]), return_counts=True)
    codes = codes[df >= min_df]
    rows = []
    for c in coded:
        at = np.searchsorted(codes, c)
        rows.append(at[(at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == c)] if len(codes) else at[:0])
    words = list(numbers)
    vocabulary = {(words[c & _LOW] if c <= _LOW else (words[(c >> 32) - 1], words[c & _LOW])): i for i, c in enumerate(codes.tolist())}
    del coded, numbers, words
    y = np.where(bad, 1.0, -1.0)
    count = np.zeros((2, len(vocabulary)))
    for r, b in zip(rows, bad):
        count[int(b), r] += 1
    p = (count + alpha) / (count + alpha).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    # dual coordinate descent for the L1 hinge loss; one extra constant feature; rows of unit length
    scale = [1 / max(1e-12, np.sqrt((ratio[r] ** 2).sum() + 1)) for r in rows]
    cost = C * np.where(bad, len(y) / max(1, 2 * bad.sum()), len(y) / max(1, 2 * (~bad).sum()))
    w, b, a = np.zeros(len(vocabulary)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, s = rows[i], scale[i]
            x = ratio[r] * s
            g = y[i] * (w[r] @ x + b * s) - 1
            new = min(max(a[i] - g, 0.0), cost[i])  # the row's squared length is 1
            if new != a[i]:
                d = (new - a[i]) * y[i]
                w[r] += d * x
                b += d * s
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-4:
            break
    weight = w * ratio
    model = {g: float(weight[i]) for g, i in vocabulary.items() if weight[i] != 0}
    model[None] = float(b)
    return model, {"vocabulary": vocabulary, "rows": rows, "scale": np.array(scale), "ratio": ratio, "y": y, "cost": cost, "a": a, "w": w, "b": b}


def score(text: str, model: dict) -> float:
    get = model.get
    return sum([get(g, 0.0) for g in grams(text)]) + model[None]


class Scorer:
    """``score`` over many texts: words become numbers once per worker, the rest is numpy."""

    def __init__(self, model: dict):
        words = sorted({w for g in model if g is not None for w in (g if isinstance(g, tuple) else (g,))} | {CAPITALS, AGAIN})
        self.known = {w: i + 1 for i, w in enumerate(words)}
        self.base = len(words) + 1
        self.single = np.zeros(self.base)
        pairs = {}
        for g, v in model.items():
            if isinstance(g, tuple):
                pairs[self.known[g[0]] * self.base + self.known[g[1]]] = v
            elif g is not None:
                self.single[self.known[g]] = v
        self.codes = np.array(sorted(pairs), np.int64)
        self.double = np.array([pairs[c] for c in sorted(pairs)])
        self.intercept = model[None]
        self.numbers = _Numbers(self.known)

    def __call__(self, text: str) -> float:
        words = TOKEN.findall(text)
        if not words:
            return self.intercept
        if len(self.numbers) > 2_000_000:  # memory only: numbers mean nothing across texts
            self.numbers = _Numbers(self.known)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        again = np.flatnonzero((ids[1:] == ids[:-1]) & (ids[1:] != self.known[CAPITALS])) + 1
        ids[again] = self.known[AGAIN]
        a, b = ids[:-1], ids[1:]
        found = np.unique((a * self.base + b)[(a > 0) & (b > 0)])
        total = self.intercept + self.single[np.unique(ids[ids > 0])].sum()
        if len(found) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
            total += self.double[at[self.codes[at] == found]].sum()
        return float(total)


class _Numbers(dict):
    """A word's number: positive if the model knows it, else a new negative one."""

    def __init__(self, known: dict):
        self.known = known

    def __missing__(self, word: str) -> int:
        mark = CAPITALS if word.isupper() and len(word) > 1 else word
        self[word] = found = self.known.get(mark) or -len(self) - 1
        return found


def training_rows(spark: SparkSession, sf_dir: str, label: str, max_rows: int) -> tuple[list[str], np.ndarray]:
    """At most ``max_rows`` labelled texts, those with the smallest hash of doc_id, and their labels.

    Null keys, labels and texts are left out. Of labels that repeat a key the largest counts, of texts the
    first in order. Without labels, or documents that have them, there are no texts.
    """
    labels = (
        spark.read.parquet(f"{sf_dir}/labels.parquet")
        .where(f"doc_id IS NOT NULL AND {label} IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    # at most max_rows numbers are broadcast
    found = docs.join(F.broadcast(labels), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").toArrow()
    return found["text"].to_pylist(), found["y"].to_numpy().astype(np.int64)


def with_score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's score of ``text`` (positive: low quality); null text scores null.

    The whole text counts; a text without a known n-gram scores the intercept. Repeated rows get the same
    score each; an empty table gives an empty one. A column called ``name`` is replaced; other columns pass
    unchanged.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows

    def run(batches):
        scorer = Scorer(held.value)
        for texts in batches:
            yield texts.map(scorer, na_action="ignore").astype("float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(*(col(c) for c in docs.columns if c.lower() != name.lower()), F.pandas_udf(run, "double")(col(text)).alias(name))


def fit_on_labels(spark: SparkSession, sf_dir: str, max_rows: int = 3000) -> dict:
    """The model for ``labels.quality`` = 0, from at most ``max_rows`` labelled documents.

    With no labels, or labels of one kind, the model scores every text -1: nothing is rejected.
    """
    texts, quality = training_rows(spark, sf_dir, "quality", max_rows)
    if len(set((quality == 0).tolist())) < 2:
        return {None: -1.0}
    return fit(texts, quality == 0)


def reject_low_quality(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not reject, columns unchanged.

    Null and empty texts, and texts without any word or symbol, are rejected: there is nothing
    to train on. Repeated rows get the same verdict each; empty tables give empty tables.
    """
    (s,) = fresh(docs.columns, "score")
    scored = with_score(docs, model, text, s)
    return scored.where((F.col(s) <= 0) & col(text).rlike(r"\S")).select(*map(col, docs.columns))
