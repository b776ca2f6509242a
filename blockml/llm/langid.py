"""Language identification by rank-order profiles.

A profile is a text's (or a language's) most frequent character n-grams in order. A document
gets the language whose profile is nearest by out-of-place distance: the sum over the document's
n-grams of how far their ranks differ, with a fixed penalty for n-grams that the profile lacks.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockml.session import col, fresh


@functools.lru_cache
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def codes(text: str) -> np.ndarray:
    """Lower-case letters with single spaces between words and around the text; the n-grams of
    1 to 3 of them as numbers whose order is that of the strings."""
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[32], c, [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])].astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    one = c << 42
    two = one[:-1] | (c[1:] << 21)
    return np.concatenate([one[one != 32 << 42], two, two[:-1] | c[2:]])


def profile(texts: list[str], size: int) -> np.ndarray:
    """The texts' ``size`` most frequent n-grams, most frequent first, ties in string order."""
    found = np.sort(np.concatenate([codes(t) for t in texts]))
    if not len(found):
        return found
    new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    count = np.diff(np.concatenate([new, [len(found)]]))
    return found[new][np.argsort(-count, kind="stable")[:size]]


def train(docs: DataFrame, size: int = 300, max_docs: int = 400, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, np.ndarray]:
    """A profile per language from at most ``max_docs`` labelled documents of each (those with
    the smallest keys among documents of 200 or more characters; of equal keys the shorter text).

    Rows with a null text, language or key are left out; rows that repeat a picked key and its language
    count too. An empty table, or one of short texts, gives no profile.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "n"))
    # no text in the window: keys are picked first
    long = docs.select(col(key).alias("key"), col(lang).alias("lang"), F.char_length(col(text)).alias("n")).where("n >= 200 AND lang IS NOT NULL AND key IS NOT NULL")
    picked = long.select("key", "lang", "n", rank.alias("k")).where(F.col("k") <= max_docs).select("key", "lang").distinct()
    sample = docs.select(col(key).alias("key"), col(lang).alias("lang"), col(text).alias("text")).where("length(text) >= 200")
    rows = sample.join(F.broadcast(picked), ["key", "lang"]).toArrow()  # max_docs keys a language
    out: dict[str, list[str]] = {}
    for name, t in zip(rows["lang"].to_pylist(), rows["text"].to_pylist()):
        out.setdefault(name, []).append(t)
    return {name: profile(out[name], size) for name in sorted(out)}


class Ranker:
    """Distances of documents to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def __call__(self, text: str) -> tuple[str | None, int | None]:
        doc = profile([text], self.size)
        if not len(doc) or not self.names:
            return None, None
        at = np.searchsorted(self.grams, doc)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != doc] = len(self.grams)
        rank = self.ranks[at]
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(doc))[:, None])).sum(axis=0)
        k = int(far.argmin())
        return self.names[k], int(far[k])


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 300, text: str = "text") -> DataFrame:
    """``docs`` with ``predicted`` (a language) and ``distance``.

    Null texts and texts without a letter have neither. Of equally near languages the first by
    name is taken. The whole text counts. Repeated rows get the same answer each; an empty
    table gives an empty one; columns with these names are replaced, others pass unchanged.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x size numbers

    def run(batches):
        rank = Ranker(held.value, size)
        for texts in batches:
            yield pd.DataFrame([rank(t) if t is not None else (None, None) for t in texts], columns=["lang", "far"]).astype({"far": "Int64"})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, "lang string, far long")(col(text))
    keep = [col(c) for c in docs.columns if c.lower() not in ("predicted", "distance")]
    (name,) = fresh(docs.columns, "found")
    return docs.select(*keep, found.alias(name)).select(*keep, F.col(f"{name}.lang").alias("predicted"), F.col(f"{name}.far").alias("distance"))
