"""Quality rules by distribution divergence.

A document's histogram of character classes, and its histogram over its language's most common
words (and the rest), are compared to the language's own by Jensen-Shannon distance. Documents
too short for a histogram are not judged by it.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockml.session import col, fresh, materialise

WORD = re.compile(r"\w+")
CLASSES = ("upper", "letter", "number", "space", "punctuation", "other")


@functools.lru_cache
def classes() -> np.ndarray:
    """Code point -> index in CLASSES."""
    out = np.full(0x110000, 5, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        out[c] = 0 if k == "Lu" else {"L": 1, "N": 2, "P": 4}.get(k[0], 5)
    out[[9, 10, 13, 32]] = 3
    return out


def class_counts(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(classes()[c], minlength=len(CLASSES))


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two count vectors: the square root of the divergence in bits."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def references(docs: DataFrame, top: int = 50, text: str = "text", lang: str = "lang") -> dict:
    """Per language, over all its documents: class counts, its ``top`` most common words (ties
    in string order) with their counts, and the count of all other words.

    Rows with a null text or language are left out; an empty text counts for nothing. Repeated rows
    count as often as they occur. An empty table, or one without languages, gives no references.
    """

    def rows(words, kinds):
        found = [(n, True, w, c) for n in words for w, c in words[n].items()]
        found += [(n, False, CLASSES[k], int(c)) for n in kinds for k, c in enumerate(kinds[n])]
        for k in range(0, len(found), 200_000):
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "word", "item", "n"), map(list, zip(*found[k : k + 200_000])))))

    def run(batches):
        words, kinds = {}, {}
        for b in batches:
            for name, t in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                words.setdefault(name, Counter()).update(WORD.findall(t.lower()))
                kinds[name] = kinds.get(name, 0) + class_counts(t)
            if sum(map(len, words.values())) > 500_000:
                yield from rows(words, kinds)
                words, kinds = {}, {}
        yield from rows(words, kinds)

    labelled = docs.where(col(lang).isNotNull() & col(text).isNotNull()).select(col(lang).alias("lang"), col(text).alias("text"))
    counts = materialise(labelled.mapInArrow(run, "lang string, word boolean, item string, n long").groupBy("lang", "word", "item").agg(F.sum("n").alias("n")), "word-counts")
    # words are ranked by themselves, so that each task keeps its own first ones before the shuffle
    said = counts.where("word").select("lang", "item", "n")
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    common = said.select("lang", "item", "n", k.alias("k")).where(F.col("k") <= top).select("lang", F.lit(True).alias("word"), "item", "n")
    ranked = common.unionByName(counts.where("NOT word"))
    total = said.groupBy("lang").agg(F.sum("n").alias("n"))
    out: dict = {}
    for r in ranked.collect():  # top + 6 rows a language
        ref = out.setdefault(r["lang"], {"classes": np.zeros(len(CLASSES)), "words": {}, "rest": 0})
        if r["word"]:
            ref["words"][r["item"]] = r["n"]
        else:
            ref["classes"][CLASSES.index(r["item"])] = r["n"]
    for r in total.collect():
        out[r["lang"]]["rest"] = r["n"] - sum(out[r["lang"]]["words"].values())
    return out


class Judge:
    def __init__(self, refs: dict, min_chars: int, min_words: int):
        self.min_chars, self.min_words = min_chars, min_words
        self.refs = {}
        for lang, r in refs.items():
            words = sorted(r["words"])
            index = {w: i for i, w in enumerate(words)}
            self.refs[lang] = (r["classes"], index, np.array([*(r["words"][w] for w in words), r["rest"]], np.float64))

    def __call__(self, text: str | None, lang: str | None) -> tuple[float | None, float | None]:
        if text is None or lang not in self.refs:
            return None, None
        kinds, index, common = self.refs[lang]
        by_class = by_word = None
        if len(text) >= self.min_chars:
            by_class = round(jensen_shannon(class_counts(text), kinds), 6)
        words = WORD.findall(text.lower())
        if len(words) >= self.min_words:
            rest = len(index)
            at = np.fromiter((index.get(w, rest) for w in words), np.int64, len(words))
            by_word = round(jensen_shannon(np.bincount(at, minlength=rest + 1), common), 6)
        return by_class, by_word


def judge(
    docs: DataFrame,
    refs: dict,
    max_class: float = 0.2,
    max_word: float = 0.42,
    min_chars: int = 200,
    min_words: int = 50,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """``docs`` with ``class_distance``, ``word_distance`` and ``kept``.

    A distance is null where the text is null or too short for it (``min_chars``, ``min_words``)
    or its language is null or has no reference; such a rule lets the document pass. The whole
    text counts. Repeated rows get the same answer each; empty tables give empty ones; columns
    with these names are replaced, others pass unchanged.
    """
    held = docs.sparkSession.sparkContext.broadcast(refs)  # a few numbers a language

    def run(batches):
        of = Judge(held.value, min_chars, min_words)
        for texts, langs in batches:
            yield pd.DataFrame([of(t, n) for t, n in zip(texts, langs)], columns=["c", "w"], dtype="float64").astype("Float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, "c double, w double")(col(text), col(lang))
    keep = [col(c) for c in docs.columns if c.lower() not in ("class_distance", "word_distance", "kept")]
    (name,) = fresh(docs.columns, "found")
    c, w = F.col(f"{name}.c"), F.col(f"{name}.w")
    passes = F.coalesce(c <= max_class, F.lit(True)) & F.coalesce(w <= max_word, F.lit(True))
    return docs.select(*keep, found.alias(name)).select(*keep, c.alias("class_distance"), w.alias("word_distance"), passes.alias("kept"))
