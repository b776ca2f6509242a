"""Text analysis as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockml.functions.numeric import let

WORD = r"[\p{L}\p{N}_]{2,}"  # \b\w\w+\b over Unicode


def word_tokens(text: Column, pattern: str = WORD, lowercase: bool = True, stop_words: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def ngrams(tokens: Column, low: int, high: int, joiner: str = " ") -> Column:
    """All runs of low to high tokens, shorter ones first. Null tokens give null."""
    if low == high == 1:
        return tokens

    def of(found: Column, n: int) -> Column:
        if n == 1:
            return found
        runs = F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.array_join(F.slice(found, i, F.lit(n)), joiner))
        return F.when(F.size(found) >= n, runs).otherwise(F.array().cast("array<string>"))

    # the tokens are found once, and not once an n-gram
    return let(tokens, lambda found: F.concat(*(of(found, n) for n in range(low, high + 1))))


def characters(text: Column) -> Column:
    return F.split(text, "")


def without_accents(text: Column, kind: str = "unicode") -> Column:
    """Letters without their marks: ``unicode`` keeps all other characters, ``ascii`` drops those
    beyond ASCII too."""
    plain = F.translate(text, *_ACCENTS)
    plain = F.regexp_replace(plain, r"\p{M}+", "")
    return F.regexp_replace(plain, r"[^\x00-\x7F]+", "") if kind == "ascii" else plain


def _accents() -> tuple[str, str]:
    """Precomposed characters, and the single ones that they are without marks."""
    pairs = []
    for c in range(0xC0, 0x2000):
        base = [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != chr(c):
            pairs.append((chr(c), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTS = _accents()


def char_ngrams(text: Column, low: int, high: int, lowercase: bool = True) -> Column:
    """Character n-grams, runs of white space being one space."""
    plain = F.regexp_replace(F.lower(text) if lowercase else text, r"\s\s+", " ")
    chars = F.when(F.length(plain) > 0, characters(plain)).otherwise(F.array().cast("array<string>"))
    return ngrams(chars, low, high, "")


def char_wb_ngrams(text: Column, low: int, high: int, lowercase: bool = True) -> Column:
    """Character n-grams within words, each word with a space at either end. A word shorter than
    an n-gram counts once as a whole."""
    words = F.filter(F.split(F.lower(text) if lowercase else text, r"\s+"), lambda w: w != "")
    # the words with their spaces are variables of what follows, and not made again for each n-gram
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(word: Column) -> Column:
        def runs(k: int) -> Column:
            found = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))
            # a word shorter than the n-gram is its own substring
            return found(F.length(word)) if k == low else F.when(F.length(word) >= k, found(F.length(word))).otherwise(F.array().cast("array<string>"))

        return F.concat(*(runs(k) for k in range(low, high + 1))) if high > low else runs(low)

    return F.flatten(F.transform(padded, of))


def flesch_kincaid_grade(sentences: Column, words: Column, syllables: Column) -> Column:
    """0 where there are no words or sentences."""
    grade = 0.39 * words / sentences + 11.8 * syllables / words - 15.59
    return F.when((words == 0) | (sentences == 0), F.lit(0.0)).otherwise(grade)
