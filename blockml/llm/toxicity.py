"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word-boundary marks), hashed into buckets that
each have a vector. The vectors of a window of words are averaged and go into a softmax over
(clean, toxic); vectors and softmax are trained jointly in numpy, so a misspelt word scores by
the n-grams that it shares with known ones. A document is as toxic as its most toxic window. The
mean of a window of fewer than ``floor`` n-grams is that of as many, the lacking ones being zero
vectors: a few n-grams alone are weak evidence.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockml.llm.nbsvm import training_rows
from blockml.session import col, fresh

WORD = re.compile(r"\w+")
#: Characters whose n-grams are held at once when texts are scored, which takes some 200 bytes each.
PIECE = 1 << 17
#: Characters of texts that are scored at once.
AT_ONCE = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _longer(h: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of ``c`` from those of its (n - 1)-grams."""
    return h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)


def subwords(words: list[str], buckets: int, low: int = 3, high: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams, word by word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _code_points("".join([f"<{w}>" for w in words]))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the word's end
    h = np.zeros(len(c), np.uint64)
    at, found = [], []
    for n in range(1, high + 1):
        h = _longer(h, c, n)
        if n >= low:
            ok = np.flatnonzero(left[: len(h)] >= n)
            at.append(owner[ok])
            found.append((mix(h[ok]) % np.uint64(buckets)).astype(np.int64))
    at = np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return np.concatenate(found)[order], np.bincount(at, minlength=len(words))


def stretches(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover all items in order, of at most ``most`` in sum, or of one item."""
    begin = end = held = 0
    for n in sizes:
        if end > begin and held + n > most:
            yield begin, end
            begin, held = end, 0
        end, held = end + 1, held + n
    if end > begin:
        yield begin, end


def _of_long(word: str, buckets: int, low: int = 3, high: int = 6) -> Iterator[np.ndarray]:
    """The buckets of one word in the order of ``subwords``, a piece of the word at a time."""
    text = f"<{word}>"
    for n in range(low, high + 1):
        for k in range(0, len(text) - n + 1, PIECE):
            c = _code_points(text[k : k + PIECE + n - 1])
            h = np.zeros(len(c), np.uint64)
            for m in range(1, n + 1):
                h = _longer(h, c, m)
            yield (mix(h) % np.uint64(buckets)).astype(np.int64)


def gains(words: list[str], gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``gain`` over the words' n-grams, and how many each word has. Whatever the words, the memory
    besides these is that for about ``PIECE`` characters."""
    sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
    for i, j in stretches((len(w) + 2 for w in words), PIECE):
        if len(words[i]) + 2 > PIECE:
            total, count = 0.0, 0
            for flat in _of_long(words[i], len(gain)):
                total = np.cumsum(np.concatenate([[total], gain[flat]]))[-1]
                count += len(flat)
            sums.append(np.array([total]))
            counts.append(np.array([count]))
        else:
            flat, width = subwords(words[i:j], len(gain))
            sums.append(np.bincount(np.repeat(np.arange(j - i), width), gain[flat], j - i))
            counts.append(width)
    return np.concatenate(sums), np.concatenate(counts)


def windows(count: int, size: int) -> list[tuple[int, int]]:
    """Ranges that cover ``count`` words, of ``size`` to under ``1.5 * size`` words each, half
    overlapping; one range where there are fewer words."""
    if count < 1.5 * size:
        return [(0, count)]
    starts = list(range(0, count - size + 1, size // 2))
    return [(s, s + size) for s in starts[:-1]] + [(starts[-1], count)]


def said_once(ids: np.ndarray) -> np.ndarray:
    """The words without those that only repeat the word before."""
    return ids[np.concatenate([[True], ids[1:] != ids[:-1]])] if len(ids) else ids


def gradients(E: np.ndarray, S: np.ndarray, c: np.ndarray, idx: np.ndarray, share: np.ndarray, row: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted mean cross entropy of softmax(mean of embeddings S + c) over a batch: by the used
    buckets (and which they are), by S and by c. Row r is the mean of E[idx] by ``share`` where ``row`` is r."""
    size = len(marks)
    used = np.flatnonzero(np.bincount(idx, minlength=len(E)))
    # one softmax error for each row, spread by share
    h = np.stack([np.bincount(row, E[idx, q] * share, size) for q in range(E.shape[1])], 1)
    z = h @ S + c
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(size), marks.astype(int)] -= 1
    g = (p * weight[:, None] / size).astype(E.dtype)
    error = g[:, 1]  # that of the other class is its negative
    spread = np.bincount(idx, error[row] * share, len(E))[used].astype(E.dtype)
    return used, spread[:, None] * (S[:, 1] - S[:, 0])[None, :], h.T @ g, g.sum(axis=0)


def fit(texts: list[str], toxic: np.ndarray, buckets: int = 1 << 16, dim: int = 4, window: int = 60, epochs: int = 4, rounds: int = 12, rate: float = 0.03, decay: float = 3e-6, floor: int = 400, batch_size: int = 128, seed: int = 0) -> dict:
    """The trained model. Round 1 trains on whole documents; later rounds stand a document's most
    toxic window in for it, which is what scoring uses."""
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    docs = []
    for t in texts:
        words = WORD.findall(t.lower())
        docs.append(said_once(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)))
    words = list(numbers)
    flat, width = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, j in stretches((len(w) + 2 for w in words), PIECE):
        if len(words[i]) + 2 > PIECE:
            flat += [f.astype(np.int32) for f in _of_long(words[i], buckets)]
            width.append(np.array([sum(range(len(words[i]) - 3, len(words[i]) + 1))]))
        else:
            found, n = subwords(words[i:j], buckets)
            flat.append(found.astype(np.int32))
            width.append(n)
    flat, width = np.concatenate(flat), np.concatenate(width)
    del numbers, words
    begin = np.cumsum(width) - width
    y = toxic.astype(np.float64)
    E = rng.normal(0, 1e-3, (buckets, dim)).astype(np.float32)
    S = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    state = [np.zeros_like(x) for x in (E, S, c) for _ in (0, 1)]

    def bag(ids):
        """Buckets and their shares in the mean."""
        words, n = np.unique(ids, return_counts=True)
        lens = width[words]
        at = np.repeat(begin[words] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return flat[at], (np.repeat(n, lens) / max(floor, (n * lens).sum())).astype(np.float32)

    steps = 0
    for round_ in range(rounds):
        if round_:
            gain = (E @ (S[:, 1] - S[:, 0]))[flat]
            total = np.concatenate([[0], np.cumsum(gain)])
            per_word = total[begin + width] - total[begin]
            del gain, total
            chosen = []
            for d in docs:
                s, n = np.concatenate([[0], np.cumsum(per_word[d])]), np.concatenate([[0], np.cumsum(width[d])])
                i, j = max(windows(len(d), window), key=lambda r: (s[r[1]] - s[r[0]]) / max(floor, n[r[1]] - n[r[0]]))
                chosen.append(d[i:j])
            marks = np.concatenate([y, np.zeros(int((y == 0).sum()))])
            for d in (docs[i] for i in np.flatnonzero(y == 0)):
                spans = windows(len(d), window)
                i, j = spans[rng.integers(len(spans))]
                chosen.append(d[i:j])
        else:
            chosen, marks = docs, y
        weight = np.where(marks == 1, len(marks) / max(1, 2 * marks.sum()), len(marks) / max(1, 2 * (marks == 0).sum()))
        for _ in range(2 if round_ else epochs):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), batch_size):
                batch = order[k : k + batch_size]
                taken = [bag(chosen[i]) for i in batch]  # a batch at a time, for the driver's memory
                idx = np.concatenate([t[0] for t in taken])
                share = np.concatenate([t[1] for t in taken])
                lens = np.array([len(t[0]) for t in taken])
                row = np.repeat(np.arange(len(batch)), lens)
                used, gE, gS, gc = gradients(E, S, c, idx, share, row, marks[batch], weight[batch])
                gE = gE + decay * E[used]
                steps += 1
                fix = np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
                for x, gx, sel, (m, v) in ((E, gE, used, state[0:2]), (S, gS, slice(None), state[2:4]), (c, gc, slice(None), state[4:6])):
                    m[sel] = 0.9 * m[sel] + 0.1 * gx
                    v[sel] = 0.999 * v[sel] + 0.001 * gx**2
                    x[sel] -= rate * fix * m[sel] / (np.sqrt(v[sel]) + 1e-10)
    return {"gain": E @ (S[:, 1] - S[:, 0]), "bias": float(c[1] - c[0]), "window": window, "buckets": buckets, "floor": floor}


class Scorer:
    """Log-odds of the most toxic window. The mean and the softmax are linear, so a word counts
    by the sum of its buckets' gains and by their number."""

    def __init__(self, model: dict):
        self.model = model
        self.reset()

    def reset(self):
        self.numbers: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> list[float]:
        return [v for i, j in stretches(map(len, texts), AT_ONCE) for v in self.some(texts[i:j])]

    def some(self, texts: list[str]) -> list[float]:
        if len(self.numbers) > 1_000_000:  # memory only
            self.reset()
        said = [WORD.findall(t.lower()) for t in texts]
        new = sorted(set().union(*said).difference(self.numbers))
        if new:
            sums, counts = gains(new, self.model["gain"])
            self.sums = np.concatenate([self.sums, sums])
            self.counts = np.concatenate([self.counts, counts])
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        return [self.one(words) for words in said]

    def one(self, words: list[str]) -> float:
        if not words:
            return float("-inf")
        ids = said_once(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        s, n = np.concatenate([[0], np.cumsum(self.sums[ids])]), np.concatenate([[0], np.cumsum(self.counts[ids])])
        i, j = np.array(windows(len(ids), self.model["window"])).T
        return float(((s[j] - s[i]) / np.maximum(self.model["floor"], n[j] - n[i])).max() + self.model["bias"])


_SCORERS: dict = {}  # of this worker, so that words met in one task are known in the next


def fit_on_labels(spark: SparkSession, sf_dir: str, max_rows: int = 4000) -> dict | None:
    """The model for ``labels.toxic``, from at most ``max_rows`` labelled documents; None where
    there are no labels or labels of one kind."""
    texts, toxic = training_rows(spark, sf_dir, "toxic", max_rows)
    if len(set((toxic == 1).tolist())) < 2:
        return None
    return fit(texts, toxic == 1)


def with_toxicity(docs: DataFrame, model: dict | None, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the log-odds of being toxic (positive: toxic).

    Null texts score null. Texts without a word, and all texts under no model, score -infinity.
    The whole text counts. Repeated rows get the same score each; an empty table gives an empty one. A
    column called ``name`` is replaced; other columns pass unchanged.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: one number a bucket
    token = uuid.uuid4().hex

    def run(batches):
        if token not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[token] = Scorer(held.value) if held.value else lambda texts: [float("-inf")] * len(texts)
        for texts in batches:
            out = np.full(len(texts), np.nan)
            there = texts.notna().to_numpy()
            for k in range(0, len(texts), 1000):
                part = np.flatnonzero(there[k : k + 1000]) + k
                out[part] = _SCORERS[token]([texts.iloc[i] for i in part])
            yield pd.Series(out).astype("Float64").mask(~pd.Series(there))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(*(col(c) for c in docs.columns if c.lower() != name.lower()), F.pandas_udf(run, "double")(col(text)).alias(name))


def reject_toxic(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not toxic, columns unchanged; null and empty texts stay.

    Repeated rows get the same verdict each; empty tables give empty tables.
    """
    (s,) = fresh(docs.columns, "toxicity")
    return with_toxicity(docs, model, text, s).where(F.coalesce(F.col(s) <= 0, F.lit(True))).select(*map(col, docs.columns))
