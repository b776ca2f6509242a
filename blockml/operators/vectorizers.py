"""Text and record features in long form: (key, feature, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from blockml.functions import text as T
from blockml.functions.murmur import murmur3_all, murmur3_column
from blockml.operators.base import Estimator, term_ids
from blockml.session import fresh, materialise

#: Terms, and bytes of them, that a task counts at once; the more, the fewer rows there are of a term.
AT_ONCE, AT_ONCE_BYTES = 1 << 21, 1 << 25
#: Terms that a task hashes at once.
HASHED_AT_ONCE = 1 << 19
#: Rows that a task returns at once.
ROWS = 1 << 16
#: A vocabulary of up to so many bytes is sent to all tasks.
BROADCAST_BYTES = 16 << 20


def normalised(entries: DataFrame, norm: str | None, key: str) -> DataFrame:
    """Rows of length 1 in the given norm."""
    if norm is None:
        return entries
    w = Window.partitionBy(key)
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(w)) if norm == "l2" else F.sum(F.abs("value")).over(w)
    return entries.withColumn("value", F.when(length == 0, F.col("value")).otherwise(F.col("value") / length))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, pa.Array]]:
    """Rows (key, terms) as (keys, number of terms of each, the terms as codes, distinct terms by code), for as
    many rows as have about ``most`` terms, or one row."""

    def gathered():
        whole = pa.Table.from_batches(held)
        keys, lists = (c.combine_chunks() for c in whole.columns)
        found = lists.flatten().dictionary_encode(null_encoding="encode")
        return keys, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), found.indices, found.dictionary

    held, size, space = [], 0, 0
    for b in batches:
        ends, at, before = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(), dtype=np.int64), 0, 0
        while at < b.num_rows:
            to = max(int(np.searchsorted(ends, before + most - size, "right")), at + (not held))
            if to > at:
                held.append(b.slice(at, to - at))
                size, space, before, at = size + ends[to - 1] - before, space + held[-1].nbytes, ends[to - 1], to
            if at < b.num_rows or space > AT_ONCE_BYTES:
                found = gathered()
                held, size, space = [], 0, 0
                yield found
                del found
                pa.default_memory_pool().release_unused()
    if held:
        yield gathered()


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]]) if len(ordered) else np.zeros(1, np.int64)


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for k in range(0, whole.num_rows, ROWS):
        yield whole.slice(k, ROWS)


def _postings(keys: bool):
    """From rows (key, terms), with ``keys``: (term, key of the first row that has it, others, how often each has
    it), the last two null where there are no others and where each has it once; else (term, df, tf). A term
    comes once for each batch."""

    def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
        """Lists of these sizes; null for 0."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=pa.array(sizes == 0))

    def run(batches):
        for ids, sizes, codes, terms in _gathered(batches, AT_ONCE):
            n = max(1, len(ids))
            both = codes.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(ids)), sizes)
            both.sort()
            begin = _runs(both)
            times, both = np.diff(begin), both[begin[:-1]]
            d = np.bincount(both // n, minlength=len(terms))
            begin = np.concatenate([[0], np.cumsum(d)])
            total = np.add.reduceat(times, begin[:-1]) if len(terms) else d
            if keys:
                row, later, more = both % n, np.ones(len(both), bool), total > d
                later[begin[:-1]] = False
                out = {"term": terms, "key": ids.take(pa.array(row[begin[:-1]])), "others": lists(ids.take(pa.array(row[later])), d - 1)}
                out["times"] = lists(pa.array(times[np.repeat(more, d)]), d * more)
            else:
                out = {"term": terms, "df": pa.array(d), "tf": pa.array(total)}
            yield from _batches(out)

    return run


def _hashed(n_features: int, norm: str | None, binary: bool, non_negative: bool, key: str):
    """From rows (key, terms): (key, feature, value)."""

    def run(batches):
        for ids, sizes, codes, terms in _gathered(batches, HASHED_AT_ONCE):
            hashes = murmur3_all(terms.fill_null("")).astype(np.int64)
            lost = terms.is_null().to_numpy(zero_copy_only=False)  # a null term has no feature
            row, code = np.repeat(np.arange(len(ids)), sizes), codes.to_numpy()
            row, code = row[~lost[code]], code[~lost[code]]
            both = row * n_features + (np.abs(hashes) % n_features)[code]
            order = np.argsort(both, kind="stable")
            both, sign = both[order], np.where(hashes >= 0, 1.0, -1.0)[code][order]
            begin = _runs(both)
            value, both = np.add.reduceat(sign, begin[:-1]) if len(both) else sign, both[begin[:-1]]
            value = np.ones(len(value)) if binary else np.abs(value) if non_negative else value
            value, both = value[value != 0], both[value != 0]
            row, feature = both // n_features, both % n_features
            if norm is not None:
                length = np.bincount(row, value * value if norm == "l2" else np.abs(value), len(ids))[row]
                value = value / (np.sqrt(length) if norm == "l2" else length)
            yield from _batches({key: ids.take(pa.array(row)), "feature": pa.array(feature), "value": pa.array(value)})

    return run


def _python(function: Callable, kind: str) -> Callable[[Column], Column]:
    """A Python function of one string, over Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


class _Analyser(Estimator):
    """``preprocessor``, ``tokenizer`` and ``analyzer`` may be functions of a Column, or of a string where
    wrapped in ``python``: those run over Arrow batches. Binary text is decoded as ``encoding`` with
    ``decode_error`` strict, ignore or replace."""

    preprocessor = tokenizer = strip_accents = None
    encoding, decode_error = "utf-8", "strict"

    @staticmethod
    def python(function: Callable, kind: str = "array<string>") -> Callable[[Column], Column]:
        """For ``analyzer`` and ``tokenizer``; a ``preprocessor`` has kind string."""
        return _python(function, kind)

    def _text(self, df: DataFrame) -> Column:
        col = F.col(self.text)
        if dict(df.dtypes)[self.text] == "binary":
            encoding, errors = self.encoding, self.decode_error
            if errors == "strict" and encoding.lower() in ("utf-8", "utf8"):
                col = F.decode(F.when(F.is_valid_utf8(col.cast("string")) | col.isNull(), col).otherwise(F.raise_error(F.lit("text is not UTF-8")).cast("binary")), "utf-8")
            else:
                col = _python(lambda b: bytes(b).decode(encoding, errors), "string")(col)
        if self.preprocessor:
            return self.preprocessor(col)
        col = F.lower(col) if self.lowercase else col
        return T.without_accents(col, self.strip_accents) if self.strip_accents else col

    def _tokens(self, df: DataFrame) -> Column:
        """The terms of a row as an array, as often as they occur."""
        if self.strip_accents not in (None, "ascii", "unicode"):
            raise ValueError(f"no strip_accents {self.strip_accents}")
        low, high = self.ngram_range
        if callable(self.analyzer):
            tokens = self.analyzer(F.col(self.text))
        elif self.analyzer == "word":
            text = self._text(df)
            words = self.tokenizer(text) if self.tokenizer else T.word_tokens(text, self.token_pattern, False)
            if self.stop_words:
                words = F.filter(words, lambda t: ~t.isin(*self.stop_words))
            tokens = T.ngrams(words, low, high)
        elif self.analyzer in ("char", "char_wb"):
            tokens = (T.char_ngrams if self.analyzer == "char" else T.char_wb_ngrams)(self._text(df), low, high, False)
        else:
            raise ValueError(f"no analyzer {self.analyzer}")
        return tokens

    def terms(self, df: DataFrame) -> DataFrame:
        """(key, term), as often as a term occurs."""
        return df.select(self.key, F.explode(self._tokens(df)).alias("term"))

    def _arrays(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.key).alias("key"), self._tokens(df).alias("terms"))

    def _apart(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows whose key no other row has, and the others, of which there mostly are none (None). Null is
        a key like any other."""
        (name,) = fresh(df.columns, "repeated")
        repeated = materialise(df.select(F.col(self.key).alias(name)).groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name), "repeated-keys")
        if repeated.isEmpty():
            return df, None
        same = F.col(self.key).eqNullSafe(F.col(name))
        return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


class CountVectorizer(_Analyser):
    """Counts of terms. Features are numbered in code point order of the terms.

    ``min_df`` and ``max_df`` are numbers of documents (int) or shares (float). Beyond
    ``max_features`` the terms with the most occurrences stay, ties in term order. ``analyzer`` is
    word, char, char_wb, or a function from the text column to an array of terms. Rows without a
    term have no entry.
    """

    def __init__(
        self,
        key: str = "row_id",
        text: str = "text",
        analyzer: str | Callable[[Column], Column] = "word",
        ngram_range: tuple[int, int] = (1, 1),
        min_df: int | float = 1,
        max_df: int | float = 1.0,
        max_features: int | None = None,
        vocabulary: list[str] | None = None,
        binary: bool = False,
        lowercase: bool = True,
        stop_words: list[str] | None = None,
        token_pattern: str = T.WORD,
        strip_accents: str | None = None,
        preprocessor: Callable[[Column], Column] | None = None,
        tokenizer: Callable[[Column], Column] | None = None,
        encoding: str = "utf-8",
        decode_error: str = "strict",
    ):
        self.strip_accents, self.preprocessor, self.tokenizer, self.encoding, self.decode_error = strip_accents, preprocessor, tokenizer, encoding, decode_error
        self.key, self.text, self.analyzer, self.ngram_range = key, text, analyzer, ngram_range
        self.min_df, self.max_df, self.max_features, self.vocabulary = min_df, max_df, max_features, vocabulary
        self.binary, self.lowercase, self.stop_words, self.token_pattern = binary, lowercase, stop_words, token_pattern

    def _counts(self, df: DataFrame) -> DataFrame:
        return self.terms(df).groupBy(self.key, "term").agg(F.count("*").alias("value"))

    def _postings(self, once: DataFrame, more: DataFrame | None, keys: bool = True) -> DataFrame:
        """With ``keys``: (term, key, others, times), the rows that have the term and how often; ``others`` is null
        where there are none, ``times`` for once each. Else (term, df, tf). Of a term there are some rows: one for
        each batch of a task. Rows of equal keys count as one."""
        kind, schema = once.schema[self.key].dataType, S.StructType().add("term", "string")
        if keys:
            schema = schema.add("key", kind).add("others", S.ArrayType(kind)).add("times", S.ArrayType(S.LongType()))
        else:
            schema = schema.add("df", "long").add("tf", "long")
        found = self._arrays(once).mapInArrow(_postings(keys), schema)
        if more is None:
            return found
        columns = [F.col(self.key).alias("key"), F.lit(None).cast(schema["others"].dataType).alias("others"), F.array("value").alias("times")] if keys else [F.lit(1).cast("long").alias("df"), F.col("value").alias("tf")]
        return found.union(self._counts(more).select("term", *columns))

    @staticmethod
    def _sums() -> tuple[Column, Column]:
        """df and tf of a row of postings."""
        df = F.when(F.col("others").isNull(), F.lit(1)).otherwise(F.size("others") + 1).cast("long")
        return df, F.when(F.col("times").isNull(), df).otherwise(F.aggregate("times", F.lit(0).cast("long"), lambda s, v: s + v))

    def fit(self, df: DataFrame) -> CountVectorizer:
        """Learns ``vocabulary_`` (term, df, tf, feature) and ``stop_words_`` (term: those cut; found again when
        they are asked for)."""
        if self.vocabulary is not None:
            rows = [(t, i) for i, t in enumerate(self.vocabulary)]
            self.vocabulary_ = df.sparkSession.createDataFrame(rows, "term string, feature long")
            return self
        within = self._within(df)
        terms = materialise(self._postings(*self._apart(df), keys=False).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")), "terms")
        return self._learn(terms.where(within), terms)

    def fit_transform(self, df: DataFrame, reused: bool = False) -> DataFrame:
        """As ``fit`` and ``transform``, but the text is analysed once: the counts of the terms that stay are
        written and reread, by term. What is ``reused``, read more than once, is written with its features too."""
        if self.vocabulary is not None:
            return self.fit(df).transform(df)
        within, parts = self._within(df), self._apart(df)
        postings = self._postings(*parts)
        d, t = self._sums()
        if self.min_df != 1 or self.max_df != 1.0:
            w = Window.partitionBy("term")
            postings = materialise(postings.withColumns({"df": F.sum(d).over(w), "tf": F.sum(t).over(w)}).where(within), "postings")
            terms = postings.groupBy("term").agg(F.first("df").alias("df"), F.first("tf").alias("tf"))
            self._learn(terms, self._postings(*parts, keys=False).select("term").distinct())
        else:
            postings = materialise(postings, "postings")
            terms = materialise(postings.groupBy("term").agg(F.sum(d).alias("df"), F.sum(t).alias("tf")), "terms")
            self._learn(terms, terms)
        return self._entries(postings, reused)

    def _within(self, df: DataFrame) -> Column:
        """Whether a term's ``df`` is between the bounds."""
        n = df.count() if isinstance(self.min_df, float) or isinstance(self.max_df, float) else 0
        low = self.min_df if isinstance(self.min_df, int) else self.min_df * n
        high = self.max_df if isinstance(self.max_df, int) else self.max_df * n
        if high < low:
            raise ValueError("max_df corresponds to fewer documents than min_df")
        return F.col("df").between(low, high)

    def _learn(self, kept: DataFrame, every: DataFrame) -> CountVectorizer:
        if self.max_features is not None:
            kept = kept.orderBy(F.desc("tf"), "term").limit(self.max_features)
        numbered = term_ids(kept, "term")
        if numbered.isEmpty():
            raise ValueError("no terms remain; use a lower min_df or a higher max_df" if not every.isEmpty() else "empty vocabulary")
        self.vocabulary_ = numbered
        self.stop_words_ = every.select("term").join(numbered.select("term"), "term", "left_anti")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._entries(self._postings(*self._apart(df)))

    def _entries(self, postings: DataFrame, reused: bool = False) -> DataFrame:
        """(key, feature, value). What is reused is written with its features where the vocabulary is large."""
        known = self.vocabulary_.select("term", "feature")
        size = known.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
        got = postings.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "term").select("feature", "key", "others", "times")
        if reused and size > BROADCAST_BYTES:
            got = materialise(got, "entries")
        keys = F.when(F.col("others").isNull(), F.array("key")).otherwise(F.concat(F.array("key"), "others"))
        times = F.coalesce("times", F.array_repeat(F.lit(1).cast("long"), self._sums()[0].cast("int")))
        cells = F.arrays_zip(keys.alias("key"), times.alias("value"))
        return got.select("feature", F.inline(cells).alias(self.key, "value")).select(self.key, "feature", (F.lit(1).cast("long") if self.binary else F.col("value")).alias("value"))


class HashingVectorizer(_Analyser):
    """Stateless: murmur3 of a term picks its feature and, unless ``non_negative``, its sign."""

    def __init__(
        self,
        key: str = "row_id",
        text: str = "text",
        n_features: int = 1 << 20,
        norm: str | None = "l2",
        binary: bool = False,
        non_negative: bool = False,
        analyzer: str | Callable[[Column], Column] = "word",
        ngram_range: tuple[int, int] = (1, 1),
        lowercase: bool = True,
        stop_words: list[str] | None = None,
        token_pattern: str = T.WORD,
        strip_accents: str | None = None,
        preprocessor: Callable[[Column], Column] | None = None,
        tokenizer: Callable[[Column], Column] | None = None,
        encoding: str = "utf-8",
        decode_error: str = "strict",
    ):
        self.strip_accents, self.preprocessor, self.tokenizer, self.encoding, self.decode_error = strip_accents, preprocessor, tokenizer, encoding, decode_error
        self.key, self.text, self.n_features, self.norm, self.binary, self.non_negative = key, text, n_features, norm, binary, non_negative
        self.analyzer, self.ngram_range, self.lowercase, self.stop_words, self.token_pattern = analyzer, ngram_range, lowercase, stop_words, token_pattern

    def fit(self, df: DataFrame) -> HashingVectorizer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        once, more = self._apart(df)
        schema = S.StructType().add(self.key, df.schema[self.key].dataType).add("feature", "long").add("value", "double")
        got = self._arrays(once).mapInArrow(_hashed(self.n_features, self.norm, self.binary, self.non_negative, self.key), schema)
        return got if more is None else got.union(self._merged(more))

    def _merged(self, df: DataFrame) -> DataFrame:
        """The entries of rows of which several have the same key."""
        counts = self.terms(df).groupBy(self.key, "term").agg(F.count("*").alias("n"))
        h = F.col("h").cast("long")
        signed = counts.withColumn("h", murmur3_column("term")).select(
            self.key,
            F.pmod(F.abs(h), F.lit(self.n_features)).alias("feature"),
            (F.when(h >= 0, F.col("n")).otherwise(-F.col("n"))).cast("double").alias("value"),
        )
        entries = signed.groupBy(self.key, "feature").agg(F.sum("value").alias("value"))
        if self.binary:
            entries = entries.withColumn("value", F.lit(1.0))
        if self.non_negative:
            entries = entries.withColumn("value", F.abs("value"))
        return normalised(entries.where("value <> 0 AND feature IS NOT NULL"), self.norm, self.key)


class TfidfTransformer(Estimator):
    """Counts weighted by ln((n + s) / (df + s)) + 1, s = 1 where smooth."""

    def __init__(self, norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False, key: str = "row_id"):
        self.norm, self.use_idf, self.smooth_idf, self.sublinear_tf, self.key = norm, use_idf, smooth_idf, sublinear_tf, key

    def fit(self, entries: DataFrame, n_rows: int | None = None) -> TfidfTransformer:
        """``n_rows`` counts rows without entries too; by default only those with entries."""
        if self.use_idf:
            n = entries.select(self.key).distinct().count() if n_rows is None else n_rows
            s = float(self.smooth_idf)
            idf = F.log((F.lit(float(n)) + s) / (F.col("df") + s)) + 1.0
            self.idf_ = materialise(entries.groupBy("feature").agg(F.count("*").alias("df")).select("feature", idf.alias("idf")), "idf")
        return self

    def transform(self, entries: DataFrame) -> DataFrame:
        tf = F.log(F.col("value")) + 1.0 if self.sublinear_tf else F.col("value").cast("double")
        out = entries.select(self.key, "feature", tf.alias("value"))
        if self.use_idf:
            out = out.join(self.idf_, "feature").select(self.key, "feature", (F.col("value") * F.col("idf")).alias("value"))
        return normalised(out, self.norm, self.key)


class DictVectorizer(Estimator):
    """Records: string columns give features ``name=value`` of value 1, numbers features ``name``;
    a map column gives a feature an entry. Nulls give none."""

    def __init__(self, key: str = "row_id", columns: list[str] | None = None, separator: str = "="):
        self.key, self.columns, self.separator = key, columns, separator

    def _entries(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        cells = []
        for c in self.columns or [c for c in df.columns if c != self.key]:
            col, kind = F.col(c), kinds[c]
            if kind.startswith("map"):
                continue
            name = F.concat(F.lit(c + self.separator), col) if kind == "string" else F.when(col.isNotNull(), F.lit(c))
            cells.append(F.struct(name.alias("term"), (F.lit(1.0) if kind == "string" else col.cast("double")).alias("value")))
        found = df.select(self.key, F.inline(F.array(*cells))) if cells else None
        for c in self.columns or df.columns:
            if kinds[c].startswith("map"):
                text = kinds[c].endswith(",string>")
                term = F.concat(F.col("k"), F.lit(self.separator), F.col("v")) if text else F.col("k")
                one = df.select(self.key, F.explode(c).alias("k", "v")).select(self.key, term.alias("term"), (F.lit(1.0) if text else F.col("v").cast("double")).alias("value"))
                found = one if found is None else found.union(one)
        return found.where("term IS NOT NULL AND value IS NOT NULL")

    def fit(self, df: DataFrame) -> DictVectorizer:
        self.vocabulary_ = term_ids(self._entries(df).select("term").distinct(), "term")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._entries(df).join(self.vocabulary_, "term").groupBy(self.key, "feature").agg(F.sum("value").alias("value"))
