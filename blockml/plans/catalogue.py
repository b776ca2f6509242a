"""Queries over the test tables and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockml.functions.text import char_wb_ngrams, flesch_kincaid_grade
from blockml.operators import arrays, cluster, compose, decompose, forest, linear, naive_bayes, neighbors, preprocess
from blockml.operators.dataset import Dataset
from blockml.operators.vectorizers import CountVectorizer, DictVectorizer, HashingVectorizer, TfidfTransformer
from blockml.sources.tables import dataset, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def _round(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


# blocks

_LAYOUT = """
    WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
    p AS (SELECT o_orderkey, pos, ((pos + 1) * 4 - 1) // n AS part, n FROM o),
    q AS (SELECT o_orderkey, part, (pos - part * n // 4) // 1000 AS inner_block, n FROM p),
    b AS (SELECT o_orderkey, part::INTEGER AS part, dense_rank() OVER (ORDER BY part, inner_block) - 1 AS block FROM q)"""


def _orders(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", block_size=1000, partitions=4)


@query("block_layout", _LAYOUT + "SELECT part, block, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM b GROUP BY part, block")
def block_layout(spark, sf_dir):
    return _orders(spark, sf_dir).blocked().groupBy("part", "block").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


def _blocks(name: str, index, picked: str):
    sql = _LAYOUT + f""", m AS (SELECT max(block) + 1 AS k FROM b),
        pick AS ({picked})
        SELECT out_block, b.block, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM b JOIN pick USING (block) GROUP BY out_block, b.block"""

    @query(name, sql)
    def run(spark, sf_dir):
        return _orders(spark, sf_dir).blocks(index).groupBy("out_block", "block").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


_blocks("block_get", 3, "SELECT 3 AS block, 0::BIGINT AS out_block")
_blocks("block_slice_step", slice(1, None, 2), "SELECT r AS block, (r - 1) // 2 AS out_block FROM m, range(1, k, 2) t(r)")
_blocks("block_slice_reverse", slice(None, None, -3), "SELECT r AS block, (k - 1 - r) // 3 AS out_block FROM m, range(k - 1, -1, -3) t(r)")
_blocks("block_fancy", [2, 0, -1], "SELECT 2 AS block, 0::BIGINT AS out_block UNION ALL SELECT 0, 1 UNION ALL SELECT k - 1, 2 FROM m")


@query("dict_project", "SELECT event_id, value, event_type FROM events")
def dict_project(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "events"), "event_id")[:, ["value", "event_type"]].df


@query("dict_transform_column", "SELECT event_id, event_type, round(value * 2 + 1, 6) AS value FROM events")
def dict_transform_column(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    return ds.transform("value", lambda v: F.round(v * 2 + 1, 6)).df


@query("dataset_shape", "SELECT count(*) AS n, max(len(embedding))::BIGINT AS d, (count(*) * max(len(embedding)))::BIGINT AS size FROM embeddings")
def dataset_shape(spark, sf_dir):
    ds = Dataset(_embeddings(spark, sf_dir), "row_id")
    n, d = ds.shape("X")
    return spark.createDataFrame([(n, d, ds.size("X"))], "n long, d long, size long")


@query("dataset_zip", "SELECT vec_id AS row_id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def dataset_zip(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    left, right = Dataset(e.select("row_id", F.round(F.get("X", F.lit(0)), 6).alias("first")), "row_id"), Dataset(e.select("row_id", F.col("y").alias("label")), "row_id")
    return left.zip(right).df


@query("row_positions", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer")
def row_positions(spark, sf_dir):
    return dataset(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").df


# arrays


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("X"), F.col("label").alias("y"))


_LONG = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INTEGER AS feature FROM embeddings"

for _how, _f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
    for _axis in (None, 0, 1):
        _by = {None: "", 0: "feature, ", 1: "vec_id AS row_id, "}[_axis]
        _group = {None: "", 0: " GROUP BY feature", 1: " GROUP BY vec_id"}[_axis]

        def _run(spark, sf_dir, how=_how, axis=_axis):
            got = arrays.reduce(_embeddings(spark, sf_dir), how, axis)
            return got.select(*got.columns[:-1], _round("value"))

        query(f"array_{_how}_{'none' if _axis is None else f'axis{_axis}'}", f"SELECT {_by}round({_f}(v), 6) AS value FROM ({_LONG}){_group}")(_run)


@query("array_prod", "SELECT round(product(1 + c_acctbal / 1e8), 6) AS value FROM customer")
def array_prod(spark, sf_dir):
    return arrays.reduce(table(spark, sf_dir, "customer").select(F.array(1 + F.col("c_acctbal") / 1e8).alias("X")), "prod").select(_round("value"))


@query("array_prod_axis1", "SELECT p_partkey AS row_id, round(p_size * p_retailprice, 4) AS value FROM part")
def array_prod_axis1(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("X"))
    return arrays.reduce(x, "prod", 1).select("row_id", _round("value", 4))


_OTHER = (2.0, -3.0, 0.5)
_CELLS = ("p_size::DOUBLE", "(p_retailprice - 1000)", "(p_partkey % 7 - 3)::DOUBLE")
for _name, _e in {
    "add": "{a} + {b}", "subtract": "{a} - {b}", "multiply": "{a} * {b}", "divide": "{a} / {b}", "floor_divide": "floor({a} / {b})",
    "mod": "{a} - floor({a} / {b}) * {b}", "fmod": "{a} % {b}", "power": "CASE WHEN {a} < 0 AND {b} = 0.5 THEN NULL ELSE pow({a}, {b}) END",
}.items():

    def _run(spark, sf_dir, name=_name):
        cells = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") - 1000, (F.col("p_partkey") % 7 - 3).cast("double"))
        got = table(spark, sf_dir, "part").select("p_partkey", arrays.elementwise(cells, _OTHER, name).alias("x"))
        return got.select("p_partkey", *(F.round(F.when(~F.isnan(c := F.get("x", F.lit(i))), c), 6).alias(f"x{i}") for i in range(3)))

    _sql = ", ".join(f"round({_e.format(a=c, b=f'({o})')}, 6)::DOUBLE AS x{i}" for i, (c, o) in enumerate(zip(_CELLS, _OTHER)))
    query(f"array_{_name}", f"SELECT p_partkey, {_sql} FROM part")(_run)


@query("array_dot", f"SELECT vec_id AS row_id, round(sum(v / (feature + 1)), 6) AS a, round(sum(CASE WHEN feature % 2 = 0 THEN v ELSE -v END), 6) AS b FROM ({_LONG}) GROUP BY vec_id")
def array_dot(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    i = np.arange(Dataset(e).shape("X")[1])
    x = e.select("row_id", arrays.matmul(F.col("X"), np.stack([1 / (i + 1), (-1.0) ** i], 1)).alias("x"))
    return x.select("row_id", F.round(F.get("x", F.lit(0)), 6).alias("a"), F.round(F.get("x", F.lit(1)), 6).alias("b"))


@query("array_flatten", f"SELECT vec_id AS row_id, feature, round(v, 6) AS value FROM ({_LONG})")
def array_flatten(spark, sf_dir):
    return arrays.flatten(_embeddings(spark, sf_dir)).select("row_id", "feature", _round("value"))


_GRID = "SELECT vec_id AS row_id, unnest(range(len(embedding) // 4 * 4)) AS i, unnest(embedding[:len(embedding) // 4 * 4])::DOUBLE AS v FROM embeddings"


def _grid(spark, sf_dir) -> DataFrame:
    """Each vector as a matrix with rows of four."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("X") / 4) - 1), lambda i: F.slice("X", (i * 4 + 1).cast("int"), F.lit(4)))
    return _embeddings(spark, sf_dir).select("row_id", rows.alias("X"))


@query("array_nested_sum_axis1", f"SELECT row_id, (i % 4)::INTEGER AS feature, round(sum(v), 6) AS value FROM ({_GRID}) GROUP BY 1, 2")
def array_nested_sum_axis1(spark, sf_dir):
    return arrays.reduce(_grid(spark, sf_dir), "sum", 1).select("row_id", F.posexplode("value").alias("feature", "value")).select("row_id", "feature", _round("value"))


@query("array_nested_max_axis2", f"SELECT row_id, (i // 4)::INTEGER AS feature, round(max(v), 6) AS value FROM ({_GRID}) GROUP BY 1, 2")
def array_nested_max_axis2(spark, sf_dir):
    return arrays.reduce(_grid(spark, sf_dir), "max", 2).select("row_id", F.posexplode("value").alias("feature", "value")).select("row_id", "feature", _round("value"))


@query("array_nested_mean_axis0", f"SELECT (i // 4)::INTEGER AS feature0, (i % 4)::INTEGER AS feature1, round(avg(v), 6) AS value FROM ({_GRID}) GROUP BY 1, 2")
def array_nested_mean_axis0(spark, sf_dir):
    return arrays.reduce(_grid(spark, sf_dir), "mean", 0).select("feature0", "feature1", _round("value"))


@query("gram", f"WITH l AS MATERIALIZED ({_LONG}) SELECT a.feature AS i, b.feature AS j, round(sum(a.v * b.v), 5) AS value FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2")
def gram(spark, sf_dir):
    g = arrays.gram(_embeddings(spark, sf_dir))
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(g)], "i int, j int, value double").select("i", "j", _round("value", 5))


# sparse arrays: three columns of part, mostly zeros

_DENSE = "SELECT p_partkey, unnest([(p_size % 3)::DOUBLE, CASE WHEN p_partkey % 5 = 0 THEN -p_size ELSE 0 END, 0.0]) AS v, unnest([0, 1, 2]) AS feature FROM part"


def _sparse(spark, sf_dir) -> arrays.Sparse:
    p = table(spark, sf_dir, "part")
    x = F.array((F.col("p_size") % 3).cast("double"), F.when(F.col("p_partkey") % 5 == 0, -F.col("p_size")).otherwise(0).cast("double"), F.lit(0.0))
    return arrays.Sparse.from_dense(p.select(F.col("p_partkey").alias("row_id"), x.alias("X")))


for _how, _f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):

    def _run(spark, sf_dir, how=_how):
        x = _sparse(spark, sf_dir)
        parts = [x.reduce(how, 0).select(F.lit("0").alias("axis"), F.col("feature").cast("long").alias("at"), _round("value")), x.reduce(how, 1).select(F.lit("1").alias("axis"), F.col("row_id").alias("at"), _round("value")), x.reduce(how).select(F.lit("none").alias("axis"), F.lit(0).cast("long").alias("at"), _round("value"))]
        return parts[0].union(parts[1]).union(parts[2])

    query(f"sparse_{_how}", f"""
        WITH l AS ({_DENSE})
        SELECT '0' AS axis, feature::BIGINT AS at, round({_f}(v), 6)::DOUBLE AS value FROM l GROUP BY feature HAVING bool_or(v <> 0)
        UNION ALL SELECT '1', p_partkey, round({_f}(v), 6)::DOUBLE FROM l GROUP BY p_partkey HAVING bool_or(v <> 0)
        UNION ALL SELECT 'none', 0, round({_f}(v), 6)::DOUBLE FROM l""")(_run)  # fmt: skip


@query("tosparse", f"SELECT p_partkey AS row_id, feature, v::DOUBLE AS value FROM ({_DENSE}) WHERE v <> 0")
def tosparse(spark, sf_dir):
    return _sparse(spark, sf_dir).entries


@query("todense", f"SELECT p_partkey AS row_id, feature, v::DOUBLE AS value FROM ({_DENSE})")
def todense(spark, sf_dir):
    return _sparse(spark, sf_dir).to_dense().select("row_id", F.posexplode("X").alias("feature", "value"))


@query("sparse_dot", f"SELECT p_partkey AS row_id, c AS col, sum(v * w)::DOUBLE AS value FROM ({_DENSE}) JOIN (VALUES (0, 0, 2.0), (1, 0, 1.0), (1, 1, -1.0)) m(feature, c, w) USING (feature) WHERE v <> 0 GROUP BY 1, 2")
def sparse_dot(spark, sf_dir):
    other = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0), (1, 1, -1.0)], "feature int, col int, weight double")
    return _sparse(spark, sf_dir).dot(other)


# text

_TOKENS = "SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def _counts_sql(tokens: str = _TOKENS, having: str = "true", vocabulary: str | None = None, value: str = "n") -> str:
    """Counts (row_id, feature, value) of the terms that ``having`` keeps."""
    kept = vocabulary or f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature FROM df WHERE {having}"
    return f"""c AS MATERIALIZED (SELECT row_id, term, count(*) AS n FROM ({tokens}) GROUP BY 1, 2),
        df AS MATERIALIZED (SELECT term, count(*) AS d, sum(n) AS tf FROM c GROUP BY term),
        v AS MATERIALIZED ({kept}),
        counts AS (SELECT row_id, feature, {value}::BIGINT AS value FROM c JOIN v USING (term))"""


_BIGRAMS = """SELECT row_id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term
    FROM (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS l FROM documents)"""
_CHARS_WB = """SELECT row_id, unnest(list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substr(w, i, 3))) AS term
    FROM (SELECT doc_id AS row_id, ' ' || unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+')) || ' ' AS w FROM documents)"""
_TOP = "SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature FROM (SELECT term FROM df ORDER BY tf DESC, term LIMIT 500)"
_FIXED = ["and", "der", "la", "the"]
_FIXED_SQL = "SELECT unnest(['and', 'der', 'la', 'the']) AS term, unnest(range(4)) AS feature"

for _name, _options, _sql in (
    ("count_vectorizer", {}, _counts_sql()),
    ("count_vectorizer_min_df", {"min_df": 5}, _counts_sql(having="d >= 5")),
    ("count_vectorizer_max_df", {"max_df": 0.3, "min_df": 2}, _counts_sql(having="d >= 2 AND d <= 0.3 * (SELECT count(*) FROM documents)")),
    ("count_vectorizer_max_features", {"max_features": 500}, _counts_sql(vocabulary=_TOP)),
    ("count_vectorizer_binary", {"binary": True}, _counts_sql(value="1")),
    ("count_vectorizer_bigram", {"ngram_range": (1, 2), "min_df": 3}, _counts_sql(_BIGRAMS, "d >= 3")),
    ("count_vectorizer_char_wb", {"analyzer": "char_wb", "ngram_range": (3, 3), "min_df": 3}, _counts_sql(_CHARS_WB, "d >= 3")),
    ("count_vectorizer_fixed_vocab", {"vocabulary": _FIXED}, _counts_sql(vocabulary=_FIXED_SQL)),
):

    def _run(spark, sf_dir, options=_options):
        d = _docs(spark, sf_dir)
        return CountVectorizer(**options).fit_transform(d)

    query(_name, f"WITH {_sql} SELECT row_id, feature, value FROM counts")(_run)


@query("vocabulary", f"WITH {_counts_sql()} SELECT term, d AS df, tf::BIGINT AS tf, feature FROM df JOIN v USING (term)")
def vocabulary(spark, sf_dir):
    return CountVectorizer().fit(_docs(spark, sf_dir)).vocabulary_


def _tfidf_sql(tf: str = "value", smooth: int = 1, norm: str = "sqrt(sum(w * w) OVER (PARTITION BY row_id))") -> str:
    return f"""WITH {_counts_sql(having="d >= 2")},
        idf AS (SELECT feature, ln(((SELECT count(*) FROM documents) + {smooth}) / (count(*) + {smooth})::DOUBLE) + 1 AS idf FROM counts GROUP BY feature),
        w AS (SELECT row_id, feature, {tf} * idf AS w FROM counts JOIN idf USING (feature))
        SELECT row_id, feature, round(w / {norm}, 6) AS value FROM w"""


for _name, _options, _sql in (
    ("tfidf", {}, _tfidf_sql()),
    ("tfidf_sublinear", {"sublinear_tf": True}, _tfidf_sql("(ln(value) + 1)")),
    ("tfidf_l1", {"norm": "l1"}, _tfidf_sql(norm="sum(abs(w)) OVER (PARTITION BY row_id)")),
    ("tfidf_no_smooth", {"smooth_idf": False, "norm": None}, _tfidf_sql(smooth=0, norm="1")),
):

    def _run(spark, sf_dir, options=_options):
        d = _docs(spark, sf_dir)
        counts = CountVectorizer(min_df=2).fit_transform(d, reused=True)
        return TfidfTransformer(**options).fit(counts, d.count()).transform(counts).select("row_id", "feature", _round("value"))

    query(_name, _sql)(_run)


@query("hashing_vectorizer")
def hashing_vectorizer(spark, sf_dir):
    return HashingVectorizer().transform(_docs(spark, sf_dir)).select("row_id", "feature", _round("value"))


@query("dict_vectorizer", """
    WITH e AS (SELECT event_id AS row_id, 'event_type=' || event_type AS term, 1.0::DOUBLE AS value FROM events
               UNION ALL SELECT event_id, 'value', value FROM events
               UNION ALL SELECT event_id, k, json_extract_string(props, '$.' || k)::DOUBLE FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)),
    v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature FROM (SELECT DISTINCT term FROM e))
    SELECT row_id, feature, value FROM e JOIN v USING (term)""")
def dict_vectorizer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "event_type", "value", F.from_json("props", "map<string,double>").alias("props"))
    return DictVectorizer().fit_transform(e)


@query("feature_union", f"""
    WITH {_counts_sql(having="d >= 3").replace("counts AS", "counts1 AS")},
    {_counts_sql(_CHARS_WB, "d >= 3").replace("c AS M", "c2 AS M").replace("df AS M", "df2 AS M").replace("v AS M", "v2 AS M").replace("FROM c GROUP", "FROM c2 GROUP").replace("FROM df WHERE", "FROM df2 WHERE").replace("FROM c JOIN v ", "FROM c2 JOIN v2 ").replace("counts AS", "counts2 AS")}
    SELECT row_id, feature, value * 2.0::DOUBLE AS value FROM counts1
    UNION ALL SELECT row_id, feature + (SELECT count(*) FROM v), value::DOUBLE FROM counts2""")
def feature_union(spark, sf_dir):
    d = _docs(spark, sf_dir)
    parts = [("words", CountVectorizer(min_df=3)), ("chars", CountVectorizer(min_df=3, analyzer=lambda t: char_wb_ngrams(t, 3, 3)))]
    return compose.FeatureUnion(parts, weights={"words": 2.0}, n_jobs=2).fit_transform(d)


@query("flesch_kincaid", """
    WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[.!?]+')) AS s, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS w,
                      len(regexp_extract_all(lower(text), '[aeiouy]+')) AS y FROM documents)
    SELECT doc_id, round(CASE WHEN w = 0 OR s = 0 THEN 0 ELSE .39 * w / s + 11.8 * y / w - 15.59 END, 6)::DOUBLE AS grade FROM t""")
def flesch_kincaid(spark, sf_dir):
    count = lambda text, pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    low = F.lower("text")
    grade = flesch_kincaid_grade(count(F.col("text"), "[.!?]+"), count(low, r"[\p{L}\p{N}_]{2,}"), count(low, "[aeiouy]+"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(grade, 6).alias("grade"))


# preprocessing


@query("standard_scaler", f"""
    WITH l AS ({_LONG}), m AS (SELECT feature, avg(v) AS m, sqrt(var_pop(v)) AS s FROM l GROUP BY feature)
    SELECT vec_id AS row_id, feature, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM l JOIN m USING (feature)""")
def standard_scaler(spark, sf_dir):
    x = preprocess.StandardScaler().fit_transform(_embeddings(spark, sf_dir))
    return x.select("row_id", F.posexplode("X").alias("feature", "value")).select("row_id", "feature", _round("value"))


@query("standard_scaler_sparse", f"""
    WITH l AS ({_DENSE}), m AS (SELECT feature, sqrt(var_pop(v)) AS s FROM l GROUP BY feature)
    SELECT p_partkey AS row_id, feature, round(v / CASE WHEN s = 0 THEN 1 ELSE s END, 6)::DOUBLE AS value FROM l JOIN m USING (feature) WHERE v <> 0""")
def standard_scaler_sparse(spark, sf_dir):
    return preprocess.StandardScaler(with_mean=False).fit_transform(_sparse(spark, sf_dir)).entries.select("row_id", "feature", _round("value"))


@query("variance_threshold", """
    WITH l AS (SELECT p_partkey, unnest([p_size::DOUBLE, 1.0, p_retailprice]) AS v, unnest([0, 1, 2]) AS f FROM part),
    kept AS (SELECT f, (row_number() OVER (ORDER BY f) - 1)::INTEGER AS feature FROM l GROUP BY f HAVING var_pop(v) > 0.1)
    SELECT p_partkey AS row_id, feature, v AS value FROM l JOIN kept USING (f)""")
def variance_threshold(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size").cast("double"), F.lit(1.0), "p_retailprice").alias("X"))
    return preprocess.VarianceThreshold(0.1).fit_transform(x).select("row_id", F.posexplode("X").alias("feature", "value"))


_LABELS = "SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS y FROM events"


@query("label_encoder", f"SELECT event_id, y FROM ({_LABELS})")
def label_encoder(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("y"))
    return preprocess.LabelEncoder().fit_transform(e)


@query("label_inverse", "SELECT event_id, event_type AS y FROM events")
def label_inverse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("y"))
    encoder = preprocess.LabelEncoder().fit(e)
    return encoder.inverse_transform(encoder.transform(e))


@query("truncated_svd")
def truncated_svd(spark, sf_dir):
    model = decompose.TruncatedSVD(4, "gram").fit(_embeddings(spark, sf_dir))
    return model.transform(_embeddings(spark, sf_dir)).select("row_id", F.posexplode("X").alias("component", "value")).select("row_id", "component", _round("value", 5))


@query("truncated_svd_em")
def truncated_svd_em(spark, sf_dir):
    model = decompose.TruncatedSVD(2, "em", random_state=0).fit(_embeddings(spark, sf_dir))
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(model.singular_values_)], "component int, value double")


# models

def _gauss_sql(long: str = _LONG, floor: str = "1e-9") -> str:
    return f"""
    WITH l AS MATERIALIZED ({long}),
    p AS (SELECT label, feature, count(*) AS n, avg(v) AS m, greatest(var_pop(v), {floor}) AS s FROM l GROUP BY label, feature),
    prior AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM embeddings GROUP BY label),
    j AS (SELECT l.vec_id, p.label, max(ln(prior.n / prior.total)) - 0.5 * sum(ln(2 * pi() * s) + (v - m) * (v - m) / s) AS j
          FROM l JOIN p USING (feature) JOIN prior ON prior.label = p.label GROUP BY l.vec_id, p.label)"""


_GAUSS = _gauss_sql()
_SCALED = f"""
    SELECT vec_id, label, feature, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS v
    FROM ({_LONG}) JOIN (SELECT feature, avg(v) AS m, sqrt(var_pop(v)) AS s FROM ({_LONG}) GROUP BY feature) USING (feature)"""


@query("gaussian_nb_fit", f"SELECT label AS y, feature, round(avg(v), 6) AS theta, round(var_pop(v), 6) AS sigma FROM ({_LONG}) GROUP BY 1, 2")
def gaussian_nb_fit(spark, sf_dir):
    m = naive_bayes.GaussianNB().fit(_embeddings(spark, sf_dir))
    rows = [(c, f, float(m.theta_[i, f]), float(m.sigma_[i, f])) for i, c in enumerate(m.classes_) for f in range(m.theta_.shape[1])]
    return spark.createDataFrame(rows, "y int, feature int, theta double, sigma double").select("y", "feature", _round("theta"), _round("sigma"))


@query("gaussian_nb_predict", _GAUSS + "SELECT vec_id AS row_id, arg_max(label, (j, -label)) AS prediction FROM j GROUP BY vec_id")
def gaussian_nb_predict(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return naive_bayes.GaussianNB().fit(e).predict(e).select("row_id", "prediction")


@query("gaussian_nb_proba", _GAUSS + """
    SELECT vec_id AS row_id, (row_number() OVER (PARTITION BY vec_id ORDER BY label) - 1)::INTEGER AS at,
           round(exp(j - max(j) OVER w) / sum(exp(j - m)) OVER w, 6) AS value
    FROM (SELECT *, max(j) OVER (PARTITION BY vec_id) AS m FROM j) WINDOW w AS (PARTITION BY vec_id)""")
def gaussian_nb_proba(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    got = naive_bayes.GaussianNB().fit(e).predict_proba(e)
    return got.select("row_id", F.posexplode("proba").alias("at", "value")).select("row_id", "at", _round("value"))


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(entries, labels) of the labelled documents; the weight is 2 for toxic ones."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"), (F.col("toxic") + 1.0).alias("w"))
    d = _docs(spark, sf_dir).join(labels, "row_id")
    return CountVectorizer(min_df=2).fit_transform(d, reused=True), d.select("row_id", "y", "w")


_LABELLED = "SELECT doc_id AS row_id, quality AS y, toxic + 1.0 AS w FROM labels JOIN documents USING (doc_id)"


def _nb_sql(weight: str = "1.0", kind: str = "multinomial", tfidf: bool = False) -> str:
    tokens = "SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents JOIN labels USING (doc_id)"
    x = "value" if kind == "multinomial" else "1"
    p = "(k + 1.0) / (total + size)" if kind == "multinomial" else "(k + 1.0) / (n + 2.0)"
    logs = f"ln({p})" if kind == "multinomial" else f"ln({p}) - ln(1 - {p})"
    base = "0" if kind == "multinomial" else f"(SELECT sum(ln(1 - {p})) FROM f WHERE f.y = classes.y)"
    counts = _counts_sql(tokens, "d >= 2")
    if tfidf:
        counts = counts.replace("counts AS", "plain AS") + f""",
        idf AS (SELECT feature, ln(((SELECT count(*) FROM ({_LABELLED})) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM plain GROUP BY feature),
        weighted AS (SELECT row_id, feature, value * idf AS value FROM plain JOIN idf USING (feature)),
        counts AS MATERIALIZED (SELECT row_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY row_id)) AS value FROM weighted)"""
    return f"""
        WITH {counts},
        rows AS ({_LABELLED}),
        classes AS (SELECT y, sum({weight})::DOUBLE AS n, sum(sum({weight})) OVER () AS every FROM rows GROUP BY y),
        k AS (SELECT y, feature, sum({x} * {weight})::DOUBLE AS k FROM counts JOIN rows USING (row_id) GROUP BY y, feature),
        f AS MATERIALIZED (SELECT c.y, v.feature, coalesce(k, 0) AS k, c.n, sum(coalesce(k, 0)) OVER (PARTITION BY c.y) AS total, count(*) OVER (PARTITION BY c.y) AS size
              FROM v CROSS JOIN classes c LEFT JOIN k ON k.y = c.y AND k.feature = v.feature),
        start AS (SELECT y, ln(n / every) + {base} AS s FROM classes),
        said AS (SELECT row_id, y, sum({x} * ({logs})) AS s FROM counts JOIN f USING (feature) GROUP BY row_id, y),
        joint AS (SELECT r.row_id, r.y AS truth, start.y AS y, start.s + coalesce(said.s, 0) AS j
                  FROM rows r CROSS JOIN start LEFT JOIN said ON said.row_id = r.row_id AND said.y = start.y),
        best AS (SELECT row_id, any_value(truth) AS truth, arg_max(y, (round(j, 9), -y)) AS prediction FROM joint GROUP BY row_id)"""


@query("multinomial_nb_predict", _nb_sql() + "SELECT row_id, prediction FROM best")
def multinomial_nb_predict(spark, sf_dir):
    data = _labelled(spark, sf_dir)
    return naive_bayes.MultinomialNB().fit(data).predict(data).select("row_id", "prediction")


@query("multinomial_nb_weighted", _nb_sql("w") + "SELECT row_id, y, round(j, 5) AS joint FROM joint")
def multinomial_nb_weighted(spark, sf_dir):
    data = _labelled(spark, sf_dir)
    m = naive_bayes.MultinomialNB(weight="w").fit(data)
    got = m.joint((data[0], data[1].select("row_id")))
    classes = F.array(*map(F.lit, m.classes_))
    return got.select("row_id", F.posexplode("joint").alias("i", "joint")).select("row_id", F.get(classes, "i").alias("y"), _round("joint", 5))


@query("bernoulli_nb_predict", _nb_sql(kind="bernoulli") + "SELECT row_id, prediction FROM best")
def bernoulli_nb_predict(spark, sf_dir):
    data = _labelled(spark, sf_dir)
    return naive_bayes.BernoulliNB().fit(data).predict(data).select("row_id", "prediction")


@query("accuracy", _nb_sql() + "SELECT round(avg((truth = prediction)::INTEGER), 6) AS accuracy FROM best")
def accuracy(spark, sf_dir):
    data = _labelled(spark, sf_dir)
    return spark.createDataFrame([(naive_bayes.MultinomialNB().fit(data).score(data),)], "accuracy double").select(_round("accuracy"))


@query("kfold", """
    WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)
    SELECT vec_id AS row_id, (CASE WHEN pos < n % 3 * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - n % 3 * (n // 3 + 1)) // (n // 3) END)::INTEGER AS fold FROM r""")
def kfold(spark, sf_dir):
    return compose.with_fold(_embeddings(spark, sf_dir).select("row_id"), 3)


@query("grid_search_gaussian_nb", f"""
    WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings),
    k AS MATERIALIZED (SELECT vec_id, CASE WHEN pos < n % 3 * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - n % 3 * (n // 3 + 1)) // (n // 3) END AS fold FROM r),
    l AS MATERIALIZED (SELECT * FROM ({_LONG}) JOIN k USING (vec_id)),
    t AS (SELECT unnest([0, 1, 2]) AS t),
    p AS MATERIALIZED (SELECT t, label, feature, avg(v) AS m, var_pop(v) AS s FROM l JOIN t ON fold <> t GROUP BY t, label, feature),
    prior AS (SELECT t, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY t) AS total FROM embeddings JOIN k USING (vec_id) JOIN t ON fold <> t GROUP BY t, label),
    j AS (SELECT c, l.vec_id, l.label AS truth, p.label, max(ln(prior.n / prior.total)) - 0.5 * sum(ln(2 * pi() * greatest(s, c)) + (v - m) * (v - m) / greatest(s, c)) AS j
          FROM l JOIN p ON p.t = l.fold AND p.feature = l.feature JOIN prior ON prior.t = p.t AND prior.label = p.label CROSS JOIN (VALUES (1e-9), (1.0), (10.0)) f(c)
          GROUP BY c, l.vec_id, l.label, p.label),
    best AS (SELECT c, truth, arg_max(label, (j, -label)) AS prediction FROM j GROUP BY c, vec_id, truth)
    SELECT c::DOUBLE AS var_floor, round(avg((truth = prediction)::INTEGER), 6) AS score FROM best GROUP BY c""")
def grid_search_gaussian_nb(spark, sf_dir):
    search = compose.GridSearchCV(naive_bayes.GaussianNB(), {"var_floor": [1e-9, 1.0, 10.0]}, refit=False, n_jobs=3).fit(_embeddings(spark, sf_dir))
    return spark.createDataFrame([(p["var_floor"], round(m, 6)) for p, m, _ in search.grid_scores_], "var_floor double, score double")


@query("pipeline_tfidf_nb", _nb_sql(tfidf=True) + "SELECT row_id, prediction FROM best")
def pipeline_tfidf_nb(spark, sf_dir):
    entries, rows = _labelled(spark, sf_dir)
    model = TfidfTransformer()
    weighted = model.fit(entries, rows.count()).transform(entries)
    return naive_bayes.MultinomialNB().fit((weighted, rows)).predict((weighted, rows)).select("row_id", "prediction")


@query("pipeline_scaler_gaussian_nb", _gauss_sql(_SCALED, "0") + "SELECT vec_id AS row_id, arg_max(label, (j, -label)) AS prediction FROM j GROUP BY vec_id")
def pipeline_scaler_gaussian_nb(spark, sf_dir):
    """Scaling moves no decision of Gaussian naive Bayes."""
    e = _embeddings(spark, sf_dir)
    return compose.Pipeline([("scale", preprocess.StandardScaler()), ("nb", naive_bayes.GaussianNB(var_floor=0.0))]).fit(e).predict(e).select("row_id", "prediction")


def _prices(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.array("l_quantity").alias("X"), F.col("l_extendedprice").alias("y"), F.pmod(F.col("l_orderkey"), F.lit(8)).alias("block"))


@query("linear_regression_global", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linear_regression_global(spark, sf_dir):
    m = linear.LinearRegression().fit(_prices(spark, sf_dir))
    return spark.createDataFrame([(float(m.coef_[0]), m.intercept_)], "slope double, intercept double").select(_round("slope", 3), _round("intercept", 3))


@query("linear_regression_block_average", """
    SELECT round(avg(s), 3) AS slope, round(avg(i), 3) AS intercept FROM (
        SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY l_orderkey % 8)""")
def linear_regression_block_average(spark, sf_dir):
    m = linear.LinearRegression(strategy="block_average").fit(_prices(spark, sf_dir))
    return spark.createDataFrame([(float(m.coef_[0]), m.intercept_)], "slope double, intercept double").select(_round("slope", 3), _round("intercept", 3))


def _binary(spark, sf_dir) -> DataFrame:
    return _embeddings(spark, sf_dir).withColumn("y", (F.col("y") >= 5).cast("int"))


for _name, _model in (
    ("logistic", lambda: linear.LogisticRegression()),
    ("logistic_l1", lambda: linear.LogisticRegression(penalty="l1")),
    ("linear_svc", lambda: linear.LinearSVC()),
    ("sgd", lambda: linear.SGDClassifier()),
    ("random_forest", lambda: forest.RandomForestClassifier()),
):

    def _run(spark, sf_dir, model=_model):
        e = _binary(spark, sf_dir)
        return model().fit(e).predict(e).select("row_id", "prediction")

    query(_name)(_run)


# clusters and neighbours


def _first(spark, sf_dir, k: int) -> np.ndarray:
    """The first ``k`` vectors by key, as starting centres."""
    return np.array([r["X"] for r in _embeddings(spark, sf_dir).orderBy("row_id").limit(k).collect()])


def _lloyd_sql(rounds: int, final: str) -> str:
    steps = [f"l AS MATERIALIZED ({_LONG})", "c0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS c, feature, v FROM l WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3))"]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c FROM (SELECT l.vec_id, c, sum((l.v - c{k}.v) ** 2) AS d FROM l JOIN c{k} USING (feature) GROUP BY 1, 2) GROUP BY vec_id)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, feature, avg(v) AS v FROM l JOIN a{k} USING (vec_id) GROUP BY 1, 2)")
    return f"WITH {', '.join(steps)} {final}"


@query("kmeans_fixed_init", _lloyd_sql(3, "SELECT c::INTEGER AS c, feature, round(v, 5) AS value FROM c3"))
def kmeans_fixed_init(spark, sf_dir):
    m = cluster.KMeans(3, _first(spark, sf_dir, 3), max_iter=3, tol=-1.0).fit(_embeddings(spark, sf_dir))
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m.cluster_centers_)], "c int, feature int, value double").select("c", "feature", _round("value", 5))


@query("kmeans_predict", _lloyd_sql(3, "SELECT vec_id AS row_id, c::INTEGER AS prediction FROM a2"))
def kmeans_predict(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return cluster.KMeans(3, _first(spark, sf_dir, 3), max_iter=2, tol=-1.0).fit(e).predict(e).select("row_id", "prediction")


@query("kmeans_parallel_init")
def kmeans_parallel_init(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return cluster.KMeans(10).fit(e).predict(e).select("row_id", "prediction")


_UNIT = "u AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def _asked(e: DataFrame) -> DataFrame:
    """The stated query set of the searches, which go over all rows."""
    return e.where("row_id % 20 = 0")


@query("knn_cosine_exact", f"""
    WITH {_UNIT},
    d AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, 1 - list_cosine_similarity(a.e, b.e) AS distance FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)
    SELECT query, neighbor, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM d) WHERE rank <= 5""")
def knn_cosine_exact(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return neighbors.exact(_asked(e), e, 5).select("query", "neighbor", _round("distance"), "rank")


@query("lsh_knn")
def lsh_knn(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return neighbors.LSHForest().fit(e).kneighbors(_asked(e)).select("query", "neighbor", _round("distance"), "rank")


@query("dbscan", """
    WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier),
    core AS MATERIALIZED (SELECT a.id, a.x FROM p a JOIN p b ON abs(a.x - b.x) <= 25 GROUP BY a.id, a.x HAVING count(*) >= 4),
    runs AS (SELECT id, x, sum(CASE WHEN gap > 25 THEN 1 ELSE 0 END) OVER (ORDER BY x, id) AS run FROM (SELECT id, x, x - lag(x) OVER (ORDER BY x, id) AS gap FROM core)),
    named AS MATERIALIZED (SELECT id, x, min(id) OVER (PARTITION BY run) AS cluster FROM runs)
    SELECT p.id AS row_id, coalesce(any_value(n.cluster), min(m.cluster)) AS cluster
    FROM p LEFT JOIN named n ON n.id = p.id LEFT JOIN named m ON abs(m.x - p.x) <= 25 GROUP BY p.id""")
def dbscan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.array("s_acctbal").alias("X"))
    return cluster.dbscan(s, 25.0, 4)
