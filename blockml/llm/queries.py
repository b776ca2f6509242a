"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockml.llm import bpe, langid, nbsvm, quality_rules, toxicity
from blockml.llm.exact_dedup import exact_dedup
from blockml.llm.jaccard_join import near_classes
from blockml.llm.packing import pack
from blockml.llm.sharding import minimax_shards
from blockml.llm.warc import warc_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to."""
    vocabulary = bpe.Vocabulary()
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    # the ids take the text's place, so that it doesn't go through Python
    return bpe.decode(bpe.encode(docs, vocabulary, name="text").withColumnRenamed("text", "tokens"), vocabulary)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), capacity=8192)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = minimax_shards(_documents(spark, sf_dir), n_shards=64)
    return docs.selectExpr("doc_id", "shard", "octet_length(text) AS n_bytes")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on_labels(spark, sf_dir)
    scored = toxicity.with_toxicity(_documents(spark, sf_dir), model)
    return scored.selectExpr("doc_id", "toxicity", "coalesce(toxicity > 0, false) AS toxic")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = nbsvm.fit_on_labels(spark, sf_dir)
    scored = nbsvm.with_score(_documents(spark, sf_dir), model)
    return scored.selectExpr("doc_id", "score", r"coalesce(score <= 0 AND text RLIKE '\\S', false) AS kept")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_documents(spark, sf_dir), n=3, threshold=0.5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs)).select("doc_id", "predicted", "distance")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    judged = quality_rules.judge(docs, quality_rules.references(docs))
    return judged.select("doc_id", "class_distance", "word_distance", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op9_warc": op9_warc,
    "op6_toxicity": op6_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op10_sharding": op10_sharding,
}

_CHARS = "string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ', '')"


def _gram_counts(source: str, by: str) -> str:
    """(by, g, n): counts of the 1- to 3-grams of normalised characters."""
    return f"""SELECT {by}, g, count(*) AS n FROM (
        SELECT {by}, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]),
            list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2]))) AS g
        FROM (SELECT {by}, {_CHARS} AS l FROM {source}) WHERE len(l) > 2) WHERE g <> ' ' GROUP BY {by}, g"""


_CLASSES = ["\\p{Lu}", "\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}", "\\p{N}", " \\t\\n\\r", "\\p{P}"]
_CLASS_COUNTS = ", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g')) AS c{i}" for i, c in enumerate(_CLASSES))


def _divergence(p: str, q: str) -> str:
    """Both halves of the Jensen-Shannon divergence at one item, in bits."""
    m = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END)"


ORACLE_SQL = {
    "op1_ngram_jaccard_join": """
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT text, min(doc_id) AS d, count(*) - 1 AS copies, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS l
            FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '[\\p{L}\\p{N}_]') GROUP BY text),
        g AS MATERIALIZED (
            SELECT DISTINCT d, unnest(CASE WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
                ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS g
            FROM w),
        size AS MATERIALIZED (SELECT d, count(*) AS n FROM g GROUP BY d),
        met AS (SELECT x.d AS a, y.d AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.d < y.d GROUP BY 1, 2),
        pair AS MATERIALIZED (SELECT a, b FROM met JOIN size s ON s.d = a JOIN size t ON t.d = b WHERE met.n / (s.n + t.n - met.n) >= 0.5),
        link AS MATERIALIZED (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
        walk AS (SELECT DISTINCT a AS d, a AS r FROM link UNION SELECT walk.d, link.b FROM walk JOIN link ON link.a = walk.r),
        class AS (SELECT d, min(r) AS c FROM walk GROUP BY d),
        degree AS (SELECT a AS d, count(*) AS k FROM link GROUP BY a)
        SELECT doc_id, coalesce(c, w.d, doc_id) AS class_id, coalesce(copies, 0)::BIGINT AS copies, coalesce(k, 0)::BIGINT AS links
        FROM documents LEFT JOIN w ON w.text = documents.text AND doc_id IS NOT NULL LEFT JOIN class ON class.d = w.d LEFT JOIN degree ON degree.d = w.d""",
    "op3_language_id": f"""
        WITH picked AS (
            SELECT * FROM (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k
                           FROM documents WHERE length(text) >= 200 AND lang IS NOT NULL AND doc_id IS NOT NULL) WHERE k <= 400),
        profile AS (
            SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS r
                           FROM ({_gram_counts("picked", "lang")})) WHERE r < 300),
        doc AS (
            SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r
                           FROM ({_gram_counts("documents", "doc_id")})) WHERE r < 300),
        far AS (
            SELECT doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 300 ELSE abs(p.r - d.r) END) AS distance
            FROM doc d CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = d.g
            GROUP BY doc_id, l.lang)
        SELECT d.doc_id, f.lang AS predicted, f.distance::BIGINT AS distance
        FROM documents d LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS k FROM far) f
        ON d.doc_id = f.doc_id AND f.k = 1""",
    "op7_quality_rules": f"""
        WITH kinds AS (SELECT doc_id, lang, length(text)::DOUBLE AS n, {_CLASS_COUNTS} FROM documents),
        k6 AS (SELECT doc_id, lang, n, unnest([c0, c1, c2, c3, c4, n - c0 - c1 - c2 - c3 - c4]) AS c, unnest(range(6)) AS i FROM kinds),
        ref AS (SELECT lang, i, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM k6 GROUP BY lang, i),
        class AS (
            SELECT doc_id, round(sqrt(greatest(0, sum({_divergence("(d.c / d.n)", "(r.c / r.n)")}) / 2)), 6) AS v
            FROM k6 d JOIN ref r USING (lang, i) WHERE d.n >= 200 GROUP BY doc_id),
        words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
        top AS (
            SELECT * FROM (SELECT lang, w, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS k
                           FROM words GROUP BY lang, w) WHERE k <= 50),
        total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        items AS (
            SELECT lang, w, n FROM top
            UNION ALL
            SELECT t.lang, NULL, t.n - (SELECT sum(n) FROM top WHERE top.lang = t.lang) FROM total t),
        said AS (
            SELECT doc_id, words.lang, top.w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total
            FROM words LEFT JOIN top ON top.lang = words.lang AND top.w = words.w GROUP BY doc_id, words.lang, top.w),
        long AS (SELECT DISTINCT doc_id, lang, total FROM said WHERE total >= 50),
        word AS (
            SELECT l.doc_id, round(sqrt(greatest(0, sum({_divergence("(coalesce(s.n, 0) / l.total)", "(i.n / t.n)")}) / 2)), 6) AS v
            FROM long l JOIN items i ON i.lang = l.lang JOIN total t ON t.lang = l.lang
            LEFT JOIN said s ON s.doc_id = l.doc_id AND s.w IS NOT DISTINCT FROM i.w GROUP BY l.doc_id)
        SELECT d.doc_id, class.v AS class_distance, word.v AS word_distance,
               coalesce(class.v <= 0.2, true) AND coalesce(word.v <= 0.42, true) AS kept
        FROM documents d LEFT JOIN class USING (doc_id) LEFT JOIN word USING (doc_id)""",
    "op9_warc": """
        SELECT page_id, url, html, sha1(html) AS sha1, strlen(html)::BIGINT AS n_bytes, 'ok' AS status FROM pages""",
    "op4_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS k FROM documents)
        WHERE k = 1 OR text IS NULL""",
    "op10_sharding": """
        WITH RECURSIVE g AS MATERIALIZED (
            SELECT doc_id, sum(coalesce(strlen(text), 0))::BIGINT AS s FROM documents GROUP BY doc_id),
        a AS MATERIALIZED (SELECT list({'n': 1::BIGINT, 'c': s} ORDER BY doc_id NULLS FIRST) AS l, max(s)::BIGINT AS m, sum(s)::BIGINT AS t FROM g),
        search AS (
            SELECT greatest(m, (t + 63) // 64)::BIGINT AS lo, t AS hi FROM a
            UNION ALL
            SELECT CASE WHEN f.k <= 64 THEN f.lo ELSE f.mid + 1 END, CASE WHEN f.k <= 64 THEN f.mid ELSE f.hi END
            FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, list_reduce(a.l, lambda x, y:
                    CASE WHEN x.c + y.c <= (lo + hi) // 2 THEN {'n': x.n, 'c': x.c + y.c} ELSE {'n': x.n + 1, 'c': y.c} END).n AS k
                  FROM search, a WHERE lo < hi) f),
        best AS MATERIALIZED (SELECT lo AS c FROM search WHERE lo >= hi),
        r AS MATERIALIZED (SELECT doc_id, s, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS i FROM g),
        walk AS (
            SELECT i, doc_id, 0 AS shard, s AS used FROM r WHERE i = 1
            UNION ALL
            SELECT r.i, r.doc_id, CASE WHEN w.used + r.s <= c THEN w.shard ELSE w.shard + 1 END,
                   CASE WHEN w.used + r.s <= c THEN w.used + r.s ELSE r.s END
            FROM walk w JOIN r ON r.i = w.i + 1, best)
        SELECT d.doc_id, w.shard::INTEGER AS shard, strlen(d.text)::INTEGER AS n_bytes
        FROM documents d JOIN walk w ON d.doc_id IS NOT DISTINCT FROM w.doc_id""",
}
