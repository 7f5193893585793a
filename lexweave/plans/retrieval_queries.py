"""Ranking over documents, benchmark items and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, retrieval
from .base import query, table


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("t02_bm25", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM d) x GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
s AS (SELECT item_id AS query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) x WHERE rank <= 5""")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_G = r"list_distinct(CASE WHEN length(f) >= 2 THEN list_transform(range(1, length(f)), lambda i: substring(f, i::INT, 2)) WHEN length(f) > 0 THEN [f] ELSE [] END)"


_GRAM_ROWS = r"""SELECT DISTINCT {0}, CASE WHEN n = 1 THEN a ELSE a || b END AS gram FROM (SELECT {0}, len(c) AS n, unnest(c) AS a, unnest(list_append(c[2:], NULL)) AS b
  FROM (SELECT {0}, string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g'), '') AS c FROM {1}) x) y WHERE a <> '' AND (n = 1 OR b IS NOT NULL)"""


@query("t03_lexical", f"""
WITH d AS ({_GRAM_ROWS.format('doc_id', 'documents')}), q AS ({_GRAM_ROWS.format('item_id', 'benchmark')}), z AS (SELECT doc_id, count(*) AS size FROM d GROUP BY 1),
s AS (SELECT item_id AS query_id, doc_id, count(*) / sqrt(size) AS score FROM d JOIN q USING (gram) JOIN z USING (doc_id) GROUP BY item_id, doc_id, size)
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) x WHERE r <= 3""")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 3).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("j18_vector_top", """
SELECT query_id, vec_id, round(score, 5) AS score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS r
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) x WHERE r <= 5""")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_top(v, asked, 5).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query("a24_recall_at_k", """
SELECT round(avg(hit), 9) AS recall FROM (SELECT query_id, max(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS hit FROM (
  SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS r FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) x
  JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = x.vec_id WHERE r <= 3 GROUP BY query_id) y""")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = retrieval.vector_top(v, asked, 4).where("query_id != vec_id")
    near = matching.best_first(near, ["query_id"], [F.desc(F.round("score", 9)), F.asc("vec_id")], 3)
    labels = v.select("vec_id", "label")
    both = near.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(labels, "vec_id")
    return both.groupBy("query_id").agg(F.max(F.when(F.col("own") == F.col("label"), 1.0).otherwise(0.0)).alias("hit")).agg(F.round(F.avg("hit"), 9).alias("recall"))


@query("a22_corpus_statistics", r"SELECT count(*) AS docs, round(avg(n), 6) AS mean_terms, max(n) AS longest FROM (SELECT len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n FROM documents) x")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select(F.size(retrieval.terms(F.col("text"))).cast("bigint").alias("n"))
    return n.agg(F.count("*").alias("docs"), F.round(F.avg("n"), 6).alias("mean_terms"), F.max("n").alias("longest"))


@query("m23_lexical_score", f"""
SELECT item_id, round(1 / (1 + exp(-(8 * d - 1.2))), 9) AS score FROM (SELECT item_id, 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) AS d FROM (
  SELECT a.item_id, {_G.replace('(f', '(a.f').replace('[f]', '[a.f]')} AS x, {_G.replace('(f', '(b.f').replace('[f]', '[b.f]')} AS y
  FROM (SELECT item_id, text AS f FROM benchmark) a JOIN (SELECT item_id, text AS f FROM benchmark) b ON b.item_id = a.item_id + 1) z) w""")
def m23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair score of neighbouring items; without Hangul the jamo grams are the character grams."""
    g = table(spark, sf_dir, "benchmark").select("item_id", T.grams(F.col("text")).alias("g"))
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("item_id"), F.round(T.sigmoid(8 * T.dice(F.col("a.g"), F.col("b.g")) - 1.2), 9).alias("score"))


@query("f18_shingle_containment", r"""
WITH s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) x WHERE len(w) >= 5) y),
q AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark) x WHERE len(w) >= 5) y),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared FROM s JOIN q USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.9 * n""")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.9 and more of an item's 5-word shingles; the items' shingles are the small side."""

    def shingled(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, retrieval.terms(F.col("text")).alias("w")).where("size(w) >= 5")
        return words.select(key, F.explode(F.expr("array_distinct(transform(sequence(1, size(w) - 4), i -> array_join(slice(w, i, 5), ' ')))")).alias("g"))

    items = shingled(table(spark, sf_dir, "benchmark"), "item_id")
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n"))
    shared = shingled(table(spark, sf_dir, "documents"), "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return shared.join(sizes, "item_id").where("shared >= 0.9 * n").select("doc_id", "item_id", "shared")
