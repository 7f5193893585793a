"""Aggregates, statistics, calibration and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, matching
from ..operators import evaluation as E
from .base import literal, query, table

_Z = E.Z95
_WILSON = f"greatest((h / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} * sqrt(h / n * (1 - h / n) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 0)"
_WILSON_HIGH = f"least((h / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} * sqrt(h / n * (1 - h / n) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 1)"


@query("a01_group_keys", "SELECT p_brand, p_size, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS parts FROM part GROUP BY ALL")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.array_join(parts, ",").alias("parts"))


@query("a04_gap_mining", """
SELECT event_type, user_id % 7 AS slot, count(*) AS occurrences, count(DISTINCT user_id) AS documents, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS exact_count, count(DISTINCT user_id) >= 2 AND count(*) >= 3 AS is_gap FROM events GROUP BY ALL""")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("slot"))
    return g.agg(F.count("*").alias("occurrences"), F.count_distinct("user_id").alias("documents"), F.count_if(F.col("value") > 50).alias("exact_count")).withColumn("is_gap", (F.col("documents") >= 2) & (F.col("occurrences") >= 3))


@query("a06_wilson", f"SELECT source, n, h, round({_WILSON}, 9) AS low, round({_WILSON_HIGH}, 9) AS high FROM (SELECT source, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS h FROM documents JOIN labels USING (doc_id) GROUP BY 1) x")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").cast("double").alias("n"), F.sum("quality").cast("double").alias("h"))
    low, high = E.wilson(F.col("h"), F.col("n"))
    return g.select("source", "n", "h", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a07_macro_micro", "SELECT round(avg(r), 9) AS macro, round(sum(h) / sum(n), 9) AS micro FROM (SELECT avg(quality) AS r, sum(quality)::DOUBLE AS h, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) x")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("r"), F.sum("quality").alias("h"), F.count("*").alias("n"))
    return g.agg(F.round(F.avg("r"), 9).alias("macro"), F.round(F.sum("h") / F.sum("n"), 9).alias("micro"))


@query("a08_overall_and_slices", "SELECT coalesce(lang, 'ALL') AS slice, count(*) AS n, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupingSets([[], [F.col("lang")]], "lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).select(F.coalesce("lang", F.lit("ALL")).alias("slice"), "n", "good")


@query("a09_percentiles", "SELECT source, s[len(s) // 2 + 1] AS p50, s[(len(s) * 95) // 100 + 1] AS p95, s[ceil(len(s) * 0.95)::INT] AS nearest95 FROM (SELECT source, list(n_chars ORDER BY n_chars) AS s FROM documents GROUP BY 1) x")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three definitions of a percentile by place; equal values are counted first, so no task holds all rows of a source."""
    docs = table(spark, sf_dir, "documents")
    return E.placed_values(docs, "source", "n_chars", {"p50": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.floor(n * 95 / 100) + 1, "nearest95": lambda n: F.ceil(n * 0.95)})


PAIRS = [(1, 0, 0), (2, 1, 5), (3, 3, 9), (4, 10, 10), (5, 0, 8)]


@query("a10_mcnemar", "SELECT * FROM (VALUES (1, 1.0::DOUBLE), (2, 0.21875::DOUBLE), (3, 0.145996094::DOUBLE), (4, 1.0::DOUBLE), (5, 0.0078125::DOUBLE)) AS t(id, p)")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(PAIRS, "id int, b int, c int").select("id", F.round(E.mcnemar(F.col("b"), F.col("c")), 9).alias("p"))


@query("a14_conformal_quantile", "SELECT lang, len(s) AS n, CASE WHEN ceil((len(s) + 1) * 0.9) <= len(s) THEN s[ceil((len(s) + 1) * 0.9)::INT] ELSE 1.0 END AS quantile FROM (SELECT lang, list(x ORDER BY x) AS s FROM (SELECT lang, round(1 - least(n_chars / 20000.0, 1.0), 9)::DOUBLE AS x FROM documents) y GROUP BY 1) z")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "documents").select("lang", F.round(1 - F.least(F.col("n_chars") / 20000.0, F.lit(1.0)), 9).alias("x"))
    return E.conformal_quantile(scores, ["lang"], "x", 0.1)


@query("a17_coverage", "SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(avg(quality + toxic), 9) AS mean_size FROM labels")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 9).alias("coverage"), F.round(F.avg(F.col("quality") + F.col("toxic")), 9).alias("mean_size"))


@query("a18_training_pairs", "SELECT o_orderkey, m AS member, m = o_orderstatus AS label FROM orders, (VALUES ('F'), ('O'), ('P')) t(m)")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(members).alias("member")).select("o_orderkey", "member", (F.col("member") == F.col("o_orderstatus")).alias("label"))


@query("a25_dictionary_info", "SELECT count(*) AS bindings, count(DISTINCT p_name) AS surfaces, count(DISTINCT p_brand) AS families, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS large FROM part")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count("*").alias("bindings"), F.count_distinct("p_name").alias("surfaces"), F.count_distinct("p_brand").alias("families"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("a26_frequency_catalog", r"SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) x GROUP BY 1) y ORDER BY n DESC, word LIMIT 512")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 512 most frequent words (a top-k report)."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(512)


@query("a27_entity_cards", "SELECT l_suppkey, count(*) AS mentions, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS observed_as FROM lineitem GROUP BY 1")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("mentions"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("observed_as"))


@query("a23_commit_ledger", "SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS commits, sum(CASE WHEN l_discount > 0.05 AND l_tax < 0.04 THEN 1 ELSE 0 END)::BIGINT AS correct FROM lineitem GROUP BY 1")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    commit = F.col("l_discount") > 0.05
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(commit).alias("commits"), F.count_if(commit & (F.col("l_tax") < 0.04)).alias("correct"))


@query("t05_oracle_votes", "SELECT l_partkey, l_suppkey, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_suppkey) AS r FROM (SELECT l_partkey, l_suppkey, count(*) AS votes FROM lineitem GROUP BY 1, 2) y) x WHERE r = 1")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("votes"))
    return matching.best_first(votes, ["l_partkey"], [F.desc("votes"), F.asc("l_suppkey")])


@query("t13_hash_sample", "SELECT doc_id, source, h FROM (SELECT doc_id, source, substring(sha256('seed-' || doc_id), 1, 16) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('seed-' || doc_id), doc_id) AS r FROM documents) x WHERE r <= 5")
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota of five for each source, in the order of a seeded hash (a sampling operator)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.concat(F.lit("seed-"), F.col("doc_id")), 256).alias("h"))
    return matching.best_first(docs, ["source"], [F.asc("h"), F.asc("doc_id")], 5).withColumn("h", F.substring("h", 1, 16))


@query("t10_card_order", "SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_name, c_custkey LIMIT 50")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_name", "c_custkey").limit(50).select("c_custkey")


@query("t14_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(40).limit(20)


@query("a20_components", "SELECT doc_id AS node, doc_id - doc_id % 200 AS comp FROM documents")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked to their neighbour, in chains of 200: each gets the first one of its chain, 199 hops away at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    links = docs.select(F.col("doc_id").alias("a"), F.when(F.col("doc_id") % 200 == 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1).alias("b"))
    return components.components(links).select("node", "comp")
