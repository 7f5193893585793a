"""Composite pipelines: resolving texts, documents in chunks, evidence for questions, conformance, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import text as T
from ..operators import exact, matching, resolve, retrieval, selection
from ..streaming import sessions
from .base import literal, query, table

BINDINGS = [(1, "kepco", "한전", "korean_org_name"), (2, "kepco", "한국전력공사", "korean_org_name"), (3, "net_ap", "AP", "latin_acronym"), (4, "flow_ap", "AP", "latin_acronym"), (5, "fss", "금융감독원", "korean_org_name"), (6, "msit", "과학기술정보통신부", "korean_org_name"), (7, "qms", "QMS", "latin_acronym")]
TEXTS = [(1, "한전은 QMS를 쓴다"), (2, "AP 장애"), (3, "금융감도원에서 발표"), (4, "과기정통부는"), (5, "한전노조가"), (6, "아무 말"), (7, None), (8, "")]


def _given(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(TEXTS, "doc_id int, text string"), spark.createDataFrame(BINDINGS, "item_id int, entity_id string, surface string, profile string")


@query("q01_resolved_fast", "SELECT * FROM " + literal([(1, 0, "한전", "RESOLVED", "kepco"), (1, 4, "QMS", "RESOLVED", "qms"), (2, 0, "AP", "AMBIGUOUS", None), (5, 0, "한전", "RESOLVED", "kepco")], "doc_id", "start", "surface", "link", "entity_id"))
def q01_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic mentions: exact matches, boundaries and tails, the greedy choice."""
    out = resolve.resolved(*_given(spark), fast=True)
    return out.select("doc_id", "start", "surface", F.col("link_decision").alias("link"), "entity_id")


@query("q02_resolved", "SELECT doc_id, start, surface, mention, link, entity_id FROM " + literal([(1, 0, "한전", "TERM", "RESOLVED", "kepco"), (1, 4, "QMS", "TERM", "RESOLVED", "qms"), (2, 0, "AP", "TERM", "AMBIGUOUS", None), (3, 0, "금융감도원", "UNCERTAIN", "AMBIGUOUS", None), (4, 0, "과기정통부", "TERM", "AMBIGUOUS", None), (5, 0, "한전", "TERM", "RESOLVED", "kepco")], "doc_id", "start", "surface", "mention", "link", "entity_id"))
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With recovery and probabilities: a misspelt name stays uncertain, an abbreviation whose tail was inferred is a term without a sure link."""
    out = resolve.resolved(*_given(spark))
    return out.select("doc_id", "start", "surface", F.col("mention_decision").alias("mention"), F.col("link_decision").alias("link"), "entity_id")


@query("r06_surface_records", "SELECT * FROM " + literal([(1, "한전", "한전노조", "DISTINCT_FROM_CORE", "union"), (2, "한전", "전 한전", "SAME_AS_CORE", None), (4, "한전", "한전서울본부", "DISTINCT_FROM_CORE", None)], "doc_id", "core", "whole", "identity", "target"))
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a core links to and what the whole surface denotes; the third text's surface is its core."""
    docs = spark.createDataFrame([(1, "한전노조가 밝혔다"), (2, "전 한전 직원"), (3, "한전은"), (4, "한전서울본부에서도")], "doc_id int, text string")
    held = spark.createDataFrame([("kepco", "노조", "union")], "entity_id string, residual string, target string")
    found = resolve.proposals(docs, spark.createDataFrame(BINDINGS[:1], "item_id int, entity_id string, surface string, profile string"))
    return resolve.surface_records(found, held).select("doc_id", "core", "whole", "identity", "target")


@query("q06_document_job", """
SELECT d.doc_id, b.item_id, count(*) AS n FROM (SELECT doc_id, text FROM documents) d JOIN benchmark b ON contains(d.text, b.text),
LATERAL (SELECT unnest(list_filter(range(0, length(d.text) - length(b.text) + 1), lambda i: substring(d.text, i::INT + 1, length(b.text)) = b.text)) AS p) q GROUP BY ALL""")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents matched in chunks of 2,048 bytes that overlap by the longest item: offsets are shifted back and
    matches that two chunks report are one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("surface"))
    longest = items.agg(F.max(F.length("surface"))).first()[0] or 0
    parts = docs.withColumn("c", C.chunks_udf("text", F.lit(2048))).select("doc_id", "text", F.inline("c"))
    cut = parts.select(F.struct("doc_id", "start").alias("doc_id"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start") + longest - 1).alias("text"))
    found = matching.literal_matches(cut, items)
    at = found.select(F.col("doc_id.doc_id").alias("doc_id"), "item_id", (F.col("start") + F.col("doc_id.start")).alias("start"), (F.col("end") + F.col("doc_id.start")).alias("end"))
    once = at.dropDuplicates(["doc_id", "item_id", "start", "end"])
    return once.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


@query("q08_conformance", "SELECT * FROM " + literal([("ap", 0), ("bare", 0), ("fullwidth", 0), ("hyphen", 0), ("particle", 0), ("spaced", 0)], "form", "missed"))
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form that a profile promises is found again: the fixtures that no match answers are counted by form."""
    b = spark.createDataFrame(BINDINGS, "item_id int, entity_id string, surface string, profile string")
    s = F.col("surface")
    tolerant, latin = F.col("profile") == "korean_org_name", F.col("profile") == "latin_acronym"
    forms = F.filter(F.array(
        F.struct(F.lit("bare").alias("form"), s.alias("text")), F.struct(F.lit("particle").alias("form"), F.concat(s, F.lit("에서")).alias("text")),
        F.struct(F.lit("spaced").alias("form"), F.when(tolerant, F.concat_ws(" ", F.left(s, F.lit(1)), F.substring(s, F.lit(2), F.length(s)))).alias("text")),
        F.struct(F.lit("hyphen").alias("form"), F.when(latin, F.concat_ws("-", F.left(s, F.lit(1)), F.substring(s, F.lit(2), F.length(s)))).alias("text")),
        F.struct(F.lit("fullwidth").alias("form"), F.when(latin, F.translate(s, T.NARROW, T.WIDE)).alias("text")), F.struct(F.lit("ap").alias("form"), F.when(latin, F.lower(s)).alias("text")),
    ), lambda x: x["text"].isNotNull())
    fixtures = b.select("item_id", F.explode(forms).alias("f")).select("item_id", "f.form", F.concat(F.lit("앞 "), "f.text", F.lit(" 뒤")).alias("text")).withColumn("doc_id", F.xxhash64("item_id", "form"))
    found = resolve.proposals(fixtures.select("doc_id", "text"), b).select("doc_id", "item_id").distinct().withColumn("hit", F.lit(1))
    return fixtures.join(found, ["doc_id", "item_id"], "left").groupBy("form").agg(F.count_if(F.col("hit").isNull()).alias("missed"))


@query("q09_mined_gaps", "SELECT * FROM " + literal([("kepco", "서울본부", 2, 2), ("kepco", "노조", 1, 1)], "entity_id", "residual", "occurrences", "documents"))
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows known names in a corpus and is no name of its own."""
    docs = spark.createDataFrame([(1, "한전서울본부에서 회의"), (2, "한전서울본부는"), (3, "한전노조가"), (4, "한전은")], "doc_id int, text string")
    found = resolve.proposals(docs, spark.createDataFrame(BINDINGS[:1], "item_id int, entity_id string, surface string, profile string"))
    return sessions.gaps(found.where("residual != ''").select("entity_id", "residual", "doc_id"))


@query("q10_evidence")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents for every item of the benchmark as a question: lexical and BM25 order, a budget of 3,000
    characters and three passages that do not overlap. The test holds one question against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = docs.select("doc_id", "text", F.explode(T.passages(F.col("text"))).alias("start")).select(F.xxhash64("doc_id", "start").alias("id"), "doc_id", "start", F.least(F.col("start") + 1000, F.length("text")).alias("end"), F.substring("text", F.col("start") + 1, F.lit(1000)).alias("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    passages = parts.select(F.col("id").alias("doc_id"), "text")
    best = {"lexical": retrieval.lexical(passages, asked, 8), "bm25": retrieval.bm25(passages, asked, 8)}
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    lexical, bm25 = (found.select(F.lit(method).alias("method"), "query_id", F.col("doc_id").alias("id"), rank.alias("rank")) for method, found in best.items())
    placed = lexical.unionByName(bm25).join(parts.select("id", "doc_id", "start", "end"), "id")  # the passages are cut once for both
    # spans of different documents never overlap: each document has its own stretch of the line
    line = placed.select(F.struct("method", "query_id").alias("asked"), "rank", (F.col("doc_id") * 10_000_000 + F.col("start")).alias("start"), (F.col("doc_id") * 10_000_000 + F.col("end")).alias("end"))
    kept = selection.within_budget(line, "asked")
    return kept.select("asked.method", "asked.query_id", "place", F.floor(F.col("start") / 10_000_000).alias("doc_id"), (F.col("start") % 10_000_000).alias("start"))


@query("q11_expanded_questions", "SELECT * FROM " + literal([(1, "한전은 왜 한국전력공사"), (2, "아무 질문")], "id", "question"))
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with up to four canonical names of what they mention."""
    rows = spark.createDataFrame([(1, "한전은 왜"), (2, "아무 질문")], "doc_id int, text string")
    names = spark.createDataFrame([("kepco", "한국전력공사")], "entity_id string, canonical string")
    b = spark.createDataFrame(BINDINGS, "item_id int, entity_id string, surface string, profile string")
    found = resolve.resolved(rows, b, fast=True).where("entity_id is not null").join(names, "entity_id")
    more = found.groupBy("doc_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "canonical"))), lambda x: x["canonical"])), 1, 4).alias("c"))
    return rows.join(more, "doc_id", "left").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", F.array_join("c", " ")).alias("question")).withColumn("question", F.trim("question"))
