"""Bounds, fits, selections and comparisons: literal relations with worked-out results, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import selection as P
from ..operators import statistics as S
from .base import literal, query, table

COUNTS = [(0, 0), (0, 10), (0, 299), (1, 10), (5, 100), (10, 10), (3, 2000)]


@query("a11_error_bounds")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact bounds; the test holds them against the binomial sum itself."""
    rows = spark.createDataFrame(COUNTS, "errors int, n int")
    return rows.select("errors", "n", F.round(S.error_bound_udf("errors", "n", F.lit(0.05)), 9).alias("bound"))


@query("a12_threshold_grid", "SELECT l_returnflag AS \"group\", t AS threshold, count(*) AS selected, count(*) FILTER (l_linestatus = 'O') AS errors FROM lineitem, (VALUES (0.02), (0.05), (0.09)) AS v(t) WHERE l_discount >= t GROUP BY ALL")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_discount").cast("double").alias("p"), (F.col("l_linestatus") == "O").alias("wrong"))
    return S.threshold_grid(rows, [0.02, 0.05, 0.09]).select("group", F.col("threshold"), "selected", "errors")


@query("a13_paired_bootstrap", "SELECT count(DISTINCT o_custkey) AS clusters, count(*) AS observations, round(avg((l_tax - l_discount)::DOUBLE), 9) AS estimate, TRUE AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate, which no generator changes, and whether the resampled interval holds it."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    got = S.paired_bootstrap(lines.select("o_custkey", F.col("l_discount").cast("double").alias("left"), F.col("l_tax").cast("double").alias("right")), "o_custkey", 400)
    return spark.createDataFrame([(got["clusters"], got["observations"], round(got["estimate"], 9), got["low"] <= got["estimate"] <= got["high"])], "clusters bigint, observations bigint, estimate double, inside boolean")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select((c / 7.0).alias("score"), (F.pmod(F.col("l_orderkey"), F.lit(7)) < c).alias("label"), (F.col("l_quantity") / 50).cast("double").alias("size"))


@query("a15_platt")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and offset; the test holds them against the same steps over single rows."""
    a, b = S.fit_platt(_judged(spark, sf_dir))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "slope double, offset double")


@query("a16_fusion")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b = S.fit_fusion(_judged(spark, sf_dir), ["score", "size"])
    return spark.createDataFrame([(round(w[0], 6), round(w[1], 6), round(b, 6))], "score double, size double, bias double")


ENTITIES = [("e1", "한국전력", ["energy"]), ("e2", "한국가스", ["energy"]), ("e3", "한라산", ["place"]), ("e4", "서울시", ["place"]), ("e5", "원자력", ["energy", "science"]), ("e6", "나라", [])]


@query("a19_hard_negatives", "SELECT * FROM " + literal([("e1", "e2", 3), ("e1", "e5", 2), ("e4", "e3", 2)], "gold", "entity_id", "score"))
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hardest of two entities, but for those that only the hash tells apart."""
    e = spark.createDataFrame(ENTITIES, "entity_id string, canonical string, domains array<string>")
    return S.hard_negatives(e.where("entity_id in ('e1', 'e4')"), e, 2).where("score > 0").select("gold", "entity_id", "score")


READ = [(1, ["e1"], None), (2, ["e1", "e2"], None), (3, ["e1", "e1", None], None), (4, [], "e9"), (5, [], None), (6, ["e1", "e2"], "e2")]


@query("a05_single_entities", "SELECT * FROM " + literal([(1, "e1"), (2, None), (3, "e1"), (4, "e9"), (5, None), (6, "e2")], "id", "entity_id"))
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(READ, "id int, members array<string>, resolved string")
    return rows.select("id", S.single_entity(F.col("members"), F.col("resolved")).alias("entity_id"))


@query("a21_run_metrics", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS degraded, least(count(*), 512) AS sampled, quantile_disc(value, 0.5) AS all_p50 FROM events")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "error").alias("degraded"))
    return S.run_metrics(rows, "value").select("n", "degraded", "sampled", "all_p50")


RANKED = [("q1", 0, 1000, 1), ("q1", 900, 1900, 2), ("q1", 1800, 2800, 3), ("q1", 2700, 3700, 4), ("q1", 3600, 4600, 5), ("q2", 0, 2000, 1), ("q2", 2000, 4000, 2), ("q2", 4000, 4900, 3), ("q2", 5000, 5100, 4), ("q2", 6000, 6001, 5)]


@query("t04_budgeted_passages", 'SELECT * FROM ' + literal([("q1", 1, 0, 1000), ("q1", 2, 1800, 2800), ("q1", 3, 3600, 4600), ("q2", 1, 0, 2000), ("q2", 2, 4000, 4900), ("q2", 3, 5000, 5100)], "q", "place", "start", '"end"'))
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within_budget(spark.createDataFrame(RANKED, "q string, start int, end int, rank int"), "q")


CENTRES = [("q1", 0, 3), ("q1", 1, 4), ("q1", 2, 1), ("q1", 3, 2), ("q2", 0, 1)]


@query("w07_neighbours", "SELECT * FROM " + literal([("q1", 2, 1), ("q1", 1, 2), ("q1", 3, 3), ("q1", 0, 4), ("q2", 0, 1)], "q", "index", "place"))
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_neighbours(spark.createDataFrame(CENTRES, "q string, index int, rank int"), "q")


PAGES = [(1, "전력 요금 안내\n\nAP 서버 장애 보고\n\n휴가 규정\n\n연락처"), (2, "한 문단"), (3, "\n\n"), (4, "x\n\ny\n\nAP")]


@query("t12_paragraph_window", "SELECT * FROM " + literal([(1, 1, 0, 28), (2, 0, 0, 4), (4, 2, 3, 8)], "doc_id", "selected", "start", '"end"'))
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(PAGES, "doc_id int, text string")
    return P.paragraph_window(docs, F.lit("AP 서버"), F.lit("")).drop("text")


SHEET = "# 개요\n\n본문 하나\n\n[표 1]\n\n1. 첫째\n\n끝"


@query("m18_sections", "SELECT * FROM " + literal([(0, 0, 13), (8, 0, 13), (14, 13, 20), (20, 20, 28), (27, 20, 28)], "place", "start", '"end"'))
def m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(SHEET, i) for i in (0, 8, 14, 20, 27)], "s string, place int")
    return rows.withColumn("x", P.section(F.col("s"), F.col("place"))).select("place", "x.start", "x.end")


SHOWN = [(i, c, r, f) for i, (c, r, f) in enumerate([("public", None, True), ("restricted", None, True), ("internal", "never", True), ("internal", "resolved_only", False), ("internal", "resolved_only", True), (None, "candidate_only", True), (None, "candidate_only", False), ("internal", "always", False)])]


@query("f07_exposure", f"SELECT id, coalesce(c, 'public') <> 'restricted' AND coalesce(r, 'always') <> 'never' AND NOT (coalesce(r, '') = 'resolved_only' AND NOT f) AND NOT (coalesce(r, '') = 'candidate_only' AND f) AS shown FROM {literal(SHOWN, 'id', 'c', 'r', 'f')}")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SHOWN, "id int, c string, r string, f boolean")
    return rows.select("id", P.exposed(F.col("c"), F.col("r"), F.col("f")).alias("shown"))


ABSENT = [(1, "GB"), (2, "한국전력공사"), (3, "없는말"), (4, "A-P"), (5, "zz.top"), (6, "qms")]
HELD = [(1, "the gb unit"), (2, "한국 전력·공사 AP"), (3, "ＱＭＳ"), (4, None)]


@query("f19_absent_surfaces", "SELECT * FROM " + literal([(3, "없는말"), (5, "zz.top")], "item_id", "surface"))
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.absent_surfaces(spark.createDataFrame(ABSENT, "item_id int, surface string"), spark.createDataFrame(HELD, "doc_id int, text string"))


GOLD = [("d1", 0, 2, "ORG"), ("d1", 5, 9, "ORG"), ("d1", 20, 22, "PER"), ("d2", 0, 4, "ORG"), ("d2", 0, 4, "LOC")]
PREDICTED = [("d1", 0, 2), ("d1", 0, 2), ("d1", 7, 12), ("d1", 22, 25), ("d2", 1, 2)]


@query("j22_gold_hits", f"""
SELECT doc, start, "end", kind, EXISTS (SELECT 1 FROM {literal(PREDICTED, 'd', 's', 'e')} WHERE d = g.doc AND s = g.start AND e = g."end") AS exact,
  EXISTS (SELECT 1 FROM {literal(PREDICTED, 'd', 's', 'e')} WHERE d = g.doc AND s < g."end" AND g.start < e) AS overlapping FROM (SELECT * FROM {literal(GOLD, 'doc', 'start', '"end"', 'kind')}) g""")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = spark.createDataFrame(GOLD, "doc_id string, start int, end int, kind string")
    return P.gold_hits(gold, spark.createDataFrame(PREDICTED, "doc_id string, start int, end int")).withColumnRenamed("doc_id", "doc")


@query("u04_ordered_union", "SELECT * FROM " + literal([(1, "b,a,c"), (2, "x"), (3, "")], "id", "names"))
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, ["b", "a", "b"], ["c", "a"]), (2, None, ["x"]), (3, None, None)], "id int, a array<string>, b array<string>")
    return rows.select("id", F.array_join(P.ordered_union(F.col("a"), F.col("b")), ",").alias("names"))


REPLIES = [(1, '{"mentions": [{"surface": "AP", "entity_id": "e1"}, {"entity_id": 5}, {"surface": 7, "entity_id": "e9"}]}'), (2, "not json"), (3, '{"mentions": "x"}'), (4, "[1]"), (5, '{"mentions": []}')]


@query("m25_parsed_replies", "SELECT * FROM " + literal([(1, True, "e1:true,e9:false"), (2, False, ""), (3, False, ""), (4, False, ""), (5, True, "")], "id", "ok", "found"))
def m25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a model's reply names, and whether they were on offer (e1 only)."""
    v = F.try_parse_json("raw")
    raw = F.try_variant_get(v, "$.mentions", "array<variant>")
    ids = F.array_compact(F.transform(raw, lambda m: F.when(F.schema_of_variant(m).rlike(r"entity_id: STRING"), F.try_variant_get(m, "$.entity_id", "string"))))
    rows = spark.createDataFrame(REPLIES, "id int, raw string").select("id", raw.isNotNull().alias("ok"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    return rows.select("id", "ok", F.array_join(F.transform("ids", lambda e: F.concat_ws(":", e, (e == "e1").cast("string"))), ",").alias("found"))


@query("t08_ranked_hypotheses", "SELECT h, row_number() OVER (ORDER BY score DESC, start, e, kind) AS place, allowed FROM " + literal([("h1", 0.5, 3, "e1", "BARE", True), ("h2", 0.9, 3, "e2", "SUFFIX", False), ("h3", 0.5, 1, "e3", "BARE", True), ("h4", 0.5, 1, "e3", "ALIAS", False)], "h", "score", "start", "e", "kind", "allowed"))
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses in the order of their scores; what a guard said of them stays."""
    rows = spark.createDataFrame([("h1", 0.5, 3, "e1", "BARE", True), ("h2", 0.9, 3, "e2", "SUFFIX", False), ("h3", 0.5, 1, "e3", "BARE", True), ("h4", 0.5, 1, "e3", "ALIAS", False)], "h string, score double, start int, e string, kind string, allowed boolean")
    return rows.select("h", F.row_number().over(Window.orderBy(F.desc("score"), "start", "e", "kind")).alias("place"), "allowed")


@query("e03_token_budget", r"SELECT doc_id, sum((w + ceil((n - w) / 3.0))::BIGINT) OVER (PARTITION BY lang ORDER BY doc_id) <= 2000 AS within FROM (SELECT doc_id, lang, length(text) AS n, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS w FROM documents) x")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token counter plugged into a budget: the documents of each language that fit 2,000 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.estimated_tokens(F.col("text")).alias("n"))
    return docs.select("doc_id", (F.sum("n").over(Window.partitionBy("lang").orderBy("doc_id")) <= 2000).alias("within"))


PROOFS = {"proven": [*[(f"f{i}", "fit", None, None) for i in range(3)], *[(f"c{i}", "score", "exact", 1) for i in range(19)]]}
PROOFS["too few"] = PROOFS["proven"][:-1]
PROOFS["shared"] = PROOFS["proven"] + [("f0", "score", "exact", 1)]
PROOFS["twice positive"] = PROOFS["proven"][:-1] + [("c18", "score", "exact", 2)]
PROOFS["no fit"] = PROOFS["proven"][3:]


@query("r05_coverage_proofs", "SELECT * FROM " + literal([("proven", True), ("too few", False), ("shared", False), ("twice positive", False), ("no fit", False)], "proof", "valid"))
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = {k: spark.createDataFrame(v, "component string, part string, group string, positives int") for k, v in PROOFS.items()}
    return spark.createDataFrame([(k, S.coverage_proven(df)) for k, df in held.items()], "proof string, valid boolean")
