"""Guards, scope rules, scores, budgets and decisions on literal relations; SQL states each rule a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abbreviations as A
from ..operators import decisions as D
from .base import literal, query, quoted, table

#: Readings, and what the rules make of them: written down from the rules, row by row.
READINGS = [
    (1, "jamo", "전", "SAME", "", True, False, False, 1.0, "short_core"), (2, "abbrev", "한국전력", "UNKNOWN", "UNKNOWN", True, True, False, 0.552, "unknown_residual_derivative,inferred_tail"),
    (3, "jamo", "금감원", "DISTINCT", "SUFFIX", True, True, False, 0.552, "typed_derivative,inferred_tail"), (4, "keyboard", "한전", "SAME", "", False, True, True, 0.736, "ungrammatical_particle,inferred_tail"),
    (5, "exact", "전", "DISTINCT", "UNKNOWN", False, True, True, 1.0, ""), (6, "doc_local", "한전", "SAME", "", True, False, True, 1.0, ""), (7, "dense", "한전", "SAME", "UNKNOWN", False, False, False, 0.48, "unknown_residual_derivative,ungrammatical_particle"),
    (8, "jamo", "전", "DISTINCT", "SUFFIX", True, False, False, 0.6, "short_core,typed_derivative"),
]


@query("f08_guard", "SELECT id, commit_allowed, factor::DOUBLE AS factor, reasons FROM " + literal([(r[0], *r[7:]) for r in READINGS], "id", "commit_allowed", "factor", "reasons"))
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:7] for r in READINGS], "id int, channel string, core string, identity string, kind string, grammatical boolean, stripped boolean")
    v = D.guard(F.col("channel"), F.length("core"), F.col("identity"), F.col("kind"), F.col("grammatical"), F.col("stripped"))
    return rows.withColumn("v", v).select("id", "v.commit_allowed", "v.factor", F.array_join("v.reasons", ",").alias("reasons"))


SCOPED = [
    (1, ["hr"], [], "hr", "SERVER_VERIFIED"), (2, ["hr"], [], "it", "AUTH_CLAIM"), (3, [], ["it"], "it", "SERVER_VERIFIED"), (4, [], ["it"], "it", "APPLICATION_VERIFIED"), (5, [], ["it"], "it", "USER_PROVIDED"),
    (6, [], ["it"], "it", "UNTRUSTED_DOCUMENT"), (7, ["it"], ["it"], "it", "UNTRUSTED_DOCUMENT"), (8, [], [], "it", None), (9, ["hr"], ["it"], None, None), (10, ["hr"], ["it"], "it", "AUTH_CLAIM"), (11, ["hr"], ["hr"], "it", None), (12, [], ["it"], "it", None),
]


@query("f09_scope_adjustment", f"""
SELECT id, v IS NOT NULL AND list_contains(deny, v) AND trust IN ('SERVER_VERIFIED', 'AUTH_CLAIM') AS dropped,
  (CASE WHEN v IS NULL THEN 0 WHEN list_contains(deny, v) THEN CASE trust WHEN 'APPLICATION_VERIFIED' THEN -0.2 WHEN 'USER_PROVIDED' THEN -0.1 ELSE 0 END
        WHEN len(allow) = 0 THEN 0 WHEN list_contains(allow, v) THEN 0.05 ELSE -0.08 END)::DOUBLE AS adjustment,
  CASE WHEN v IS NULL OR list_contains(deny, v) OR len(allow) = 0 THEN NULL ELSE list_contains(allow, v) END AS matched
FROM (SELECT id, allow::VARCHAR[] AS allow, deny::VARCHAR[] AS deny, v, coalesce(trust, 'USER_PROVIDED') AS trust FROM {literal(SCOPED, 'id', 'allow', 'deny', 'v', 'trust')}
  UNION ALL SELECT l_orderkey + 1000, CASE WHEN l_linenumber % 2 = 0 THEN ['A', 'R'] ELSE [] END, CASE WHEN l_linenumber % 3 = 0 THEN ['N', 'R'] ELSE [] END, CASE WHEN l_quantity < 45 THEN l_returnflag END,
    coalesce((['SERVER_VERIFIED', 'AUTH_CLAIM', 'APPLICATION_VERIFIED', 'USER_PROVIDED', 'UNTRUSTED_DOCUMENT'])[l_suppkey % 6 + 1], 'USER_PROVIDED') FROM lineitem) x""")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made scopes, and all lines with scopes of their columns."""
    none = F.array().cast("array<string>")
    levels = F.array(*map(F.lit, ("SERVER_VERIFIED", "AUTH_CLAIM", "APPLICATION_VERIFIED", "USER_PROVIDED", "UNTRUSTED_DOCUMENT")))
    allow, deny = (F.when(F.col("l_linenumber") % n == 0, F.array(*map(F.lit, flags))).otherwise(none) for n, flags in ((2, "AR"), (3, "NR")))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey") + 1000, allow, deny, F.when(F.col("l_quantity") < 45, F.col("l_returnflag")), F.get(levels, (F.col("l_suppkey") % 6).cast("int")))
    rows = spark.createDataFrame(SCOPED, "id bigint, allow array<string>, deny array<string>, v string, trust string").union(lines)
    return rows.withColumn("s", D.scope_adjustment(F.col("allow"), F.col("deny"), F.col("v"), F.col("trust"))).select("id", "s.dropped", "s.adjustment", "s.matched")


#: id, channel scores, bonus, scope, document's own alias, reranker, cost, exact, exact senses.
SCORED = [
    (1, {"exact": 1.0}, 0.0, 0.0, False, None, 0.0, True, 1), (2, {"exact": 0.5, "jamo": 0.9}, 0.15, 0.05, False, None, 0.1, True, 4), (3, {"doc_local": 0.85}, 0.0, 0.0, True, None, 0.0, False, 0),
    (4, {"jamo": 0.7}, 0.0375, -0.1, False, 0.9, 0.35, False, 0), (5, {"abbrev": 0.8}, 0.0, 0.0, False, None, 0.0, False, 0), (6, {"dense": 0.6, "abbrev": 0.5}, 0.0, -0.08, False, 0.1, 0.0, False, 1),
    (7, {"exact": 1.0}, 0.0, 0.0, False, None, 0.9, True, 9), (8, {"normalized": 0.97}, 0.15, 0.0, False, None, 0.0, True, 1), (9, {"keyboard": 0.5}, 0.0, 0.0, False, None, 1.0, False, 2), (10, {"exact": 1.0}, 0.15, 0.05, True, 1.0, 0.0, True, 1),
]
_NAMES = ["id", "exact_s", "normalized_s", "doc_local_s", "jamo_s", "keyboard_s", "abbrev_s", "dense_s", "bonus", "scope", "own", "xenc", "cost", "x", "senses"]
_CHANNELS = ("exact", "normalized", "doc_local", "jamo", "keyboard", "abbrev", "dense")
#: What the lines of orders have for scores: a channel by their number, its score by their columns.
_LINE_SCORE = "round(1 - l_discount - l_tax, 2)"
_S = f"""(SELECT * FROM {literal([(i, *[s.get(c) for c in _CHANNELS], *rest) for i, s, *rest in SCORED], *_NAMES)} UNION ALL SELECT l_orderkey + 1000, {', '.join(f"CASE WHEN l_linenumber = {i + 1} OR (l_linenumber = 7 AND {i} IN (0, 3)) THEN {_LINE_SCORE} END" for i in range(7))},
  0.0375 * (l_suppkey % 5), 0.05 * (l_partkey % 3) - 0.05, l_linenumber % 4 = 0, CASE WHEN l_suppkey % 2 = 0 THEN l_discount END, l_tax, l_linenumber IN (1, 2, 7), (l_partkey % 5)::INT FROM lineitem) AS t({', '.join(_NAMES)})"""
_BASE = "greatest(coalesce(exact_s, 0), coalesce(normalized_s, 0), coalesce(doc_local_s, 0), coalesce(jamo_s, 0), coalesce(keyboard_s, 0), coalesce(abbrev_s, 0), coalesce(dense_s, 0))::DOUBLE"
_SCORE = f"round({_BASE} + bonus + CASE WHEN own THEN 0.2 ELSE 0 END + scope + coalesce(0.25 * (xenc - 0.5), 0), 4)::DOUBLE"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made candidates, and all lines of orders as candidates."""
    n, score = F.col("l_linenumber"), F.round(1 - F.col("l_discount") - F.col("l_tax"), 2)
    held = F.array(*[F.struct(F.lit(c).alias("k"), F.when((n == i + 1) | ((n == 7) & F.lit(i in (0, 3))), score).alias("v")) for i, c in enumerate(_CHANNELS)])
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey") + 1000, F.map_from_entries(F.filter(held, lambda x: x["v"].isNotNull())), 0.0375 * (F.col("l_suppkey") % 5), 0.05 * (F.col("l_partkey") % 3) - 0.05, n % 4 == 0,
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_discount")), "l_tax", n.isin(1, 2, 7), (F.col("l_partkey") % 5).cast("int"),
    )
    return spark.createDataFrame(SCORED, "id bigint, scores map<string, double>, bonus double, scope double, own boolean, xenc double, cost double, x boolean, senses int").union(lines)


@query("r01_features", f"""
SELECT id, greatest(coalesce(exact_s, 0), coalesce(normalized_s, 0))::DOUBLE AS exact_score, coalesce(doc_local_s, 0)::DOUBLE AS doc_local_score, greatest(coalesce(jamo_s, 0), coalesce(keyboard_s, 0))::DOUBLE AS fuzzy_score,
  coalesce(abbrev_s, 0)::DOUBLE AS abbrev_score, coalesce(dense_s, 0)::DOUBLE AS dense_score, bonus::DOUBLE AS context_overlap, scope::DOUBLE AS scope_adj, CASE WHEN own THEN 0.2 ELSE 0 END::DOUBLE AS doc_local_boost,
  coalesce(xenc, 0.5)::DOUBLE AS xenc, cost::DOUBLE AS transform_cost, x::INT::DOUBLE AS is_exact, CASE WHEN x THEN 1.0 / greatest(1, senses) ELSE 0 END::DOUBLE AS single_sense, {_SCORE} AS score FROM (SELECT * REPLACE (round(bonus, 4) AS bonus) FROM {_S}) y""")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    vector = D.features(c("scores"), c("bonus"), c("scope"), c("own"), c("xenc"), c("cost"), c("x"), c("senses"))
    return _scored(spark, sf_dir).select("id", *[v.alias(k) for k, v in vector.items()], D.ranking_score(F.col("scores"), F.round("bonus", 4), c("scope"), c("own"), c("xenc")).alias("score"))


@query("r02_heuristic_probability", f"""
SELECT id, round(least(0.98, greatest(0.02, p + 0.6 * (bonus + CASE WHEN own THEN 0.2 ELSE 0 END + scope + coalesce(0.25 * (xenc - 0.5), 0)))), 9)::DOUBLE AS p FROM (
  SELECT *, (CASE WHEN x THEN (CASE WHEN senses <= 1 THEN 0.92 ELSE greatest(0.15, 0.8 / senses) END - least(0.2, cost)) * (0.35 + 0.65 * least(1, greatest(coalesce(exact_s, 0), coalesce(normalized_s, 0))))
    WHEN doc_local_s IS NOT NULL THEN 0.6 WHEN jamo_s IS NOT NULL OR keyboard_s IS NOT NULL THEN greatest(0.2, 0.5 - 0.3 * cost) ELSE 0.3 + greatest(0, {_BASE} - 0.55) END)::DOUBLE AS p FROM {_S}) y""")
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.col("bonus") + F.when(F.col("own"), 0.2).otherwise(0.0) + F.col("scope") + F.coalesce(0.25 * (F.col("xenc") - 0.5), F.lit(0.0))
    return _scored(spark, sf_dir).select("id", F.round(D.heuristic_probability(F.col("scores"), F.col("x"), F.col("senses"), F.col("cost"), evidence), 9).alias("p"))


#: mention, entity, p, exact, own alias, blocked, degraded, overflow.
CANDIDATES = [
    ("m1", "e1", 0.92, True, False, None, False, False), ("m1", "e2", 0.2, False, False, None, False, False), ("m2", "e1", 0.80, True, False, None, False, False), ("m2", "e2", 0.79, True, False, None, False, False),
    ("m3", "e1", 0.30, False, False, None, False, False), ("m4", "e1", 0.65, True, False, None, False, False), ("m5", "e1", 0.45, False, False, None, False, False), ("m6", "e1", 0.9, True, False, "typed_derivative", False, False),
    ("m7", "e1", 0.9, True, False, None, True, False), ("m8", "e1", 0.9, True, False, None, True, True), ("m8", "e2", 0.1, True, False, None, True, True), ("m9", "e1", 0.6, False, True, None, False, False),
    ("m10", "e1", 0.75, False, False, None, False, False), ("m11", "e2", 0.7, True, False, None, False, False), ("m11", "e1", 0.55, True, False, None, False, False), ("m12", "e1", 0.39, False, False, None, True, False),
]
#: Worked out by hand: mention_decision, link_decision, margin, members, missing_p, entity_id.
DECIDED = [
    ("m1", "TERM", "RESOLVED", 0.72, 1, None, "e1"), ("m2", "TERM", "AMBIGUOUS", 0.01, 2, None, None), ("m3", "UNCERTAIN", "KB_MISSING", 0.3, 2, 0.5, None), ("m4", "TERM", "AMBIGUOUS", 0.65, 1, None, None),
    ("m5", "UNCERTAIN", "AMBIGUOUS", 0.45, 2, 0.35, None), ("m6", "TERM", "AMBIGUOUS", 0.9, 1, None, None), ("m7", "TERM", "UNCERTAIN", 0.9, 1, None, None), ("m8", "TERM", "AMBIGUOUS", 0.8, 1, None, None),
    ("m9", "TERM", "AMBIGUOUS", 0.6, 1, None, None), ("m10", "TERM", "RESOLVED", 0.75, 1, None, "e1"), ("m11", "TERM", "RESOLVED", 0.15, 2, None, "e2"), ("m12", "UNCERTAIN", "KB_MISSING", 0.39, 2, 0.41, None),
]
_CANDIDATE = "m string, entity_id string, p double, exact boolean, local boolean, blocked string, degraded boolean, overflow boolean"


def _candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATES, _CANDIDATE).withColumn("member", F.lit(None).cast("boolean"))


@query("r03_decisions", "SELECT m, mention_decision, link_decision, margin::DOUBLE AS margin, members::BIGINT AS members, missing_p::DOUBLE AS missing_p, entity_id FROM " + literal(DECIDED, "m", "mention_decision", "link_decision", "margin", "members", "missing_p", "entity_id"))
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    # margins are compared as floating numbers are; 0.7 - 0.55 is a margin of 0.15 less a rounding error
    near = _candidates(spark).withColumn("p", F.when(F.col("entity_id").eqNullSafe("e1") & (F.col("m") == "m11"), F.lit(0.5499999999)).otherwise(F.col("p")))
    return D.decided(near, "m")


@query("r07_ranks", f"SELECT m, entity_id, row_number() OVER (PARTITION BY m ORDER BY p DESC, entity_id) AS rank, round(p - coalesce(lead(p) OVER (PARTITION BY m ORDER BY p DESC, entity_id), 0), 9)::DOUBLE AS lead, p >= 0.25 AS member FROM {literal(CANDIDATES, 'm', 'entity_id', 'p', 'x', 'l', 'b', 'd', 'o')}")
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in rank order, also those that thresholds cut."""
    from pyspark.sql import Window

    after = F.coalesce(F.lead("p").over(Window.partitionBy("m").orderBy("rank")), F.lit(0.0))
    return D.ranked(_candidates(spark), "m").select("m", "entity_id", "rank", F.round(F.col("p") - after, 9).alias("lead"), (F.col("p") >= D.SET_MINIMUM).alias("member"))


@query("q01_fast_decisions", f"""
SELECT m, CASE WHEN bool_or(x OR l) THEN 'TERM' ELSE 'UNCERTAIN' END AS mention_decision, CASE WHEN coalesce(nullif(count(DISTINCT CASE WHEN x THEN e END), 0), count(DISTINCT e)) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS link_decision
FROM {literal(CANDIDATES, 'm', 'e', 'p', 'x', 'l', 'b', 'd', 'o')} GROUP BY m""")
def q01_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fast_decisions(_candidates(spark), "m").drop("senses")


#: Lines as candidates of their order: a probability, evidence, a guard and a budget from their own columns.
_LINES = """(SELECT l_orderkey AS m, l_linenumber * 10000000 + l_partkey AS e, l_quantity / 50.0 AS p, l_returnflag = 'A' AS x, l_returnflag = 'R' AND l_linestatus = 'F' AS l, CASE WHEN l_partkey % 4 = 0 THEN 'typed_derivative' END AS b, l_suppkey % 5 = 0 AND l_quantity > 48 AS d FROM lineitem)"""
_DECIDED_LINES = f"""
(SELECT *, CASE WHEN missing > top THEN 'KB_MISSING' WHEN term AND NOT bad AND guard IS NULL AND top >= 0.7 AND (n = 1 OR top - second >= 0.15) AND missing IS NULL THEN 'RESOLVED' WHEN bad AND inside + CASE WHEN missing IS NULL THEN 0 ELSE 1 END <= 1 THEN 'UNCERTAIN' ELSE 'AMBIGUOUS' END AS link
 FROM (SELECT *, strong OR top >= 0.6 AS term, CASE WHEN top < 0.6 AND NOT exact THEN round(least(0.9, greatest(0.05, 0.8 - top)), 3) END AS missing
  FROM (SELECT m, max(p) AS top, coalesce(max(p) FILTER (k = 2), 0) AS second, count(*) AS n, bool_or(x OR l) AS strong, bool_or(x) AS exact, bool_or(d) AS bad, max(b) FILTER (k = 1) AS guard, max(e) FILTER (k = 1) AS first, count(*) FILTER (p >= 0.25 OR k = 1) AS inside
   FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, e) AS k FROM {_LINES}) GROUP BY m)))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("m"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("entity_id"), (q / 50.0).alias("p"), (F.col("l_returnflag") == "A").alias("exact"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("local"),
        F.when(F.col("l_partkey") % 4 == 0, "typed_derivative").alias("blocked"), ((F.col("l_suppkey") % 5 == 0) & (q > 48)).alias("degraded"), F.lit(False).alias("overflow"), F.lit(None).cast("boolean").alias("member"),
    )


@query("r03_order_decisions", f"SELECT m, CASE WHEN term THEN 'TERM' ELSE 'UNCERTAIN' END AS mention, link, CASE WHEN link = 'RESOLVED' THEN first END AS entity_id FROM {_DECIDED_LINES}")
def r03_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all orders, whose lines stand for candidates."""
    return D.decided(_lines(spark, sf_dir), "m").select("m", F.col("mention_decision").alias("mention"), F.col("link_decision").alias("link"), "entity_id")


@query("q04_blocking_reasons", f"""SELECT m, CASE WHEN link = 'RESOLVED' THEN NULL WHEN bad THEN 'degraded_result' WHEN NOT term THEN 'mention_not_term' WHEN link = 'KB_MISSING' THEN 'kb_missing_dominates' WHEN inside = 0 THEN 'no_candidates'
 WHEN guard IS NOT NULL THEN 'guard_blocked' WHEN top < 0.7 THEN 'below_resolve_threshold' WHEN top - second < 0.15 THEN 'insufficient_margin' ELSE 'ambiguous' END AS reason FROM {_DECIDED_LINES}""")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that kept each order from resolving; hand-made mentions of every reason are in the tests."""
    c = _lines(spark, sf_dir)
    first = D.ranked(c, "m").where("rank = 1").select("m", "top", F.col("margin").alias("lead"), "blocked")
    of = c.groupBy("m").agg(F.bool_or(F.col("degraded") | F.col("overflow")).alias("bad"))
    both = D.decided(c, "m").join(first, "m").join(of, "m")
    entities = F.col("members") - F.col("missing_p").isNotNull().cast("int")
    return both.select("m", D.blocking_reason(F.col("link_decision"), F.col("mention_decision"), F.col("blocked"), F.col("bad"), entities, F.col("top"), F.col("lead")).alias("reason"))


ARRIVALS = [
    ("m1", "e1", "jamo", 0.7, 0.3, 2, "short_core", False, "a2", 1), ("m1", "e1", "exact", 0.9, 0.0, 1, None, True, "a1", 2), ("m1", "e1", "exact", 1.0, 0.1, 1, None, True, "a3", 5), ("m1", "e2", "abbrev", 0.6, 0.0, 1, "short_core", False, None, 3),
    ("m1", "e2", "dense", 0.55, 0.0, 1, "typed_derivative", False, "a4", 4), ("m1", "e3", "dense", 0.5, 0.0, 2, None, False, "a5", 6), ("m2", "e4", "exact", 1.0, 0.0, 1, None, True, "a6", 1), ("m2", "e5", "exact", 1.0, 0.0, 1, None, True, "a7", 2), ("m2", "e6", "exact", 1.0, 0.0, 1, None, True, "a8", 3),
]
_A = literal(ARRIVALS, "m", "e", "channel", "score", "cost", "pass", "blocked", "x", "alias", "arrival")


@query("a02_candidate_merge", f"""
SELECT m, e AS entity_id, scores, cost::DOUBLE AS cost, pass, blocked, x AS exact, alias_id FROM (
  SELECT m, e, min(cost) AS cost, min(pass) AS pass, CASE WHEN bool_and(blocked IS NOT NULL) THEN arg_min(blocked, arrival) END AS blocked, bool_or(x) AS x, first(alias ORDER BY arrival) AS alias_id FROM {_A} GROUP BY m, e) y
JOIN (SELECT m, e, string_agg(channel || '=' || s, ',' ORDER BY channel) AS scores FROM (SELECT m, e, channel, max(score)::DOUBLE AS s FROM {_A} GROUP BY ALL) u GROUP BY m, e) z USING (m, e)""")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(ARRIVALS, "m string, entity_id string, channel string, score double, cost double, pass int, blocked string, exact boolean, alias_id string, arrival int")
    scores = F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return D.merged(rows, ["m"]).select("m", "entity_id", scores.alias("scores"), "cost", "pass", "blocked", "exact", "alias_id")


@query("a03_budgets", f"""
SELECT m, e AS entity_id, NOT x AND n > 1 AS truncated, exact_n > 2 AS overflow FROM (
  SELECT *, row_number() OVER (PARTITION BY m, x ORDER BY arrival, e) AS n, count(*) FILTER (x) OVER (PARTITION BY m) AS exact_n FROM (SELECT m, e, bool_or(x) AS x, min(arrival) AS arrival FROM {_A} GROUP BY m, e) y) z""")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of one and two instead of 256 and 4096, so that the relation meets them."""
    rows = spark.createDataFrame(ARRIVALS, "m string, entity_id string, channel string, score double, cost double, pass int, blocked string, exact boolean, alias_id string, arrival int")
    return D.merged(rows, ["m"], 1, 2).select("m", "entity_id", "truncated", "overflow")


@query("w02_best_proposal", "SELECT o_custkey AS doc, l_linenumber AS start, l_linenumber + 2 AS \"end\", arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) AS alias_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored of all lines of a customer at each line number, each a proposal for a span."""
    return _proposals(spark, sf_dir).select("doc", "start", "end", "alias_id")


def _proposals(spark: SparkSession, sf_dir: str, most: int = D.MOST_PROPOSALS) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = lines.select(F.col("o_custkey").alias("doc"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 2).alias("end"), F.col("l_orderkey").alias("alias_id"), F.col("l_extendedprice").alias("score"))
    return D.best_proposals(spans, ["doc"], most)


@query("t06_proposal_budget", """
SELECT doc, start, row_number() OVER (PARTITION BY doc ORDER BY score DESC, start) <= 3 AS within FROM (
  SELECT o_custkey AS doc, l_linenumber AS start, max(l_extendedprice) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) x""")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of three instead of 512 proposals."""
    return _proposals(spark, sf_dir, 3).select("doc", "start", "within")


SENT = [("d1", "m1", "e1", 0.5), ("d1", "m1", "e2", 0.45), ("d1", "m1", "e3", 0.4), ("d1", "m2", "e1", 0.9), ("d1", "m2", "e2", 0.3), ("d1", "m3", "e4", 0.5), ("d1", "m4", "e1", 0.9), ("d1", "m4", "e2", 0.8), ("d2", "m5", "e1", 0.6), ("d2", "m5", "e2", 0.6)]


@query("t07_rerank_picks", "SELECT * FROM " + literal([("d1", "m1", "e1", 1), ("d1", "m1", "e2", 2), ("d1", "m4", "e1", 3), ("d2", "m5", "e1", 1), ("d2", "m5", "e2", 2)], "doc", "m", "entity_id", "pair"))
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates a mention and three pairs a document instead of 8 and 256."""
    rows = spark.createDataFrame(SENT, "doc string, m string, entity_id string, p double")
    return D.rerank_picks(rows, "doc", "m", 3, 2).select("doc", "m", "entity_id", "pair")


QUANTILES = [("exact|single", 0.4), ("jamo|multi", 0.7)]
MEMBERS = [("m1", "exact", 1, 0.7), ("m2", "exact", 1, 0.5), ("m3", "jamo", 2, 0.31), ("m4", "jamo", 2, 0.29), ("m5", "abbrev", 1, 0.45), ("m6", "abbrev", 1, 0.55)]


@query("r04_conformal_members", f"""
SELECT m, 1 - p <= coalesce(q, 0.5) AS member, q IS NULL AS fallback FROM (SELECT *, channel || CASE WHEN n > 1 THEN '|multi' ELSE '|single' END AS g FROM {literal(MEMBERS, 'm', 'channel', 'n', 'p')}) x LEFT JOIN {literal(QUANTILES, 'g', 'q').replace('AS t(', 'AS u(')} USING (g)""")
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by the group's quantile; 0.5 of all groups where a group has none."""
    rows = spark.createDataFrame(MEMBERS, "m string, channel string, n int, p double").withColumn("g", D.conformal_group(F.array("channel"), F.col("n")))
    held = F.broadcast(spark.createDataFrame(QUANTILES, "g string, q double"))
    return rows.join(held, "g", "left").select("m", (1 - F.col("p") <= F.coalesce("q", F.lit(0.5))).alias("member"), F.col("q").isNull().alias("fallback"))


ABBREVIATED = [("과기정통부", "E1", "과학기술정보통신부", 1.0, "type_terminal"), ("기정통", "E1", "과학기술정보통신부", None, None), ("한정", "E2", "한국전력공사", None, None), ("한전공사", "E2", "한국전력공사", 1.0, "type_terminal"), ("SK하닉", "E3", "SK하이닉스", 0.941666667, "contains_first"), ("ITU", "E4", "International Telecom Union", 0.9, "latin_initials"), ("IT", "E4", "International Telecom Union", None, None), ("전력공사", "E2", "한국전력공사", 1.0, "type_terminal")]


@query("j06_abbreviations", "SELECT token, entity_id, target, round(score, 6)::DOUBLE AS score, signature FROM " + literal([r for r in ABBREVIATED if r[3]], "token", "entity_id", "target", "score", "signature"))
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(sorted({r[1:3] for r in ABBREVIATED}), "entity_id string, surface string")
    tokens = spark.createDataFrame([r[:1] for r in ABBREVIATED] + [("나라",), ("x",)], "token string")
    return A.aligned(tokens, names).select("token", "entity_id", "target", F.round("score", 6).alias("score"), "signature")


ENDINGS = [(1, "한국전력공사"), (2, "과학기술정보통신부"), (3, "부"), (4, "방송통신위원회"), (5, "카카오"), (6, "위원회"), (7, "한국은행"), (8, "산업진흥원"), (9, "국정원"), (10, "대책본부"), (11, "연구소")]


@query("m15_type_terminal", "SELECT id, coalesce((SELECT e FROM (SELECT unnest(" + quoted(list(A.TERMINALS)) + ") AS e) u WHERE suffix(s, e) AND length(s) > length(e) ORDER BY length(e) DESC LIMIT 1), '') AS terminal FROM " + literal(ENDINGS, "id", "s"))
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(ENDINGS, "id int, s string").select("id", A.type_terminal(F.col("s")).alias("terminal"))
