"""Channels, exact matches, boundaries, tails and paths on literal texts; expected rows are worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..functions import segmentation as S
from ..operators import exact
from .base import literal, planted, planted_sql, query

CHANNELS = [(1, "한 전·KPS", "korean_org_name", "한전KPS", "0,2,4,5,6"), (2, "A.P-장애", "latin_acronym", "ap장애", "0,2,4,5"), (3, "ＡＰ 5S", "ocr_tolerant", "ap5s", "0,1,3,4"), (4, "", "korean_term", "", ""), (5, "é​x", "latin_word", "éx", "0,2"), (6, "R&D / x", "mixed_alnum", "rdx", "0,2,6")]


@query("p09_channels", "SELECT id, folded, at_ AS places FROM " + literal([(r[0], r[3], r[4]) for r in CHANNELS], "id", "folded", "at_"))
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded texts with the places of their characters."""
    out = None
    for i, s, profile, *_ in CHANNELS:
        part = spark.createDataFrame([(i, s)], "id int, s string").withColumn("c", exact.channel(F.col("s"), profile))
        out = part if out is None else out.union(part)
    return out.select("id", "c.folded", F.array_join(F.transform("c.at", lambda i: i.cast("string")), ",").alias("places"))


ADJACENT = [("ㅂ", "ㅈ", True), ("ㅂ", "ㅁ", True), ("ㅂ", "ㄱ", False), ("ㅏ", "ㅣ", True), ("ㅋ", "ㅍ", False), ("ㅂ", "ㅂ", False), ("x", "ㅂ", False)]


@query("p17_adjacent_keys", "SELECT * FROM " + literal(ADJACENT, "a", "b", "adjacent"))
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(H.adjacent_keys(), "a string, b string").withColumn("adjacent", F.lit(True))
    rows = spark.createDataFrame([r[:2] for r in ADJACENT], "a string, b string")
    return rows.join(F.broadcast(pairs), ["a", "b"], "left").select("a", "b", F.coalesce("adjacent", F.lit(False)).alias("adjacent"))


@query("m01_particles", "SELECT particle, need FROM " + literal([("은", "final"), ("는", "open"), ("으로", "not_rieul"), ("로", "rieul"), ("에서", "any"), ("서", "any"), ("였다", "open")], "particle", "need"))
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as a relation: what each particle asks of the syllable before it."""
    rows = spark.createDataFrame(list(H.PARTICLES.items()), "particle string, need string")
    return rows.where(F.col("particle").isin("은", "는", "으로", "로", "에서", "서", "였다"))


#: Surfaces by item, and texts; matches under the profile of Hangul organisations or of Latin acronyms.
ORGS = [(1, "한전"), (2, "한전KDN"), (3, "기획"), (4, "기획부")]
ORG_TEXTS = [(1, "한전은 발표했다"), (2, "대한전선 관계자"), (3, "한전KDN은 발표했다"), (4, "한 전 담당자와 통화"), (5, "구한전 자료"), (6, "기획부터 검토했다"), (7, "한전서울본부에서도 회의"), (8, "전 한전서울본부에서도 회의를 했다"), (9, "한   전"), (10, None), (11, "한전")]
#: doc, item, start, end, cost, status, note.
FOUND = [
    (1, 1, 0, 2, 0.0, "PASS", "right:particle_prefix_accept"), (2, 1, 1, 3, 0.0, "FAIL", "left:hangul_attached"), (3, 1, 0, 2, 0.0, "PASS", ""), (3, 2, 0, 5, 0.0, "PASS", ""), (4, 1, 0, 3, 0.05, "PASS", ""),
    (5, 1, 1, 3, 0.0, "PASS", "left:prefix_modifier:구"), (6, 3, 0, 2, 0.0, "PASS", "right:particle_prefix_accept"), (6, 4, 0, 3, 0.0, "SOFT", "right:hangul_residual"), (7, 1, 0, 2, 0.0, "SOFT", "right:hangul_residual"), (8, 1, 2, 4, 0.0, "SOFT", "right:hangul_residual"), (11, 1, 0, 2, 0.0, "PASS", ""),
]
ACRONYMS = [(1, "AP"), (2, "server")]
ACRONYM_TEXTS = [(1, "AP 장애 발생"), (2, "SAP 시스템"), (3, "CAPEX 검토"), (4, "ＡＰ 장애"), (5, "a.p. 장애"), (6, "AP에서 확인"), (7, "servers 점검"), (8, "APs 교체"), (9, "A----P")]


ORG_SENTENCES = [t or "" for _, t in ORG_TEXTS]
_PLANTED = planted_sql(ORG_SENTENCES)


def _orgs(spark: SparkSession, docs: DataFrame | None = None) -> DataFrame:
    docs = spark.createDataFrame(ORG_TEXTS, "doc_id int, text string") if docs is None else docs
    found = exact.matches(docs, spark.createDataFrame(ORGS, "item_id int, surface string"), "korean_org_name")
    return exact.with_boundary(found.withColumns({"left": F.lit("hangul_token_boundary"), "right": F.lit("particle_or_token_boundary"), "inside_latin": F.lit(False)}))


def _acronyms(spark: SparkSession, profile: str, latin_morph: bool) -> DataFrame:
    found = exact.matches(spark.createDataFrame(ACRONYM_TEXTS, "doc_id int, text string"), spark.createDataFrame(ACRONYMS, "item_id int, surface string"), profile)
    return exact.with_boundary(found.withColumns({"left": F.lit("latin_token_boundary"), "right": F.lit("particle_or_token_boundary"), "inside_latin": F.lit(False)}), latin_morph)


@query("j01_exact_matches", f'SELECT doc_id, item_id, base + a AS start, base + b AS "end", cost::DOUBLE AS cost FROM {_PLANTED} d JOIN {literal([(r[0] - 1, *r[1:5]) for r in FOUND], "k", "item_id", "a", "b", "cost")} USING (k)')
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the keys in all documents as folded, mapped back; three blanks in a row void the ninth sentence's."""
    return _orgs(spark, planted(spark, sf_dir, ORG_SENTENCES)).select("doc_id", "item_id", "start", "end", "cost")


@query("f03_boundaries", "SELECT 'org' AS kind, * FROM " + literal([(*r[:3], *r[5:]) for r in FOUND], "doc_id", "item_id", "start", "status", "note") + " UNION ALL SELECT 'acronym', * FROM " + literal([(1, 1, 0, "PASS", ""), (2, 1, 1, "FAIL", "left:inside_latin_run"), (3, 1, 1, "FAIL", "left:inside_latin_run"), (4, 1, 0, "PASS", ""), (5, 1, 0, "PASS", ""), (6, 1, 0, "PASS", ""), (7, 2, 0, "FAIL", "right:inside_latin_run"), (8, 1, 0, "FAIL", "right:inside_latin_run")], "doc_id", "item_id", "start", "status", "note") + " UNION ALL SELECT 'word', 7, 2, 0, 'PASS', 'right:latin_tail:s'")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "item_id", "start", "status", "note")
    out = _orgs(spark).select(F.lit("org").alias("kind"), *names).union(_acronyms(spark, "latin_acronym", False).select(F.lit("acronym"), *names))
    return out.union(_acronyms(spark, "latin_word", True).where("item_id = 2").select(F.lit("word"), *names))


@query("f04_gaps", "SELECT * FROM " + literal([(1, 0.0), (4, 0.0), (5, 0.05), (6, 0.0), (2, 0.0), (3, 0.0), (8, 0.0)], "doc_id", "cost").replace("0.0)", "0.0::DOUBLE)").replace("0.05)", "0.05::DOUBLE)"))
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match may skip two characters in a row, each at a cost; four hyphens void the ninth text's."""
    return _acronyms(spark, "latin_acronym", False).where("item_id = 1").select("doc_id", "cost")


@query("m08_proposals", f"SELECT d.doc_id, item_id, residual, array_to_string(particles, ',') AS particles, identity, modifier, base + full_start AS full_start, base + full_end AS full_end, score::DOUBLE AS score FROM {_PLANTED} d JOIN " + literal([
    (1, 1, "", ["은"], "SAME", "", 0, 3, 1.0), (3, 1, "", [], "SAME", "", 0, 2, 1.0), (3, 2, "", ["은"], "SAME", "", 0, 6, 1.0), (4, 1, "", [], "SAME", "", 0, 3, 0.95), (5, 1, "", [], "SAME", "구", 0, 3, 1.0),
    (6, 3, "", ["부터"], "SAME", "", 0, 4, 1.0), (6, 4, "터", [], "UNKNOWN", "", 0, 4, 0.18), (7, 1, "서울본부", ["에서", "도"], "DISTINCT", "", 0, 9, 0.45), (8, 1, "서울본부", ["에서", "도"], "DISTINCT", "전", 0, 11, 0.45), (11, 1, "", [], "SAME", "", 0, 2, 1.0),
], "n", "item_id", "residual", "particles", "identity", "modifier", "full_start", "full_end", "score") + " ON d.k = n - 1")
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.proposals(_orgs(spark, planted(spark, sf_dir, ORG_SENTENCES)))
    return out.select("doc_id", "item_id", "residual", F.array_join("particles", ",").alias("particles"), "identity", "modifier", "full_start", "full_end", "score")


RUNS = [(1, "서울본부에서도", "전"), (2, "장과", "원"), (3, "", "전"), (4, "부터", "획"), (5, "톡에", "오")]


@query("m06_tails", "SELECT * FROM " + literal([(1, "서울본부|에서+도|DISTINCT|ORG_UNIT", 0.75), (2, "장|과|DISTINCT|ROLE", None), (3, "||SAME|", 1.0), (4, "|부터|SAME|", 1.0), (5, "톡|에|UNKNOWN|UNKNOWN", 0.3)], "id", "best", "score").replace("NULL", "0.9::DOUBLE"))
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all readings of what follows a core."""
    rows = spark.createDataFrame(RUNS, "id int, run string, before string").withColumn("t", F.get(S.tails_udf("run", "before"), F.lit(0)))
    return rows.select("id", F.concat_ws("|", "t.residual", F.array_join("t.particles", "+"), "t.identity", "t.governing").alias("best"), F.round("t.score", 6).alias("score"))


TOKENS = [(1, "한전은"), (2, "금감원장"), (3, "servers"), (4, "AP"), (5, "한전")]


@query("m07_paths", "SELECT * FROM " + literal([(1, "한전은:BARE", 1.0), (1, "한전:PARTICLE", 0.96), (2, "금감원장:BARE", 1.0), (2, "금감원:SUFFIX", 0.864), (2, "금감:SUFFIX", 0.828), (3, "servers:BARE", 1.0), (3, "server:LATIN_TAIL", 0.95), (4, "AP:BARE", 1.0), (5, "한전:BARE", 1.0)], "id", "path", "score").replace("1.0)", "1.0::DOUBLE)"))
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(TOKENS, "id int, token string").select("id", F.inline(S.paths_udf("token")))
    return rows.select("id", F.concat_ws(":", "core", "shape").alias("path"), F.round("path_score", 6).alias("score"))
