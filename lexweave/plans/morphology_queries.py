"""Morphology and decision rules on literal relations; the oracle rows are the expected values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morphology as M
from ..functions import text as T
from .base import literal, query

RESIDUALS = [("서울본부", "전", "SUFFIX_WITH_MODIFIER:서울+본부:UNKNOWN_PART+ORG_UNIT"), ("호랑이", "전", "UNKNOWN:호랑이:UNKNOWN"), ("장", "청", "SUFFIX:장:ROLE"), ("부", "정", "SUFFIX:부:NAME_PART"), ("지사", "도", "SUFFIX:지사:ROLE"), ("지사", "전", "SUFFIX:지사:ORG_UNIT"), ("담당자", "전", "SUFFIX:담당자:ROLE"), ("", "전", "SUFFIX::")]


@query("m03_residual_classes", "SELECT * FROM " + literal(RESIDUALS, "chunk", "core_end", "reading"))
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in RESIDUALS], "chunk string, core_end string")
    return rows.select("chunk", "core_end", M.residual_udf("chunk", "core_end").alias("reading"))


LEFTS = [("공지: 구 ", "구"), ("의전", ""), ("현", "현"), ("이른바 ", "이른바"), ("abc", "")]


@query("m04_prefix_modifier", "SELECT * FROM " + literal(LEFTS, "before", "modifier"))
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([r[:1] for r in LEFTS], "before string").select("before", M.prefix_modifier(F.col("before")).alias("modifier"))


RIGHTS = [("'s 상태", "'s"), ("tation", ""), ("s", "s"), ("es.", "es"), ("server", "")]


@query("m05_latin_tail", "SELECT * FROM " + literal(RIGHTS, "after", "tail"))
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([r[:1] for r in RIGHTS], "after string").select("after", M.latin_tail(F.col("after")).alias("tail"))


MAXSIM = [(1, [[1.0, 0.0], [0.0, 1.0]], [[0.6, 0.8], [1.0, 0.0]], 1.8), (2, [[0.5, 0.5]], [[0.2, 0.2]], 0.2)]


@query("m24_maxsim", "SELECT id, s::DOUBLE AS score FROM " + literal([(r[0], r[3]) for r in MAXSIM], "id", "s"))
def m24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction: the best inner product of each query vector, summed."""
    rows = spark.createDataFrame([r[:3] for r in MAXSIM], "id int, q array<array<double>>, d array<array<double>>")
    best = F.transform("q", lambda x: F.array_max(F.transform("d", lambda y: T.inner_product(x, y))))
    return rows.select("id", F.round(F.aggregate(best, F.lit(0.0), lambda a, b: a + b), 9).alias("score"))
