"""Evaluation statistics as column expressions over grouped counts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The score interval of a rate; 0 to 1 where there is nothing to rate."""
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b and c discordant pairs, in logarithms, so that any number of pairs has one.

    With k = min(b, c) and n = b + c: the sum of C(n, i) for i up to k is C(n, k) times a sum that starts with 1 and
    whose next term is the last times i / (n - i + 1).
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    up = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    log_top = F.aggregate(up, F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i))
    total = F.aggregate(up, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, j: F.struct((a["t"] * (k - j + 1) / (n - k + j)).alias("t"), (a["s"] + a["t"] * (k - j + 1) / (n - k + j)).alias("s")), lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(log_top - n * math.log(2) + F.log(total))))


def conformal_quantile(scores: DataFrame, key: list[str], score: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th least score of each key, 1 where that is beyond n.

    Equal scores are counted first and the counts summed up in order: nothing holds all scores of a key.
    """
    counts = scores.where(F.col(score).isNotNull()).groupBy(*key, F.col(score).alias("__s")).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*key).orderBy("__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = counts.groupBy(*key).agg(F.sum("__c").alias("n"))
    placed = counts.withColumn("__upto", F.sum("__c").over(upto)).join(whole, key).withColumn("__at", F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))
    return placed.groupBy(*key, "n").agg(F.coalesce(F.min(F.when(F.col("__upto") >= F.col("__at"), F.col("__s"))), F.lit(1.0)).alias("quantile"))


def placed_values(rows: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at 1-based places of each key's sorted values; a place is a function of their number.

    Equal values are counted first and the counts summed up in order, so a window holds distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("__upto", F.sum("__c").over(upto)).join(counts.groupBy(key).agg(F.sum("__c").alias("__n")), key)
    return placed.groupBy(key).agg(*[F.min(F.when(F.col("__upto") >= at(F.col("__n")), F.col(value))).alias(name) for name, at in places.items()])
