"""Bounds, resampling and the two small fits: sufficient counts are gathered by Spark, what iterates runs on the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def error_bound(errors: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact upper bound of an error rate: the rate at which so few errors have probability alpha."""
    if not 0 <= errors <= n or not 0 < alpha < 1:
        raise ValueError("counts or level out of range")
    if errors == n:
        return 1.0
    k = np.arange(errors + 1)
    lg = np.vectorize(math.lgamma)
    chosen = math.lgamma(n + 1) - lg(k + 1.0) - lg(n - k + 1.0)
    low, high = errors / n, 1.0
    for _ in range(70):
        mid = (low + high) / 2
        if mid >= 1.0:
            break
        terms = chosen + k * math.log(mid) + (n - k) * math.log1p(-mid) if mid > 0 else chosen * 0.0
        top = terms.max()
        low, high = (mid, high) if math.exp(top) * np.exp(terms - top).sum() > alpha else (low, mid)
    return high


def _bounds(errors: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([error_bound(int(e), int(m), float(a)) for e, m, a in zip(errors, n, alpha)], dtype="float64")


#: error_bound of columns; rows are groups of counts.
error_bound_udf = F.pandas_udf(_bounds, DoubleType())


def threshold_grid(rows: DataFrame, thresholds: list[float], alpha: float = 0.05) -> DataFrame:
    """group, threshold, selected, errors and the errors' upper bound, of rows (group, p, wrong). One pass over the rows."""
    at = F.array(*[F.lit(t) for t in thresholds])
    kept = rows.select("group", "wrong", F.explode(F.filter(at, lambda t: F.col("p") >= t)).alias("threshold"))
    counts = kept.groupBy("group", "threshold").agg(F.count("*").alias("selected"), F.count_if("wrong").alias("errors"))
    return counts.withColumn("bound", error_bound_udf("errors", "selected", F.lit(alpha)))


def paired_bootstrap(rows: DataFrame, unit: str, replicates: int = 2000, seed: int = 7) -> dict:
    """Mean of right - left over rows (unit, left, right), with a percentile interval that resamples whole clusters.

    The cluster sums come to the driver, two numbers each; a seed draws the same resamples in every run.
    """
    sums = rows.groupBy(unit).agg(F.sum(F.col("right") - F.col("left")).alias("d"), F.count("*").alias("n")).orderBy(unit).toPandas()
    total, n = sums["d"].to_numpy(dtype=float), sums["n"].to_numpy(dtype=float)
    out = {"clusters": len(sums), "observations": int(n.sum()), "estimate": float(total.sum() / n.sum()) if len(sums) else None, "low": None, "high": None}
    if len(sums) >= 2:
        rng = np.random.default_rng(seed)
        draws = np.sort([total[i].sum() / n[i].sum() for i in (rng.integers(0, len(sums), len(sums)) for _ in range(replicates))])
        out |= {"low": float(draws[math.floor(0.025 * replicates)]), "high": float(draws[min(replicates, math.ceil(0.975 * replicates)) - 1])}
    return out


def fit_platt(rows: DataFrame, steps: int = 200, rate: float = 0.5) -> tuple[float, float]:
    """Slope and offset of a probability from a score: gradient steps from (1, 0) over rows (score, label).

    Equal scores come to the driver as one row with their counts, in the order of the scores.
    """
    held = rows.groupBy("score").agg(F.sum(F.col("label").cast("double")).alias("ones"), F.count("*").alias("n")).orderBy("score").toPandas()
    s, ones, n = (held[c].to_numpy(dtype=float) for c in ("score", "ones", "n"))
    a, b = 1.0, 0.0
    for _ in range(steps):
        gap = n / (1 + np.exp(-(a * s + b))) - ones
        a, b = a - rate * float((gap * s).sum()) / n.sum(), b - rate * float(gap.sum()) / n.sum()
    return float(a), float(b)


def fit_fusion(rows: DataFrame, names: list[str], steps: int = 300, rate: float = 0.3, shrink: float = 1e-3, least: int = 20) -> tuple[list[float], float]:
    """Weights and bias of a logistic over features, by gradient steps from zero over rows (names, label).

    Equal vectors come to the driver as one row with their counts; accepted corrections are few by their caps.
    """
    held = rows.groupBy(*names).agg(F.sum(F.col("label").cast("double")).alias("__ones"), F.count("*").alias("__n")).orderBy(*names).toPandas()
    x, ones, n = held[names].to_numpy(dtype=float), held["__ones"].to_numpy(dtype=float), held["__n"].to_numpy(dtype=float)
    if n.sum() < least or not ones.sum():
        raise ValueError("too few rows, or none with a label of 1")
    w, b = np.zeros(len(names)), 0.0
    for _ in range(steps):
        gap = n / (1 + np.exp(-(x @ w + b))) - ones
        w, b = w - rate * (x.T @ gap / n.sum() + shrink * w), b - rate * float(gap.sum()) / n.sum()
    return w.tolist(), float(b)


def hard_negatives(golds: DataFrame, entities: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k wrong entities for each gold one: 2 for a domain in common, 1 for the same first character, ties by a seeded hash.

    golds: entity_id; entities: entity_id, canonical, domains (array). Entities that score meet by equi-joins on a domain
    or the first character; only golds with fewer than k of those are filled up, from the k entities of the least hash.
    """
    e = entities.select("entity_id", F.left("canonical", F.lit(1)).alias("c"), "domains")
    g = golds.select("entity_id").distinct().join(e, "entity_id").select(F.col("entity_id").alias("gold"), F.col("c").alias("gc"), F.col("domains").alias("gd"))
    by_domain = g.select("*", F.explode("gd").alias("d")).join(e.select("*", F.explode("domains").alias("d")), "d").drop("d")
    by_first = g.join(e, F.col("gc") == F.col("c"))
    tie = F.xxhash64("gold", "entity_id", F.lit(seed))
    score = F.when(F.arrays_overlap("gd", "domains"), 2).otherwise(0) + F.when(F.col("gc") == F.col("c"), 1).otherwise(0)
    near = by_domain.unionByName(by_first).where("entity_id != gold").select("gold", "entity_id", score.alias("score")).distinct()
    some = e.orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id").limit(2 * k + 1).select("entity_id")
    rest = g.select("gold").join(F.broadcast(some), F.col("gold") != F.col("entity_id")).join(near.select("gold", "entity_id"), ["gold", "entity_id"], "left_anti").withColumn("score", F.lit(0))
    place = F.row_number().over(Window.partitionBy("gold").orderBy(F.desc("score"), tie, "entity_id"))
    return near.unionByName(rest).withColumn("place", place).where(F.col("place") <= k)


def single_entity(members: Column, resolved: Column) -> Column:
    """The entity that a mention was read as: the resolved one, else the only one in its set, else null."""
    ids = F.array_distinct(F.array_compact(members))
    return F.coalesce(resolved, F.when(F.size(ids) == 1, F.get(ids, F.lit(0))))


def run_metrics(rows: DataFrame, latency: str, keep: int = 512, seed: int = 7) -> DataFrame:
    """Count, degraded count and median and 95th percentile over a hash-ordered sample of ``keep`` latencies.

    The sample hangs on the rows alone, as a reservoir's would not; beside it the percentiles of all rows.
    """
    sample = rows.withColumn("__h", F.xxhash64(*rows.columns, F.lit(seed))).orderBy("__h", latency).limit(keep)
    s = F.sort_array(F.collect_list(latency))
    some = sample.agg(s.alias("s")).select(F.size("s").cast("bigint").alias("sampled"), F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("p50"), F.get("s", F.least(F.floor(F.size("s") * 0.95).cast("int"), F.size("s") - 1)).alias("p95"))
    return rows.agg(F.count("*").alias("n"), F.count_if("degraded").alias("degraded"), F.expr(f"percentile_disc(0.5) within group (order by {latency})").alias("all_p50")).crossJoin(F.broadcast(some))


def coverage_proven(components: DataFrame, alpha: float = 0.05, source: str = "random_audit") -> bool:
    """Whether a calibrator may claim its coverage: components (component, part, group, positives) of an audited sample.

    No component is in two rows, so fitting (fit) and calibration share none; each scored one (part score) has exactly one
    positive and a group, others none; there are enough of them for the level. Anything but a random audit proves nothing.
    """
    if source != "random_audit" or not 0 < alpha < 1:
        return False
    r = components.agg(
        F.count("*").alias("rows"), F.count_distinct("component").alias("distinct"), F.count_if(F.col("part") == "fit").alias("fit"), F.count_if(F.col("part") == "score").alias("scored"),
        F.count_if((F.col("part") == "score") & ((F.coalesce("positives", F.lit(0)) != 1) | F.col("group").isNull())).alias("bad"), F.count_if((F.col("part") != "score") & (F.coalesce("positives", F.lit(0)) != 0)).alias("stray"),
    ).first()
    return r["fit"] > 0 and r["rows"] == r["distinct"] and not r["bad"] and not r["stray"] and r["scored"] >= max(1, math.ceil(1 / alpha) - 1)
