"""Quality rules with robust multivariate outliers.

Each text gives a vector of transformed statistics. For each language and source the minimum covariance determinant
is sought: from two starts (all rows; medians with deviations from them) concentration steps keep the fraction
``share`` of rows that lie nearest in Mahalanobis distance and estimate anew; the start with the least determinant
wins and is reweighted once. A text is rejected when its squared distance exceeds the chi-square quantile of ``sure``.

Each step counts the rows of each group by narrow band of distance, which gives the edge of the nearest ``share`` to
a band, and then sums moments within the edge; both are partial sums of tasks over the small table of vectors, so no
group, however large, meets in one task.
Groups of fewer than ``least`` rows use their language's estimate, then that of all rows. A floor of variance per
statistic keeps statistics that are constant in a group from rejecting a text for a single deviation.

Null languages and sources are groups of their own; null texts have no words and fail the base rule; repeated rows
count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, text_stats

SHARE, SURE, LEAST, STEPS = 0.75, 1 - 1e-7, 200, 6
#: Bands of squared distance to a doubling.
BANDS = 16
#: Statistic and the floor of its standard deviation.
VECTOR = {"log_words": 0.5, "word_length": 0.6, "log_symbols": 0.4, "dup_lines": 0.12, "repeated": 0.12, "upper": 0.08, "distinct": 0.06, "marks": 0.03}
P = len(VECTOR)
_UP = np.triu_indices(P)
SUMS = [f"m{i}" for i in range(P + len(_UP[0]))]
RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]


def chi2_cdf(x: float, k: int) -> float:
    """For an even number k of degrees of freedom."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def vector() -> list[Column]:
    n, chars = F.greatest(F.col("s_n_words"), F.lit(1)), F.greatest(F.col("s_word_chars"), F.lit(1))
    return [
        F.log1p("s_n_words").alias("x0"), (F.col("s_word_chars") / n).alias("x1"), F.log1p(1000 * F.col("s_n_symbols") / chars).alias("x2"),
        (F.col("s_n_dup_lines") / F.greatest(F.col("s_n_lines"), F.lit(1))).alias("x3"), (F.col("s_n_repeat_words") / n).alias("x4"),
        (F.col("s_n_upper") / F.greatest(F.col("s_n_upper") + F.col("s_n_lower"), F.lit(1))).alias("x5"), (F.col("s_n_distinct") / n).alias("x6"), (F.col("s_n_marks") / chars).alias("x7"),
    ]


def base_failed() -> Column:
    return (F.col("s_n_words") < 50) | (100 * F.col("s_n_repeat_words") > 50 * F.col("s_n_words"))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(P)])


def _squared(x: np.ndarray, mean: np.ndarray, white: np.ndarray) -> np.ndarray:
    return (((x - mean) @ white) ** 2).sum(axis=1)


def _band(d: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(d, 2.0**-20)) * BANDS).astype(np.int64)


def _models_of(batch: pa.RecordBatch, models: list[dict]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Group, start, vectors and squared distances of the rows of a batch."""
    x, groups = _vectors(batch), np.array(batch.column("g").to_pylist(), dtype=object)
    for g in pd.unique(groups):
        own = x[groups == g]
        for s, model in enumerate(models):
            if g in model:
                yield g, s, own, _squared(own, *model[g])


def _bands(rows: DataFrame, models: list[dict]) -> pd.DataFrame:
    """Rows of each group, start and band of distance."""
    held = rows.sparkSession.sparkContext.broadcast(models)  # a model for each language and source

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(g, s, int(b), int(n)) for g, s, _, d in _models_of(batch, held.value) for b, n in zip(*np.unique(_band(d), return_counts=True))]
        return pa.RecordBatch.from_pylist([dict(zip("gsbn", r)) for r in out], schema=pa.schema([("g", pa.string()), ("s", pa.int32()), ("b", pa.int64()), ("n", pa.int64())]))

    parts = rows.select("g", *[f"x{i}" for i in range(P)]).mapInArrow(common.by_batch(kernel, 20_000), "g string, s int, b bigint, n bigint")
    return parts.groupBy("g", "s", "b").agg(F.sum("n").alias("n")).toPandas()


def _moments(rows: DataFrame, models: list[dict] | None, edges: dict[tuple, float] | None = None) -> pd.DataFrame:
    """Sums over the rows of each group and start whose squared distance is at most the edge; over all without models."""
    held = rows.sparkSession.sparkContext.broadcast((models, edges))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        models, edges = held.value
        if models is None:
            x, groups = _vectors(batch), np.array(batch.column("g").to_pylist(), dtype=object)
            found = [(g, 0, x[groups == g]) for g in pd.unique(groups)]
        else:
            found = [(g, s, own[d <= edges[g, s]]) for g, s, own, d in _models_of(batch, models) if (g, s) in edges]
        out = [(g, s, len(y), *y.sum(axis=0), *(y.T @ y)[_UP]) for g, s, y in found]
        frame = pd.DataFrame(out, columns=["g", "s", "n", *SUMS])
        return pa.RecordBatch.from_pandas(frame.astype({"g": "string", "s": "int32", "n": "int64"} | dict.fromkeys(SUMS, "float64")), preserve_index=False)

    schema = "g string, s int, n bigint, " + ", ".join(f"{c} double" for c in SUMS)
    parts = rows.select("g", *[f"x{i}" for i in range(P)]).mapInArrow(common.by_batch(kernel, 20_000), schema)
    return parts.groupBy("g", "s").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS]).toPandas()


def _estimate(n: float, sums: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    mean = sums[:P] / n
    second = np.zeros((P, P))
    second[_UP] = sums[P:] / n
    second = second + np.triu(second, 1).T
    return mean, (second - np.outer(mean, mean)) * scale


def _model(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    held = cov + np.diag(np.array(list(VECTOR.values())) ** 2)
    values, axes = np.linalg.eigh(held)
    return mean, axes / np.sqrt(np.maximum(values, 1e-12)), float(np.log(np.maximum(values, 1e-12)).sum())


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS, least: int = LEAST) -> dict[str, tuple]:
    """Mean and whitening of each group of rows (g, x0..); groups under ``least`` rows have none."""

    def estimated(got: pd.DataFrame, scale: float) -> list[dict]:
        out: list[dict] = [{}, {}]
        for r in got[got["n"] > P].itertuples():
            out[r.s][r.g] = _model(*_estimate(r.n, np.array([getattr(r, c) for c in SUMS]), scale))
        return out

    first = _moments(rows, None)
    plain = estimated(first[first["n"] >= least], 1.0)[0]
    if not plain:
        return {}
    quartiles = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"x{i}") for i in range(P)]
    robust = {
        r["g"]: _model(np.array([r[f"x{i}"][1] for i in range(P)]), np.diag([((r[f"x{i}"][2] - r[f"x{i}"][0]) / 1.349) ** 2 for i in range(P)]))
        for r in rows.groupBy("g").agg(*quartiles).collect()
        if r["g"] in plain
    }
    starts = [plain, robust]
    factor = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    for _ in range(steps):
        models, edges = [{g: m[:2] for g, m in s.items()} for s in starts], {}
        for key, part in _bands(rows, models).groupby(["g", "s"]):
            part = part.sort_values("b")
            at = int(np.searchsorted(part["n"].cumsum().to_numpy(), share * part["n"].sum()))
            edges[key] = 2.0 ** (part["b"].iloc[at] / BANDS) * (1 + 1e-12)
        starts = estimated(_moments(rows, models, edges), factor)
    best = {g: min((s[g] for s in starts if g in s), key=lambda m: m[2]) for g in plain}
    near = chi2_quantile(0.975, P)
    again = _moments(rows, [{g: m[:2] for g, m in best.items()}], {(g, 0): near for g in best})
    best |= estimated(again[again["n"] >= least / 2], 0.975 / chi2_cdf(near, P + 2))[0]
    return {g: m[:2] for g, m in best.items()}


def judged(stats: DataFrame, keep: tuple[str, ...], sure: float = SURE, least: int = LEAST) -> DataFrame:
    """The columns ``keep`` of stats with base_failed, kept and distance; stats: lang, source and text_stats columns."""
    spark = stats.sparkSession
    group = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("?")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("?")))
    full = stats.select("*", *vector(), base_failed().alias("base_failed"), group.alias("g"))
    sound = full.where(~F.col("base_failed"))
    levels = [fit(sound, least=least)]
    sizes = {r["g"]: r["n"] for r in sound.groupBy("g").agg(F.count("*").alias("n")).collect()}  # a row for each language and source
    if any(n < least for n in sizes.values()):
        levels += [fit(sound.withColumn("g", F.substring_index("g", "\x1f", 1)), least=least), fit(sound.withColumn("g", F.lit("")), least=P + 2)]
    held, cut = spark.sparkContext.broadcast(levels), chi2_quantile(sure, P)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, groups = _vectors(batch), np.array(batch.column("g").to_pylist(), dtype=object)
        out = np.zeros(len(x))
        for g in pd.unique(groups):
            for level, name in zip(held.value, (g, g.split("\x1f")[0], "")):
                if name in level:
                    out[groups == g] = _squared(x[groups == g], *level[name])
                    break
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], batch.column("base_failed"), pa.array(out)], names=[*keep, "base_failed", "distance"])

    types = dict(stats.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keep], "base_failed boolean", "distance double"])
    out = full.mapInArrow(common.by_batch(kernel, 20_000), schema)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cut))


def rejected(docs: DataFrame, sure: float = SURE, least: int = LEAST) -> DataFrame:
    """RESULT columns of each row of docs (doc_id, text, lang, source)."""
    stats = common.cut(text_stats.measured(docs, ("doc_id", "lang", "source")), "stats")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = judged(stats, ("doc_id", *[f"s_{c}" for c in names]), sure, least)
    return out.select("doc_id", *[F.col(f"s_{c}").alias(c) for c in names], "base_failed", "kept", "distance")
