"""Quality classifier as a sparse ensemble of rules.

Boosted shallow trees over ratios of text statistics are grown on labelled rows; every path from a root is a rule, a
conjunction of comparisons. A logistic model with an L1 penalty (proximal gradient with momentum) weighs the rules
and leaves few of them; the survivors are compiled into one Spark column expression, so scoring stays in the JVM.

The fit takes at most ``sample`` labelled rows, chosen by the hash of doc_id (labelled tables beyond that are thinned
evenly); everything else covers all rows. Rows whose crc32(doc_id as text) mod 3 is 1 never train. Rows without a
label, with a null label, or of doc_ids with contrary labels in equal number do not train; null texts are empty
texts, whose statistics are all 0 and which get a score as any other; null doc_ids count as the empty text in the
split; repeated rows are scored each. Without trainable rows of both classes the score is the share of label 1 (1 if
there are none).
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, text_stats

#: Labelled rows that the fit takes at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF = 30, 3, 32, 0.3, 20
PENALTY, STEPS = 0.004, 600
HELD_OUT = 1


def features() -> dict[str, Column]:
    """Ratios that hang on the text alone."""
    s = {c: F.col(f"s_{c}").cast("double") for c in text_stats.COUNTS}
    words, chars = F.greatest(s["n_words"], F.lit(1.0)), F.greatest(s["word_chars"], F.lit(1.0))
    letters = F.greatest(s["n_upper"] + s["n_lower"], F.lit(1.0))
    return {
        "log_words": F.log1p(s["n_words"]), "word_length": s["word_chars"] / words, "longest": s["longest"], "symbols": s["n_symbols"] / chars, "marks": s["n_marks"] / chars,
        "bangs": s["n_bangs"] / words, "digits": s["n_digits"] / chars, "upper": s["n_upper"] / letters, "dup_lines": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1.0)),
        "repeated": s["n_repeat_words"] / words, "distinct": s["n_distinct"] / words, "common": s["n_common"] / words, "top": s["n_top"] / words, "doubled": s["n_doubled"] / words, "words_a_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1.0)),
    }


#: The keys of features(), which needs a session.
NAMES = ["log_words", "word_length", "longest", "symbols", "marks", "bangs", "digits", "upper", "dup_lines", "repeated", "distinct", "common", "top", "doubled", "words_a_line"]

#: A rule: (feature, "<=" or ">", threshold) conditions, in a fixed order.
Rule = tuple[tuple[str, str, float], ...]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == HELD_OUT


def _grow(x: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray, residual: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, depth: int, value: np.ndarray) -> list[Rule]:
    """Splits rows by the greatest gain; sets value of the leaves; returns the rules of all nodes below."""
    g, h = residual[rows].sum(), hess[rows].sum()
    best: tuple[float, int, int] = (1e-6, -1, -1)
    if depth and len(rows) >= 2 * LEAF:
        for f in range(x.shape[1]):
            k = len(cuts[f])
            if not k:
                continue
            c = codes[rows, f]
            gs, hs = np.bincount(c, residual[rows], k + 1).cumsum()[:k], np.bincount(c, hess[rows], k + 1).cumsum()[:k]
            ns = np.bincount(c, minlength=k + 1).cumsum()[:k]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
            if gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        value[rows] = g / (h + 1)
        return []
    _, f, at = best
    left = codes[rows, f] <= at
    out: list[Rule] = []
    for side, own in (("<=", rows[left]), (">", rows[~left])):
        rule = (*path, (NAMES[f], side, float(cuts[f][at])))
        out += [rule, *_grow(x, cuts, codes, residual, hess, own, rule, depth - 1, value)]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def matches(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=bool)
    for i, rule in enumerate(rules):
        for name, side, at in rule:
            v = x[:, NAMES.index(name)]
            out[:, i] &= v <= at if side == "<=" else v > at
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return float(np.log((share + 1e-6) / (1 - share + 1e-6))), []
    cuts = []
    for f in range(x.shape[1]):
        seen = np.unique(x[:, f])
        if len(seen) > BINS:
            seen = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)))
        cuts.append((seen[1:] + seen[:-1]) / 2)
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    margin, rules = np.full(len(y), base), {}
    for _ in range(TREES):
        p, value = _sigmoid(margin), np.zeros(len(y))
        for rule in _grow(x, cuts, codes, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), (), DEPTH, value):
            rules.setdefault(tuple(sorted(rule)), None)
        margin += RATE * value
    found = list(rules)
    if not found:
        return float(base), []
    r = matches(found, x).astype(float)
    mean, sd = r.mean(axis=0), np.maximum(r.std(axis=0), 0.05)
    z = (r - mean) / sd
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w = last = np.zeros(z.shape[1])
    b = last_b = float(base)
    for step in range(STEPS):
        pull = step / (step + 3)
        v, vb = w + pull * (w - last), b + pull * (b - last_b)
        gap = (_sigmoid(z @ v + vb) - y) / len(y)
        last, last_b = w, b
        w = v - rate * (z.T @ gap)
        w, b = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0), vb - rate * gap.sum()
    weight = w / sd
    return float(b - (weight * mean).sum()), [(rule, float(k)) for rule, k in zip(found, weight) if k]


def compiled(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The score, 0 to 1, as a column expression over features()."""
    by = features()

    def holds(rule: Rule) -> Column:
        return functools.reduce(operator.and_, [by[n] <= at if side == "<=" else by[n] > at for n, side, at in rule])

    total = functools.reduce(operator.add, [F.when(holds(rule), F.lit(k)).otherwise(F.lit(0.0)) for rule, k in model[1]], F.lit(model[0]))
    return 1 / (1 + F.exp(-total))


def training_rows(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Features and label of labelled rows outside the held-out part, at most about ``sample``."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).where("y != 0.5 and doc_id is not null").where(~held_out())
    n = marked.count()
    if n > sample:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    picked = stats.join(marked, "doc_id").select("doc_id", *[c.alias(k) for k, c in features().items()], (F.col("y") > 0.5).cast("double").alias("y"))
    # repeated rows of a labelled doc_id can outnumber the labels: one each, whichever comes first by its statistics
    return picked.groupBy("doc_id").agg(F.min(F.struct(*NAMES, "y")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """The columns ``keep`` (doc_id among them) of each row of docs with held_out, score and predicted."""
    stats = common.cut(text_stats.measured(docs.select(*keep, *[c for c in ("text",) if c not in keep]), keep), "quality-stats")
    rows = training_rows(stats, labels, sample)
    model = fit(rows[NAMES].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))
    out = stats.select(*keep, held_out().alias("held_out"), compiled(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
