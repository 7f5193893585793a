"""From candidates to decisions: guards, scope rules, features, probabilities, budgets, reranking and link decisions.

Everything here is native columns and aggregates. Candidates are rows (mention, entity_id, channel scores as a map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base scores of channels, thresholds and budgets.
CHANNEL_BASE = {"exact": 1.0, "normalized": 0.97, "doc_local": 0.85, "jamo": 0.85, "keyboard": 0.80, "abbrev": 0.55, "dense": 0.55}
RESOLVE, MARGIN, SET_MINIMUM, TERM = 0.70, 0.15, 0.25, 0.60
MOST_NON_EXACT, MOST_EXACT, MOST_PROPOSALS, MOST_PAIRS, PAIRS_A_MENTION = 256, 4096, 512, 256, 8
LEVEL_A = ("exact", "normalized")
#: Scope dimensions and the request fields that they are held against; trust levels that drop for good.
SCOPE_FIELDS = {"departments": "department", "projects": "project"}
HARD_TRUST = ("SERVER_VERIFIED", "AUTH_CLAIM")
SOFT_DENY = {"APPLICATION_VERIFIED": -0.20, "USER_PROVIDED": -0.10}


def guard(channel: Column, core_length: Column, identity: Column, residual_kind: Column, grammatical: Column, stripped: Column) -> Column:
    """(commit_allowed, factor, reasons) of a reading. Exact and normalized matches are never guarded."""
    free = channel.isin(*LEVEL_A)
    short = core_length < 2
    unknown = (identity == "UNKNOWN") | (residual_kind == "UNKNOWN")
    other = ~unknown & (identity == "DISTINCT")
    factor = F.when(unknown | other, 0.60).otherwise(1.0) * F.when(grammatical, 1.0).otherwise(0.80) * F.when(stripped, 0.92).otherwise(1.0)
    reasons = F.array_compact(F.array(
        F.when(short, "short_core"), F.when(unknown, "unknown_residual_derivative"), F.when(other, "typed_derivative"),
        F.when(~grammatical, "ungrammatical_particle"), F.when(stripped, "inferred_tail"),
    ))
    return F.struct(
        (free | ~(short | unknown | other)).alias("commit_allowed"), F.when(free, 1.0).otherwise(F.round(factor, 4)).alias("factor"),
        F.when(free, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"),
    )


def scope_adjustment(allow: Column, deny: Column, value: Column, trust: Column) -> Column:
    """(dropped, adjustment, matched) for one dimension; a request without a value is neutral."""
    given = value.isNotNull()
    level = F.coalesce(trust, F.lit("USER_PROVIDED"))
    denied = given & F.coalesce(F.array_contains(deny, value), F.lit(False))
    ruled = given & ~denied & (F.size(F.coalesce(allow, F.array().cast("array<string>"))) > 0)
    inside = F.coalesce(F.array_contains(allow, value), F.lit(False))
    soft = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in SOFT_DENY.items()], F.lit(0.0))
    return F.struct(
        (denied & level.isin(*HARD_TRUST)).alias("dropped"),
        F.when(denied, soft).when(ruled, F.when(inside, 0.05).otherwise(-0.08)).otherwise(0.0).alias("adjustment"),
        F.when(ruled, inside).alias("matched"),
    )


def _best(scores: Column, *channels: str) -> Column:
    return F.greatest(F.lit(0.0), *[F.coalesce(F.try_element_at(scores, F.lit(c)), F.lit(0.0)) for c in channels])


def context_bonus(window_grams: Column, entity_grams: Column) -> Column:
    """0.15 once four bigrams around a mention also stand in what the entity's record says."""
    return F.lit(0.15) * F.least(F.lit(1.0), F.size(F.array_intersect(window_grams, entity_grams)) / 4.0)


def features(scores: Column, bonus: Column, adjustment: Column, local: Column, xenc: Column, cost: Column, exact: Column, senses: Column) -> dict[str, Column]:
    """The feature vector of a candidate, in its fixed order."""
    return {
        "exact_score": _best(scores, "exact", "normalized"), "doc_local_score": _best(scores, "doc_local"), "fuzzy_score": _best(scores, "jamo", "keyboard"),
        "abbrev_score": _best(scores, "abbrev"), "dense_score": _best(scores, "dense"), "context_overlap": F.round(bonus, 4), "scope_adj": F.round(adjustment, 4),
        "doc_local_boost": F.when(local, 0.20).otherwise(0.0), "xenc": F.coalesce(xenc, F.lit(0.5)), "transform_cost": cost,
        "is_exact": exact.cast("double"), "single_sense": F.when(exact, 1.0 / F.greatest(F.lit(1), senses)).otherwise(0.0),
    }


def base_score(scores: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))


def ranking_score(scores: Column, bonus: Column, adjustment: Column, local: Column, xenc: Column) -> Column:
    added = bonus + F.when(local, 0.20).otherwise(0.0) + adjustment
    return F.round(base_score(scores) + added + F.coalesce(0.25 * (xenc - 0.5), F.lit(0.0)), 4)


def heuristic_probability(scores: Column, exact: Column, senses: Column, cost: Column, evidence: Column, defined: Column | None = None) -> Column:
    """Probability without a calibrator. evidence: what context, scope and reranking add to the base score.

    senses: exact senses of the mention; defined: the text defines the mention as this entity.
    """
    sure = (senses <= 1) if defined is None else (senses <= 1) | defined
    prior = F.when(sure, 0.92).otherwise(F.greatest(F.lit(0.15), 0.80 / senses)) - F.least(F.lit(0.2), cost)
    quality = F.least(F.lit(1.0), _best(scores, "exact", "normalized"))
    has = lambda *names: F.greatest(*[F.array_contains(F.map_keys(scores), n).cast("int") for n in ("none", *names)]) > 0
    other = F.when(has("doc_local"), 0.60).when(has("jamo", "keyboard"), F.greatest(F.lit(0.20), 0.50 - 0.3 * cost)).otherwise(0.30 + F.greatest(F.lit(0.0), base_score(scores) - CHANNEL_BASE["abbrev"]))
    p = F.when(exact, prior * (0.35 + 0.65 * quality)).otherwise(other) + 0.6 * evidence
    return F.least(F.lit(0.98), F.greatest(F.lit(0.02), p))


def fused_probability(vector: list[Column], weights: list[float], bias: float) -> Column:
    """A fitted fusion's logistic, capped as an uncalibrated probability is."""
    total = F.lit(bias)
    for c, w in zip(vector, weights, strict=True):
        total = total + c * F.lit(w)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.02), 1 / (1 + F.exp(-total))))


def merged(arrivals: DataFrame, key: list[str], most: int = MOST_NON_EXACT, most_exact: int = MOST_EXACT) -> DataFrame:
    """One row for each candidate of arrivals (key, entity_id, channel, score, cost, pass, blocked, exact, alias_id, arrival).

    Channels unite with the best score of each, cost and pass are the least, one free arrival lifts a block (its reason is
    the first arrival's), exact evidence promotes; the alias is the first arrival's. Budgets: beyond ``most`` candidates
    that are not exact, by first arrival, candidates are marked truncated; over ``most_exact`` exact ones the mention is
    marked overflown, and none is cut.
    """
    best = arrivals.groupBy(*key, "entity_id", "channel").agg(
        F.max("score").alias("score"), F.min("cost").alias("cost"), F.min("pass").alias("pass"), F.bool_and(F.col("blocked").isNotNull()).alias("held"),
        F.min_by("blocked", "arrival").alias("blocked"), F.bool_or("exact").alias("exact"), F.min_by("alias_id", "arrival").alias("alias_id"), F.min("arrival").alias("arrival"),
    )
    one = best.groupBy(*key, "entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score")))).alias("scores"), F.min("cost").alias("cost"), F.min("pass").alias("pass"),
        F.when(F.bool_and("held"), F.min_by("blocked", "arrival")).alias("blocked"), F.bool_or("exact").alias("exact"),
        F.min_by("alias_id", "arrival").alias("alias_id"), F.min("arrival").alias("arrival"),
    )
    place = F.row_number().over(Window.partitionBy(*key, "exact").orderBy("arrival", "entity_id"))
    of = Window.partitionBy(*key)
    return one.withColumn("__n", place).select(
        *one.columns, (~F.col("exact") & (F.col("__n") > most)).alias("truncated"), (F.sum(F.col("exact").cast("int")).over(of) > most_exact).alias("overflow")
    )


def best_proposals(proposals: DataFrame, key: list[str], most: int = MOST_PROPOSALS) -> DataFrame:
    """The best-scored proposal of each span of a document, and whether it is among the document's ``most`` best."""
    first = F.row_number().over(Window.partitionBy(*key, "start", "end").orderBy(F.desc("score"), "alias_id"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "start", "end"))
    return proposals.withColumn("__r", first).where("__r = 1").drop("__r").withColumn("within", rank <= most)


def ranked(candidates: DataFrame, key: str) -> DataFrame:
    """candidates (key, entity_id, p) with rank (1 is the best; ties by entity_id), top, second and margin."""
    order = Window.partitionBy(key).orderBy(F.desc("p"), "entity_id")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = candidates.withColumn("rank", F.row_number().over(order)).withColumn("top", F.first("p").over(every)).withColumn("second", F.coalesce(F.nth_value("p", 2).over(every), F.lit(0.0)))
    return out.withColumn("margin", F.col("top") - F.col("second"))


def rerank_picks(candidates: DataFrame, doc: str, key: str, most: int = MOST_PAIRS, each: int = PAIRS_A_MENTION) -> DataFrame:
    """Candidates to rerank: of mentions with two entities and no decisive lead, in the order of their keys.

    Each mention sends its ``each`` best; a document sends ``most`` pairs, the last mention only what is left.
    """
    every = ranked(candidates, key).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    open_ = every.where("__n >= 2").where(~((F.col("top") >= RESOLVE) & (F.col("margin") >= MARGIN))).where(F.col("rank") <= each)
    turn = F.row_number().over(Window.partitionBy(doc).orderBy(key, "rank"))
    return open_.withColumn("pair", turn).where(F.col("pair") <= most).drop("__n")


def conformal_group(channels: Column, senses: Column) -> Column:
    """The calibration group: the strongest channel, and whether the mention has several senses."""
    names = ("exact", "normalized", "doc_local", "jamo", "keyboard", "abbrev", "dense")
    strongest = F.coalesce(*[F.when(F.array_contains(channels, n), F.lit(n)) for n in names], F.lit("other"))
    return F.concat(strongest, F.when(senses > 1, "|multi").otherwise("|single"))


def decided(candidates: DataFrame, key: str) -> DataFrame:
    """mention_decision, link_decision, margin, members and resolved entity of each mention.

    candidates: key, entity_id, p, exact, local (a document's own alias), blocked (reason or null), member (in the
    prediction set; null: by SET_MINIMUM), degraded and overflow (of the mention).
    """
    r = ranked(candidates, key)
    inside = F.coalesce("member", F.col("p") >= SET_MINIMUM) | (F.col("rank") == 1)
    one = r.groupBy(key).agg(
        F.max("top").alias("top"), F.max("second").alias("second"), F.max("margin").alias("margin"), F.count("*").alias("n"),
        F.bool_or(F.col("exact") | F.col("local")).alias("strong"), F.bool_or("exact").alias("exact"), F.count_if(inside).alias("inside"),
        F.bool_or("degraded").alias("degraded"), F.bool_or("overflow").alias("overflow"),
        F.min_by("entity_id", "rank").alias("first"), F.min_by(F.coalesce("blocked", F.lit("")), "rank").alias("blocked"),
    )
    degraded = F.col("degraded") | F.col("overflow")
    term = F.col("strong") | (F.col("top") >= TERM)
    missing_p = F.when((F.col("top") < TERM) & ~F.col("exact"), F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.05), 0.8 - F.col("top"))), 3))
    members = F.col("inside") + missing_p.isNotNull().cast("int")
    resolved = term & ~degraded & (F.col("blocked") == "") & (F.col("top") >= RESOLVE) & ((F.col("n") == 1) | (F.col("margin") >= MARGIN)) & missing_p.isNull()
    link = F.when(F.col("overflow"), "AMBIGUOUS").when(members == 0, "UNCERTAIN").when(F.coalesce(missing_p > F.col("top"), F.lit(False)), "KB_MISSING").when(resolved, "RESOLVED").when(degraded & (members <= 1), "UNCERTAIN").otherwise("AMBIGUOUS")
    return one.select(
        key, F.when(term, "TERM").otherwise("UNCERTAIN").alias("mention_decision"), link.alias("link_decision"), F.round("margin", 9).alias("margin"),
        members.cast("bigint").alias("members"), missing_p.alias("missing_p"), F.when(link == "RESOLVED", F.col("first")).alias("entity_id"),
    )


def fast_decisions(candidates: DataFrame, key: str) -> DataFrame:
    """Decisions without probabilities: the senses are the exact entities, or all where there is none."""
    one = candidates.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("entity_id")))).alias("sure"), F.array_sort(F.collect_set("entity_id")).alias("every"), F.bool_or(F.col("exact") | F.col("local")).alias("strong")
    )
    senses = F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.col("every"))
    return one.select(key, F.when(F.col("strong"), "TERM").otherwise("UNCERTAIN").alias("mention_decision"), F.when(F.size(senses) == 1, "RESOLVED").otherwise("AMBIGUOUS").alias("link_decision"), senses.alias("senses"))


def blocking_reason(link: Column, mention: Column, blocked: Column, degraded: Column, members: Column, top: Column, margin: Column) -> Column:
    """Why a mention did not resolve; null where it did. members: entities in the prediction set; a missing one counts as none."""
    return (
        F.when(link == "RESOLVED", F.lit(None).cast("string")).when(degraded, "degraded_result").when(mention != "TERM", "mention_not_term").when(link == "KB_MISSING", "kb_missing_dominates").when(members == 0, "no_candidates")
        .when(F.coalesce(blocked, F.lit("")) != "", "guard_blocked").when(F.coalesce(top, F.lit(0.0)) < RESOLVE, "below_resolve_threshold").when(margin < MARGIN, "insufficient_margin").otherwise("ambiguous")
    )
