"""Proposed terms and answers of models: checks, admission, grounding against a context pack, one-time requests.

All native: a check is a column, a lookup is a join, and what fails is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Scopes, origins, lengths.
SCOPES = ("session", "project", "global")
ORIGINS = ("llm_proposal", "user_explicit", "document_definition", "deterministic_detector")
EXPLICIT = ("user_explicit", "document_definition")
LONGEST_NAME, LONGEST_DEFINITION = 120, 1000


def checks(proposals: DataFrame, bindings: DataFrame, entities: DataFrame) -> DataFrame:
    """id, ok and the names of failed checks of each proposal.

    proposals: id, surface, canonical, definition, scope, origin, observed (seen in a trusted source); bindings: surface,
    entity_id; entities: entity_id, canonical. A null text is an empty one, a null scope or origin is unknown.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    proposals = proposals.withColumns({c: F.coalesce(c, F.lit("")) for c in ("surface", "canonical", "definition", "scope", "origin")})
    taken = bindings.select(F.col("surface").alias("__s")).distinct().withColumn("__taken", F.lit(True))
    named = entities.select(bare(F.col("canonical")).alias("__c")).distinct().withColumn("__named", F.lit(True))
    both = proposals.join(taken, F.col("surface") == F.col("__s"), "left").join(named, bare(F.col("canonical")) == F.col("__c"), "left")
    texts = [F.col(c) for c in ("surface", "canonical", "definition")]
    whole = F.concat_ws("\n", "canonical", "definition")
    fails = {
        "surface_nonempty": ~F.col("surface").rlike(r"(?U)\S"), "canonical_nonempty": ~F.col("canonical").rlike(r"(?U)\S"), "definition_nonempty": ~F.col("definition").rlike(r"(?U)\S"),
        "no_control_chars": F.concat(*texts).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"),
        "length_limits": (F.length("canonical") > LONGEST_NAME) | (F.length("surface") > LONGEST_NAME) | (F.length("definition") > LONGEST_DEFINITION),
        "evidence_surface_present": ~F.coalesce("observed", F.lit(False)), "not_instructional": whole.rlike(T.STEERS), "no_sensitive_content": whole.rlike(T.SENSITIVE),
        "scope_known": ~F.col("scope").isin(*SCOPES), "origin_known": ~F.col("origin").isin(*ORIGINS),
        "no_alias_collision": F.coalesce("__taken", F.lit(False)), "no_duplicate_entity": F.coalesce("__named", F.lit(False)),
    }
    failed = F.array_compact(F.array(*[F.when(c, n) for n, c in fails.items()]))
    return both.select("id", (F.size(failed) == 0).alias("ok"), failed.alias("failed"))


def admission(scope: Column, origin: Column, evidence: Column, sessions: Column, trusted: Column, *, auto_explicit: bool = True, auto_inferred: bool = False, project_auto: bool = False, least_evidence: int = 3, least_sessions: int = 2) -> Column:
    """The state that a sound proposal is admitted to; never ACTIVE beyond a session unless the policy opens that door."""
    explicit = origin.isin(*EXPLICIT)
    session = F.when(explicit & F.lit(auto_explicit), "ACTIVE").when(F.lit(auto_inferred) | (origin == "llm_proposal"), "PROVISIONAL").otherwise("VALIDATED")
    project = F.when(F.lit(project_auto) & trusted & explicit & (evidence >= least_evidence) & (sessions >= least_sessions), "ACTIVE").otherwise("VALIDATED")
    return F.when(scope == "session", session).when(scope == "project", project).otherwise("VALIDATED")


def grounding_violations(selections: DataFrame, facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """id and kind of what is wrong with selections (id, surface, entity_id) against a pack.

    facts: surface, entity_id of resolved mentions; candidates: surface, entity_id of ambiguous ones. A null entity is an
    abstention. An unknown entity is told as such and as nothing else.
    """
    told = selections.where("entity_id is not null")
    known = facts.select("entity_id").union(candidates.select("entity_id")).distinct().withColumn("__known", F.lit(True))
    fact = facts.groupBy("surface").agg(F.max("entity_id").alias("__fact"))
    options = candidates.groupBy("surface").agg(F.collect_set("entity_id").alias("__options"))
    all_ = told.join(known, "entity_id", "left").join(fact, "surface", "left").join(options, "surface", "left")
    unknown = F.col("__known").isNull()
    kinds = F.array_compact(F.array(
        F.when(unknown, "unknown_entity_id"), F.when(~unknown & F.col("__options").isNotNull() & ~F.array_contains("__options", F.col("entity_id")), "out_of_candidate_set"),
        F.when(~unknown & F.col("__fact").isNotNull() & (F.col("__fact") != F.col("entity_id")), "resolved_override"),
    ))
    return all_.select("id", F.explode(kinds).alias("kind"))


def consumed(attempts: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each attempt (request, n, at, tenant, snapshot, document) to use a request once within its time.

    requests: request, issued, expires, tenant, snapshot, document. The first attempt uses the request up, whatever comes
    of it; times run from issued up to but not including expires. What an attempt doesn't name (null) differs from what
    the request was made for, and an attempt without a time is outside it.
    """
    both = attempts.join(requests.select("request", "issued", "expires", *[F.col(c).alias(f"__{c}") for c in ("tenant", "snapshot", "document")]), "request", "left")
    turn = F.row_number().over(Window.partitionBy("request").orderBy("n"))
    outcome = (
        F.when(F.col("issued").isNull(), "unknown_request").when(F.col("__turn") > 1, "compact_request_consumed").when(~F.coalesce((F.col("at") >= F.col("issued")) & (F.col("at") < F.col("expires")), F.lit(False)), "compact_request_expired")
        .when(~F.col("tenant").eqNullSafe(F.col("__tenant")), "compact_request_context_mismatch").when(~F.col("snapshot").eqNullSafe(F.col("__snapshot")), "compact_snapshot_mismatch").when(~F.col("document").eqNullSafe(F.col("__document")), "compact_document_mismatch").otherwise("accepted")
    )
    return both.withColumn("__turn", turn).select("request", "n", outcome.alias("outcome"))


def shrunk_pack(cards: DataFrame, key: str, budget: int) -> DataFrame:
    """Cards of a context pack that fit a token budget, with their number of candidates.

    cards: key, id, ambiguous, place (its relevance, 1 is the best), base tokens, hint tokens and tokens of each candidate
    (array; empty for facts). What goes, in this order and only as far as it must: all hints; candidates beyond two of
    every ambiguous mention; ambiguous mentions and then facts, the least relevant first. A status never changes.
    """
    w = Window.partitionBy(key)
    total = lambda c: F.sum(c).over(w)
    some = lambda n: F.aggregate(F.slice("candidates", F.lit(1), n), F.lit(0), lambda a, x: a + x)
    sized = cards.withColumn("__all", some(F.greatest(F.size("candidates"), F.lit(1)))).withColumn("__two", some(F.lit(2)))
    told = sized.withColumn("__full", total(F.col("base") + F.col("hints") + F.col("__all"))).withColumn("__bare", total(F.col("base") + F.col("__all")))
    told = told.withColumn("__least", total(F.col("base") + F.col("__two")))
    with_hints, all_options = F.col("__full") <= budget, F.col("__bare") <= budget
    cost = F.col("base") + F.when(with_hints, F.col("hints") + F.col("__all")).when(all_options, F.col("__all")).otherwise(F.col("__two"))
    order = Window.partitionBy(key).orderBy(F.col("ambiguous").cast("int"), "place").rowsBetween(Window.unboundedPreceding, 0)
    kept = told.withColumn("__c", cost).withColumn("__upto", F.sum("__c").over(order)).where(F.col("__upto") <= budget)
    options = F.when(all_options, F.size("candidates")).otherwise(F.least(F.size("candidates"), F.lit(2)))
    return kept.select(key, "id", "ambiguous", options.alias("options"), with_hints.alias("hints_kept"))
