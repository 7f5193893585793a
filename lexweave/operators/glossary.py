"""Glossaries as tables: authoring rows to entities and bindings, layers, validation, rules, lookups, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import best_first

SCOPES = ("base", "global", "project", "session", "document")


# Endings by which a Hangul surface is an organisation's.
ORG_SUFFIXES = ("부", "청", "처", "원", "회", "실", "국", "단", "공사", "공단", "법원", "검찰청", "은행", "위원회", "협회", "연합회", "노총", "본부", "재단", "교육청", "센터")


def inferred_profile(surface: Column) -> Column:
    """The normalization profile that a surface needs, by its scripts."""
    hangul, latin = surface.rlike("[가-힣ㄱ-ㅣ]"), surface.rlike("[0-9A-Za-z]")
    acronym = surface.rlike(r"\p{L}") & ~surface.rlike(r"[\p{L}&&[^\p{Lu}]]") & (F.length(surface) <= 8)
    return F.when(hangul & latin, "mixed_alnum").when(latin & acronym, "latin_acronym").when(latin, "latin_word").when(surface.rlike("(" + "|".join(ORG_SUFFIXES) + ")$"), "korean_org_name").otherwise("korean_term")


def compiled_terms(terms: DataFrame) -> DataFrame:
    """Bindings (entity_id, alias_no, surface, kind, profile) of terms (key, canonical, surfaces): the canonical name first."""
    names = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("surfaces", F.array().cast("array<string>"))))
    out = terms.select(F.col("key").alias("entity_id"), "canonical", F.posexplode(names).alias("alias_no", "surface")).withColumn("profile", inferred_profile(F.col("surface")))
    short = (F.length("surface") < F.length("canonical")) & F.col("surface").rlike("^[가-힣ㄱ-ㅣ]") & (F.length("surface") <= 4)
    kind = F.when(F.col("surface") == F.col("canonical"), "name").when((F.col("profile") == "latin_acronym") | short, "abbreviation").otherwise("alias")
    return out.select("entity_id", "alias_no", "surface", kind.alias("kind"), "profile")


def trusted_layers(terms: DataFrame, trusted: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Terms of the layers that may be read, and a report on each layer: terms, trusted and why it was skipped."""
    told = terms.withColumn("trusted", F.lit(True) if trusted is None else F.col("scope").isin(*trusted))
    report = told.groupBy("scope", "trusted").agg(F.count_if("trusted").alias("terms")).select("scope", "terms", "trusted", F.when(~F.col("trusted"), "untrusted").alias("skipped"))
    return told.where("trusted").drop("trusted"), report


def folded(surface: Column) -> Column:
    """The key under which layers meet: composed, narrow, ASCII in lower case."""
    return T.fold_case(T.fold_width(T.nfc_where_needed(surface)))


def table_entities(rows: DataFrame) -> DataFrame:
    """Entities of an alias-per-row table (id, canonical, alias, definition) with whether its rows agree."""
    return rows.groupBy("id").agg(F.min("canonical").alias("canonical"), F.count_distinct("canonical").alias("names"), F.array_join(F.sort_array(F.collect_set("alias")), "|").alias("aliases")).withColumn("valid", F.col("names") == 1)


def layered(bindings: DataFrame, scope: Column, surface: Column) -> tuple[DataFrame, DataFrame]:
    """Winners by surface, the innermost scope first, and the bindings of other entities that they shadow."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), scope)
    ranked = bindings.withColumn("__rank", rank).withColumn("__key", surface)
    won = best_first(ranked, ["__key"], [F.desc("__rank"), F.asc("entity_id")])
    lost = ranked.alias("l").join(won.select(F.col("__key").alias("k"), F.col("entity_id").alias("winner")), F.col("__key") == F.col("k")).where("entity_id != winner")
    return won.drop("__rank", "__key"), lost.drop("__rank", "__key", "k")


def rule_status(allow: Column, deny: Column, value: Column) -> Column:
    """Three-valued: null where a rule names values and the request has none."""
    denied = F.when(F.size(F.coalesce(deny, F.array().cast("array<string>"))) == 0, F.lit(False)).otherwise(F.array_contains(deny, value))
    allowed = F.when(F.size(F.coalesce(allow, F.array().cast("array<string>"))) == 0, F.lit(True)).otherwise(F.array_contains(allow, value))
    return ~denied & allowed


DIMENSIONS = ("departments", "projects")
RULE = "struct<allow: struct<departments: array<string>, projects: array<string>>, deny: struct<departments: array<string>, projects: array<string>>, valid_from: date, valid_to: date>"


def rule_outcome(rule: Column, context: dict[str, Column], as_of: Column) -> Column:
    """applies, unknown or excluded: what a rule (RULE) says of a request with a value for each dimension and a date.

    One expression, no state. A dimension excludes by a denied value, or by one that is not among those allowed; it is
    unknown where it names values and the request has none (null or empty). Dates exclude outside valid_from to valid_to,
    both included, and are unknown without a date. What excludes goes before what is unknown. A null rule, null lists and
    empty lists ask for nothing.
    """
    excluded, unknown = F.lit(False), F.lit(False)
    for name in DIMENSIONS:
        value = context[name]
        allow, deny = (F.coalesce(rule[policy][name], F.array().cast("array<string>")) for policy in ("allow", "deny"))
        given = F.coalesce(value != "", F.lit(False))
        names = (F.size(allow) > 0) | (F.size(deny) > 0)
        among = lambda values: F.coalesce(F.array_contains(values, value), F.lit(False))  # noqa: E731, B023
        excluded = excluded | (given & (among(deny) | ((F.size(allow) > 0) & ~among(allow))))
        unknown = unknown | (names & ~given)
    dated = rule["valid_from"].isNotNull() | rule["valid_to"].isNotNull()
    outside = (as_of < rule["valid_from"]) | (as_of > rule["valid_to"])
    excluded = excluded | F.coalesce(dated & outside, F.lit(False))
    unknown = unknown | (dated & as_of.isNull())
    return F.when(excluded, "excluded").when(unknown, "unknown").otherwise("applies")


def rule_errors(rule: Column) -> Column:
    """What makes a rule impossible, null if nothing does."""
    return F.when(rule["valid_from"] > rule["valid_to"], "valid_from is after valid_to")


def eligibility(mentions: DataFrame, bindings: DataFrame, entities: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Rows of mentions with entity_id and eligible (confirmed or not) for each entity that their surface may name.

    mentions: surface, departments, projects (one value each) and a date; bindings: surface, entity_id, rule; entities:
    entity_id, rule. An entity counts where its own rule does not exclude it and some binding of the surface does not; it
    is confirmed where its own rule applies and some binding's does. Bindings of a surface and an entity are first gathered
    (a glossary's, not the corpus's), so each mention meets one row for each entity. An entity without a row has no rule;
    mentions that no entity is left to are not in the result; repeated mentions stay apart; null surfaces name nothing.
    """
    context, at = {d: F.col(d) for d in DIMENSIONS}, F.col(as_of)
    gathered = bindings.where("surface is not null and entity_id is not null").groupBy(F.col("surface").alias("__surface"), "entity_id").agg(F.collect_list(F.coalesce("rule", _no_rule())).alias("__rules"))
    named = gathered.join(entities.select(F.col("entity_id").alias("__entity"), F.col("rule").alias("__rule")), F.col("entity_id") == F.col("__entity"), "left")
    met = mentions.drop("entity_id", "eligible").join(named, F.col("surface") == F.col("__surface"))
    told = met.withColumns({"__own": rule_outcome(F.col("__rule"), context, at), "__of": F.transform("__rules", lambda r: rule_outcome(r, context, at))})
    left = told.where((F.col("__own") != "excluded") & F.exists("__of", lambda o: o != "excluded"))
    return left.withColumn("eligible", (F.col("__own") == "applies") & F.array_contains("__of", "applies")).drop("__surface", "__rules", "__entity", "__rule", "__own", "__of")


def _no_rule() -> Column:
    """A rule that asks for nothing, for bindings whose rule is null (a list leaves nulls out)."""
    return F.from_json(F.lit("{}"), RULE)


def links(eligible: DataFrame, key: str) -> DataFrame:
    """key, decision and reason of each mention, and its one entity if it is resolved, from rows of eligibility()."""
    of = eligible.groupBy(key).agg(F.count_distinct("entity_id").alias("n"), F.bool_and("eligible").alias("all"), F.min("entity_id").alias("one"))
    sure = (F.col("n") == 1) & F.col("all")
    reason = F.when(sure, "unique_eligible_alias").when(F.col("n") > 1, "shared_alias").otherwise("eligibility_unconfirmed")
    return of.select(key, F.when(sure, "RESOLVED").otherwise("AMBIGUOUS").alias("decision"), reason.alias("reason"), F.when(sure, F.col("one")).alias("entity_id"))


def ambiguous_surfaces(bindings: DataFrame) -> DataFrame:
    """surface, senses and whether several entities share it."""
    return bindings.groupBy("surface").agg(F.count_distinct("entity_id").alias("senses")).withColumn("ambiguous", F.col("senses") > 1)


def difference(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (added, removed, changed) between two tables, null-safe."""
    a, b = old.select(key, F.struct(*columns).alias("a")), new.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")
