"""The whole way from texts to decisions: exact matches, a document's own short forms, recovery of what these leave,
candidates, probabilities, mentions.

bindings: item_id, entity_id, surface, profile and, where scopes are held, allow and deny (maps of a dimension to values).
A mention is a span of a row of documents; its candidates are entities. Rows are told apart by doc_id and text
(matching.row_of): rows that share a doc_id, or have none, have mentions of their own, equal rows each the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import segmentation as S
from ..functions import text as T
from . import abbreviations, components, decisions, evidence, exact, local_definitions, matching, recovery

AROUND = S.AROUND
# Different tokens that may be a name, up to which they go to the texts and not the texts' tokens to them.
BROADCAST_TOKENS = 200_000
_KEY = ("row", "start", "end")
_ARRIVAL = (*_KEY, "surface", "around", "entity_id", "channel", "score", "cost", "pass", "blocked", "exact", "plain", "alias_id", "arrival")


def proposals(docs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Exact and normalized matches of all profiles with boundaries, tails and scores; one scan of docs."""
    found = exact.profile_matches(docs, bindings).withColumnRenamed("surface", "registered")
    ruled = found.withColumns({"left": exact.default_left(F.col("registered")), "right": F.lit("particle_or_token_boundary"), "inside_latin": F.lit(False), "latin_morph": F.col("profile") == "latin_word"})
    return exact.proposals(exact.with_boundary(ruled, latin_morph=F.col("latin_morph"))).drop("latin_morph", "profile")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, token and around of each run of letters and digits."""
    out = StructType([docs.schema["doc_id"], StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("token", StringType()), StructField("around", StringType())])
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(S.token_batches, out)


def distinct_tokens(docs: DataFrame) -> DataFrame:
    """The different tokens of docs; a task gives each of its own about once, so that few are shuffled."""
    return docs.where("text is not null").select("text").mapInArrow(S.distinct_batches, "token string").distinct()


def _rank(n: int, *ties: Column) -> Column:
    """What arrivals are ordered by: the channel's turn, then numbers, then names."""
    number, name = (ties + (F.lit(None), F.lit(None)))[:2]
    return F.struct(F.lit(n).alias("turn"), number.cast("bigint").alias("number"), name.cast("string").alias("name"))


def recovered(docs: DataFrame, taken: DataFrame, bindings: DataFrame) -> DataFrame:
    """Arrivals of tokens of docs (doc_id: a row's key, text) that no exact match (taken: row, start, end) touches: misspelt
    and abbreviated cores and names typed with the keyboard in the other script.

    Distinct tokens are taken apart once; each core is sought by its jamo, by its keys and as an abbreviation, and a guard
    says what its tail allows. The texts are then read again for the places of the tokens that may be a name; the other
    ones, nearly all, never leave their task.
    """
    paths = components.cut(distinct_tokens(docs)).select("token", F.inline(S.paths_udf("token")))
    cores = paths.select(F.col("core").alias("token")).distinct()
    fuzzy = recovery.fuzzy_candidates(cores, bindings.select("item_id", "surface")).join(bindings.select("item_id", "entity_id"), "item_id")
    short = abbreviations.aligned(cores, bindings.select("entity_id", "surface").where(~F.col("surface").rlike("^[A-Z0-9]+$")))
    typed = recovery.typed_otherwise(cores, bindings.select("item_id", "entity_id", "surface"))
    base = decisions.CHANNEL_BASE
    columns = ("core", "entity_id", "channel", "score", "cost", "alias_id", "number")
    near = fuzzy.select(F.col("token").alias("core"), "entity_id", F.lit("jamo").alias("channel"), F.greatest(F.lit(0.1), base["jamo"] - F.col("cost")).alias("score"), "cost", F.col("item_id").cast("string").alias("alias_id"), F.col("item_id").alias("number"))
    near = near.unionByName(typed.select(F.col("token").alias("core"), "entity_id", F.lit("keyboard").alias("channel"), F.lit(base["keyboard"]).alias("score"), F.lit(0.0).alias("cost"), F.col("item_id").cast("string").alias("alias_id"), F.col("item_id").alias("number")))
    near = near.unionByName(short.select(F.col("token").alias("core"), "entity_id", F.lit("abbrev").alias("channel"), "score", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("alias_id"), F.lit(None).cast(dict(near.dtypes)["number"]).alias("number")).select(*columns))
    tail = F.col("tail")
    stripped = (tail["residual"] != "") | (F.size(tail["particles"]) > 0) | (tail["latin"] != "")
    verdict = decisions.guard(F.col("channel"), F.length("core"), tail["identity"], tail["kind"], tail["grammatical"], stripped)
    both = components.cut(paths.join(near, "core").withColumn("v", verdict))
    names = components.cut(both.select("token").distinct())
    names = F.broadcast(names) if names.count() <= BROADCAST_TOKENS else names
    some = tokens(docs).withColumnRenamed("doc_id", "row").join(names, "token", "left_semi").select("row", "start", "end", "token", "around")
    placed = matching.overlap_join(some, taken, "row", how="anti").distinct().join(both, "token")
    turn = F.when(F.col("channel") == "jamo", 2).when(F.col("channel") == "keyboard", 3).otherwise(4)
    return placed.select(
        "row", "start", (F.col("start") + F.length("core")).alias("end"), F.col("core").alias("surface"), "around", "entity_id", "channel", (F.col("score") * F.col("v.factor")).alias("score"), "cost", F.when(F.col("channel") == "abbrev", 2).otherwise(1).alias("pass"),
        F.when(~F.col("v.commit_allowed"), F.get("v.reasons", F.lit(0))).alias("blocked"), F.lit(False).alias("exact"), F.lit(False).alias("plain"), "alias_id",
        F.struct(turn.alias("turn"), F.col("number").cast("bigint").alias("number"), F.col("entity_id").cast("string").alias("name")).alias("arrival"),
    )


def arrivals(docs: DataFrame, bindings: DataFrame, fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every reading of every channel (_ARRIVAL), and the short forms that rows define (row, alias, entity_id). docs: doc_id, text."""
    keyed = docs.where("text is not null").select(matching.row_of().alias("doc_id"), "text")
    found = proposals(keyed, bindings).withColumnRenamed("doc_id", "row")
    own = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    literal = F.col("registered") == own
    rows = found.select(
        *_KEY, own.alias("surface"), T.window(F.col("text"), F.col("start"), F.col("end"), AROUND).alias("around"), "entity_id", F.when(literal, "exact").otherwise("normalized").alias("channel"),
        (F.col("score") * F.when(literal, 1.0).otherwise(decisions.CHANNEL_BASE["normalized"])).alias("score"), "cost", F.lit(1).alias("pass"), F.lit(None).cast("string").alias("blocked"), F.lit(True).alias("exact"),
        ((F.col("status") == "PASS") & (F.col("identity") == "SAME")).alias("plain"), F.col("item_id").cast("string").alias("alias_id"), _rank(0, F.col("item_id")).alias("arrival"),
    )
    # both are read again below: without the cuts each reading is a scan of all texts
    rows, local = components.cut(rows), components.cut(local_definitions.definitions(docs, bindings))
    used = local_definitions.occurrences(docs, local)
    rows = rows.unionByName(used.select(
        *_KEY, F.col("alias").alias("surface"), F.lit(None).cast("string").alias("around"), "entity_id", F.lit("doc_local").alias("channel"), F.lit(decisions.CHANNEL_BASE["doc_local"]).alias("score"), F.lit(0.0).alias("cost"), F.lit(1).alias("pass"),
        F.lit(None).cast("string").alias("blocked"), F.lit(False).alias("exact"), F.lit(False).alias("plain"), F.lit(None).cast("string").alias("alias_id"), _rank(1, F.lit(None), F.col("entity_id")).alias("arrival"),
    ))
    if not fast:
        rows = rows.unionByName(recovered(keyed, rows.where("exact").select(*_KEY).distinct(), bindings))
    return rows, local.select("row", F.col("alias").alias("surface"), "entity_id").distinct()


def signals(entities: DataFrame) -> DataFrame:
    """entity_id and grams: character pairs of an entity's canonical, description, examples and lower-cased domains, as far as it has them."""
    texts = [F.array(F.col(c)) for c in ("canonical", "description") if c in entities.columns] + [F.col(c) for c in ("examples",) if c in entities.columns] + [F.transform("domains", F.lower) for c in ("domains",) if c in entities.columns]
    told = F.array_compact(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in texts])) if texts else F.array().cast("array<string>")
    grams = F.flatten(F.transform(told, lambda t: T.grams(t, 2)))
    return entities.groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_list(grams))).alias("grams"))


def defined(docs: DataFrame, rows: DataFrame, entities: DataFrame) -> DataFrame:
    """row, start, end and entity_id of mentions that several entities match exactly and the text itself defines as one.

    Mentions with any other candidate, a soft boundary or a derived identity are left alone; only the texts of the few
    mentions that remain are read again.
    """
    alike = rows.groupBy(*_KEY).agg(F.bool_and("plain").alias("plain"), F.array_sort(F.collect_set("entity_id")).alias("ids")).where("plain and size(ids) > 1")
    told = F.col("definition") if "definition" in entities.columns else F.col("description") if "description" in entities.columns else F.lit(None).cast("string")
    record = entities.select("entity_id", F.struct("entity_id", F.col("canonical"), told.alias("definition"), F.array().cast("array<string>").alias("aliases")).alias("c"))
    held = alike.select(*_KEY, F.explode("ids").alias("entity_id")).join(record, "entity_id").groupBy(*_KEY).agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    texts = docs.where("text is not null").select(matching.row_of().alias("row"), T.nfc_where_needed(F.col("text")).alias("text"))
    some = texts.join(held.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    found = components.cut(evidence.self_definitions(held.join(some, "row")).select(*_KEY, "chosen"))  # else the filter is pushed through all of its columns
    return found.where("chosen is not null").select(*_KEY, F.col("chosen").alias("entity_id"))


def scored(docs: DataFrame, bindings: DataFrame, fast: bool = False, entities: DataFrame | None = None, context: dict | None = None, contextual: bool = False) -> DataFrame:
    """Candidates of every mention with their evidence and probability p: row, start, end, surface, entity_id, scores, ...

    entities: entity_id and any of canonical, description, examples, domains, which a mention's surroundings are held
    against; context: department and project of the request as {"value": .., "trust": ..}, held against the bindings'
    scopes. A hard denial drops the entity from the mention. contextual: exact senses that the text itself defines as one
    of the entities count as single ones (defined()).
    """
    rows, local = (components.cut(x) for x in arrivals(docs, bindings, fast))  # read several times below
    merged = decisions.merged(rows, list(_KEY))
    spans = rows.groupBy(*_KEY).agg(F.max("surface").alias("surface"), F.max("around").alias("around"))
    told = merged.join(spans, list(_KEY)).join(local.withColumn("own", F.lit(True)), ["row", "surface", "entity_id"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    bonus, adjustment = F.lit(0.0), F.lit(0.0)
    if entities is not None:
        told = told.join(signals(entities), "entity_id", "left")
        near = F.array_except(T.grams(F.coalesce("around", "surface"), 2), T.grams(F.col("surface"), 2))
        bonus = F.coalesce(decisions.context_bonus(near, F.col("grams")), F.lit(0.0))
    if context and "allow" in bindings.columns:
        told = told.join(bindings.select(F.col("item_id").cast("string").alias("alias_id"), "allow", "deny").distinct(), "alias_id", "left")
        rules = []
        for dimension, field in decisions.SCOPE_FIELDS.items():
            given = context.get(field) or {}
            of = [F.coalesce(F.try_element_at(c, F.lit(dimension)), F.array().cast("array<string>")) for c in (F.col("allow"), F.col("deny"))]
            rules.append(decisions.scope_adjustment(*of, F.lit(given.get("value")).cast("string"), F.lit(given.get("trust")).cast("string")))
        adjustment = rules[0]["adjustment"] + rules[1]["adjustment"]
        told = told.withColumn("dropped", rules[0]["dropped"] | rules[1]["dropped"]).where("not dropped").drop("dropped")
    told = told.withColumn("evidence", bonus + F.when(F.col("own"), 0.20).otherwise(0.0) + adjustment)
    senses = F.sum(F.col("exact").cast("int")).over(Window.partitionBy(*_KEY))
    told = told.withColumn("senses", senses)
    sure = None
    if contextual and entities is not None and not fast:
        told = told.join(defined(docs, rows, entities).withColumn("defined", F.lit(True)), [*_KEY, "entity_id"], "left")
        sure = F.coalesce("defined", F.lit(False))
    p = decisions.heuristic_probability(F.col("scores"), F.col("exact"), F.col("senses"), F.col("cost"), F.col("evidence"), sure)
    return told.withColumn("p", F.round(p, 9)).withColumn("local", F.array_contains(F.map_keys("scores"), "doc_local"))


def resolved(docs: DataFrame, bindings: DataFrame, fast: bool = False, entities: DataFrame | None = None, context: dict | None = None, contextual: bool = False) -> DataFrame:
    """Primary mentions of each row: doc_id, start, end, surface, decisions, entity_id and probability of the best.

    fast: no recovery and no probabilities. entities, context and contextual: see scored().
    """
    told = scored(docs, bindings, fast, entities, context, contextual).withColumns({"m": F.struct(*_KEY), "member": F.lit(None).cast("boolean"), "degraded": F.col("truncated")})
    if fast:
        link = decisions.fast_decisions(told, "m").select("m", "mention_decision", "link_decision", F.when(F.size("senses") == 1, F.get("senses", F.lit(0))).alias("entity_id"))
    else:
        link = decisions.decided(told, "m").select("m", "mention_decision", "link_decision", "entity_id")
    spans = told.groupBy(*_KEY, "m").agg(F.bool_or("exact").alias("exact"), F.max("p").alias("p"), F.min("alias_id").alias("alias_id"), F.max("surface").alias("surface"))
    order: list[Column] = [(~F.col("exact")).cast("int"), F.when(F.col("exact"), 0.0).otherwise(-F.col("p")), F.col("start") - F.col("end"), F.col("start"), F.coalesce("alias_id", F.lit("￿"))]
    primary = matching.greedy_intervals(spans, "row", order, ["m", "exact", "p", "surface"])
    copies = docs.where("text is not null").select(matching.row_of().alias("row"))  # equal rows have one key and each its mentions
    out = primary.join(link, "m").join(copies, "row")
    return out.select("row.doc_id", "start", "end", "surface", "mention_decision", "link_decision", "entity_id", F.when(F.lit(not fast), F.col("p")).alias("p"))


def surface_records(found: DataFrame, compositions: DataFrame) -> DataFrame:
    """Core and whole surface of proposals where they differ, with what the whole denotes and is composed to.

    compositions: entity_id, residual, target: what a core with a residual is registered as.
    """
    label = F.create_map(*[F.lit(x) for x in ("SAME", "SAME_AS_CORE", "DISTINCT", "DISTINCT_FROM_CORE", "UNKNOWN", "UNKNOWN")])
    whole = F.col("end") + F.length("residual")
    told = found.withColumn("whole_end", whole).where((F.col("full_start") != F.col("start")) | (F.col("whole_end") != F.col("end")))
    both = told.join(compositions, ["entity_id", "residual"], "left")
    cut = lambda a, b: F.substring("text", F.col(a) + 1, F.col(b) - F.col(a))
    return both.select("doc_id", "entity_id", cut("start", "end").alias("core"), cut("full_start", "whole_end").alias("whole"), label[F.col("identity")].alias("identity"), "relation", "target")
