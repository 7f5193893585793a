"""Choosing passages, paragraphs and facts: budgets, neighbours, sections, exposure rules and gold comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching

# Order of classifications; what a heading looks like.
CLASSIFICATIONS = ("public", "internal", "restricted")
HEADING = r"^(?:#{1,6}\s+|\[[^\]\n]{1,60}\]\s*$|\d+[.)]\s+)"


def within_budget(ranked: DataFrame, key: str, budget: int = 3000, most: int = 3) -> DataFrame:
    """Spans taken in rank order while they overlap none taken before and fit the budget of characters; ``most`` at most.

    ranked: key, start, end, rank. The ranked passages of one document and question are an array; the fold is native.
    """
    held = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end"))).alias("s"))
    kind = "array<" + dict(held.dtypes)["s"][6:-1] + ">"
    used = lambda acc: F.aggregate(acc, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    fits = lambda acc, x: (F.size(acc) < most) & ~F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])) & (used(acc) + x["end"] - x["start"] <= budget)
    fold = F.aggregate("s", F.array().cast(kind), lambda acc, x: F.when(fits(acc, x), F.array_append(acc, x)).otherwise(acc))
    return held.select(key, F.posexplode(fold).alias("place", "x")).select(key, (F.col("place") + 1).alias("place"), "x.start", "x.end")


def with_neighbours(centres: DataFrame, key: str) -> DataFrame:
    """Each centre, then the passage before it and after it, each passage once, at its first place.

    centres: key, index (its place in the document) and rank, for all passages of the document.
    """
    wide = centres.select(key, "rank", F.posexplode(F.array(F.col("index"), F.col("index") - 1, F.col("index") + 1)).alias("turn", "index"))
    real = wide.join(centres.select(key, "index"), [key, "index"], "left_semi")
    first = real.groupBy(key, "index").agg(F.min(F.struct("rank", "turn")).alias("at"))
    return first.select(key, "index", F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("place"))


def similarity(a: Column, b: Column) -> Column:
    """Two thousandths of shared characters and, twice as heavy, of shared bigrams; whole numbers."""

    def grams(c: Column, n: int) -> Column:
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))
        return F.when(F.length(c) >= n, found).otherwise(F.array().cast("array<string>"))

    def part(n: int, weight: int) -> Column:
        sets = [grams(c, n) for c in (a, b)]
        size = F.size(sets[0]) + F.size(sets[1])
        return F.when(size > 0, weight * F.floor(2000 * F.size(F.array_intersect(*sets)) / size)).otherwise(0)

    return (part(1, 1) + part(2, 2)).cast("bigint")


def paragraph_window(docs: DataFrame, target: Column, visible: Column) -> DataFrame:
    """doc_id, selected, start, end and text: the paragraph nearest to a target surface, with the one before and after.

    docs: doc_id, text. A document without paragraphs gives none.
    """
    parts = docs.select("*", target.alias("__t"), visible.alias("__v"), F.posexplode(T.spans_between(F.col("text"), r"\n\s*\n")).alias("i", "p"))
    own = F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    parts = parts.select("*", *[T.casefolded(T.squeezed(c)).alias(n) for n, c in (("__ft", F.col("__t")), ("__fv", F.col("__v")), ("__own", own))])
    score = 4 * similarity(F.col("__ft"), F.col("__own")) + similarity(F.col("__fv"), F.col("__own"))
    of = Window.partitionBy("doc_id")
    near = parts.withColumn("score", score).withColumn("best", F.min_by("i", F.struct((-F.col("score")).alias("s"), "i")).over(of))
    some = near.where("abs(i - best) <= 1").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("best").alias("selected"), F.min("p.start").alias("start"), F.max("p.end").alias("end"))
    return some.select("doc_id", "selected", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def section(text: Column, at: Column) -> Column:
    """(start, end) of the section around a place: from the last heading at or before it to the first one after it."""
    spans = T.spans_between(text, T.PARAGRAPH_BREAK)
    heads = F.filter(spans, lambda p: (F.length(F.trim(F.substring(text, p["start"] + 1, p["end"] - p["start"]))) <= 80) & ~F.contains(F.trim(F.substring(text, p["start"] + 1, p["end"] - p["start"])), F.lit("\n")) & F.trim(F.substring(text, p["start"] + 1, p["end"] - p["start"])).rlike(HEADING))
    begins = F.transform(heads, lambda p: p["start"])
    return F.struct(F.coalesce(F.array_max(F.filter(begins, lambda s: s <= at)), F.lit(0)).alias("start"), F.coalesce(F.array_min(F.filter(begins, lambda s: s > at)), F.length(text)).alias("end"))


def exposed(classification: Column, injection: Column, as_fact: Column, clearance: str = "internal") -> Column:
    """Whether an entity may be shown: within the clearance, and as its injection rule allows."""
    order = F.array(*[F.lit(c) for c in CLASSIFICATIONS])
    cleared = F.array_position(order, F.coalesce(classification, F.lit("public"))) <= CLASSIFICATIONS.index(clearance) + 1
    rule = F.coalesce(injection, F.lit("always"))
    return cleared & (rule != "never") & ~((rule == "resolved_only") & ~as_fact) & ~((rule == "candidate_only") & as_fact)


def absent_surfaces(bindings: DataFrame, docs: DataFrame) -> DataFrame:
    """Bindings (item_id, surface) that no text of docs (doc_id, text) holds, as written or under any profile.

    The texts are folded once for each profile and searched for the folded surfaces by the dictionary join.
    """
    held = matching.literal_matches(docs.select("doc_id", "text"), bindings.select("item_id", "surface")).select("item_id").distinct()
    for profile in T.PROFILES:
        keys = bindings.select("item_id", T.alias_key(F.col("surface"), profile).alias("surface")).where("surface != ''")
        folded = docs.select("doc_id", T.alias_key(F.col("text"), profile).alias("text"))
        held = held.union(matching.literal_matches(folded, keys).select("item_id").distinct())
    return bindings.join(held.distinct(), "item_id", "left_anti")


def gold_hits(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each gold span (doc_id, start, end) with whether a prediction is the same and whether one overlaps it."""
    same = predicted.select("doc_id", "start", "end").distinct().withColumn("__same", F.lit(True))
    near = matching.overlap_join(gold.select("doc_id", "start", "end").distinct(), predicted.select("doc_id", "start", "end").distinct(), "doc_id").select("doc_id", "start", "end").distinct().withColumn("__near", F.lit(True))
    out = gold.join(same, ["doc_id", "start", "end"], "left").join(near, ["doc_id", "start", "end"], "left")
    return out.select(*gold.columns, F.coalesce("__same", F.lit(False)).alias("exact"), F.coalesce("__near", F.lit(False)).alias("overlapping"))


def ordered_union(*arrays: Column) -> Column:
    """Distinct values of arrays in the order in which they first come."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
