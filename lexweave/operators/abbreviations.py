"""Abbreviations of names: tokens aligned as subsequences, behind an equi-join on the token's first character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Institutional endings, longer ones first; least lengths; the bar.
TERMINALS = ("위원회", "본부", "공사", "공단", "은행", "연구원", "진흥원", "부", "처", "청", "원", "국", "실", "회", "단", "소")
LEAST, LEAST_LATIN, BAR, INITIALS_SCORE = 2, 3, 0.55, 0.9


def type_terminal(c: Column) -> Column:
    """The ending of TERMINALS that a longer string has; empty without one. Native."""
    return F.regexp_extract(c, "^.+?(" + "|".join(TERMINALS) + ")$", 1)


def positions(short: str, long: str) -> Column:
    """0-based leftmost places of the characters of one column in another, one after the other; null if there are none."""
    walk = f"aggregate(filter(split({short}, ''), c -> c != ''), array(0), (at, c) -> array_append(at, if(element_at(at, -1) < 0, -1, coalesce(nullif(locate(c, {long}, element_at(at, -1) + 1), 0), -1))))"
    return F.expr(f"if(element_at({walk}, -1) > 0, transform(slice({walk}, 2, length({short})), x -> x - 1), null)")


def aligned(tokens: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """token, entity_id, target, score and signature of up to ``most`` entities for each token.

    tokens: token; names: entity_id, surface. A token aligns with a name whose characters, blanks left out, hold the
    token's in order; a Latin token of a name's initials aligns too. Each entity gives its best name (ties: the least).
    """
    compact = names.where(F.length("surface") > 0).distinct().withColumn("compact", F.replace("surface", F.lit(" "), F.lit(""))).withColumn("words", F.filter(F.split("surface", r"\s+"), lambda w: w != ""))
    ends = F.aggregate(F.transform("words", F.length), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    compact = compact.withColumn("starts", F.slice(ends, 1, F.size("words")))
    some = tokens.select("token").distinct().where(F.length("token") >= LEAST)
    latin = F.col("token").rlike("^[A-Za-z]+$")
    by_char = compact.select("*", F.explode(F.array_distinct(F.filter(F.split(F.lower("compact"), ""), lambda c: c != ""))).alias("__c"))
    sought = some.where(~F.col("token").rlike(r"^[\x00-\x7F]*$") | (F.length("token") >= LEAST_LATIN)).withColumn("__c", F.lower(F.left("token", F.lit(1))))
    both = sought.join(by_char, "__c").where("length(compact) > length(token)").withColumn("at", positions("token", "compact")).where("at is not null")
    terminal = type_terminal(F.col("compact"))
    same_terminal = (terminal != "") & (terminal == type_terminal(F.col("token")))
    same_last = F.right("token", F.lit(1)) == F.right("compact", F.lit(1))
    at_words = F.size(F.filter("at", lambda p: F.array_contains("starts", p)))
    score = F.length("token") / F.length("compact") + F.when(same_last, 0.25).otherwise(0.0) + F.when(same_terminal, 0.10).otherwise(0.0) + F.when(F.left("token", F.lit(1)) == F.left("compact", F.lit(1)), 0.25).otherwise(0.0) + 0.1 * at_words / F.size("at")
    signature = F.when(same_terminal, "type_terminal").when(same_last, "first_last").otherwise("contains_first")
    found = both.withColumn("score", score).where(F.col("score") >= BAR).select("token", "entity_id", F.col("surface").alias("target"), F.least(F.lit(1.0), "score").alias("score"), signature.alias("signature"))
    initials = compact.where(F.size("words") >= 2).withColumn("__i", F.upper(F.array_join(F.transform("words", lambda w: F.left(w, F.lit(1))), "")))
    acronyms = some.where(latin).withColumn("__i", F.upper("token")).join(initials, "__i").select("token", "entity_id", F.col("surface").alias("target"), F.lit(INITIALS_SCORE).alias("score"), F.lit("latin_initials").alias("signature"))
    one = Window.partitionBy("token", "entity_id").orderBy(F.desc("score"), "target", "signature")
    best = found.unionByName(acronyms).withColumn("__r", F.row_number().over(one)).where("__r = 1")
    return best.withColumn("__r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "entity_id"))).where(F.col("__r") <= most).drop("__r")
