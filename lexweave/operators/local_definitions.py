"""Short forms that a document defines for itself, and where it uses them: a small dictionary of each document's own.

Definitions are read from a text by patterns with their places, resolved against the glossary once for each distinct
form, and carried back to their document by the row's key; a document's occurrences are sought in its own text alone,
so no pattern of one document meets the text of another. Texts are read by the kernels of functions/definitions, once for
each step; what they find is small, and the rest is native but for the scan for known names and particles.

docs: doc_id, text. Rows are told apart by doc_id and text (matching.row_of): rows that share a doc_id, or have none,
keep their own dictionaries; equal rows share one. Null and empty texts define nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import definitions as D
from ..functions import hangul as H
from ..functions import text as T
from . import exact, matching

# Fixed value: share of a long form that a known name must cover.
COVERED = 0.7
# Short forms behind and before a mention, words that may be one, and how far before a mention one is sought.
_WORD = r"[A-Za-z가-힣][A-Za-z가-힣0-9]{1,19}"
_QUOTED = rf"\s*[\"'“‘]?({_WORD})[\"'”’]?"
_BEHIND = (rf"(?U)^(\s*\(\s*(?:이하\s*)?\s*[\"'“‘]?)({_WORD})[\"'”’]?(?:이?라\s+한다)?\s*\)", rf"(?U)^(\s*,?\s*이하\s+\s*[\"'“‘]?)({_WORD})[\"'”’]?(?!\w)")
_BEFORE, _CLOSED, BEFORE = rf"(?<!\w)({_WORD})(\s*\(\s*)$", r"(?U)^\s*\)", 24
_WORD_CHARACTER = r"[\p{L}\p{N}\p{M}_]"
LONGEST_WORD = 96


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(matching.row_of().alias("row"), "text")


def definitions(docs: DataFrame, bindings: DataFrame) -> DataFrame:
    """row, alias, long_form, entity_id, start and end of NAME(SHORT), NAME(이하 SHORT) and NAME, 이하 SHORT.

    bindings: item_id, entity_id, surface, profile. The long form, or where it is unknown a longer one in parentheses,
    must hold a known name, folded as its profile says, of at least COVERED of its length.
    """
    told = _keyed(docs).where(F.col("text").rlike(r"\(|이하")).select("row", F.inline(D.told_udf("text"))).select("row", "start", "end", F.trim("long").alias("long"), F.trim("short").alias("short"))
    each = told.where("long != '' and short != '' and long != short").distinct()
    forms = each.select(F.col("long").alias("doc_id")).union(each.select("short")).distinct()
    known = exact.profile_matches(forms.select("doc_id", F.col("doc_id").alias("text")), bindings)
    whole = known.where(F.col("end") - F.col("start") >= COVERED * F.length("text")).select(F.col("doc_id").alias("form"), "entity_id").distinct()
    forward = each.join(whole, each["long"] == whole["form"]).select("row", F.col("short").alias("alias"), F.col("long").alias("long_form"), "entity_id", "start", "end")
    rest = each.join(whole.select("form").distinct(), each["long"] == F.col("form"), "left_anti").where("length(short) > length(long)")
    back = rest.join(whole, rest["short"] == whole["form"]).select("row", F.col("long").alias("alias"), F.col("short").alias("long_form"), "entity_id", "start", "end")
    return forward.union(back)


def occurrences(docs: DataFrame, local: DataFrame) -> DataFrame:
    """row, start, end, alias and entity_id of the places where a row's own aliases (definitions()) stand outside their definition.

    A letter or digit before it, or an ASCII one behind it, voids a place; Hangul behind it may be a particle.
    """
    held = local.groupBy("row").agg(F.collect_set(F.struct("alias", "start", "end", "entity_id")).alias("own")).withColumn("aliases", F.array_distinct(F.transform("own", lambda o: o["alias"])))
    texts = _keyed(docs).where(F.col("text").rlike(r"\(|이하")).join(held, "row")
    # the text ends here: a place is told with its short form and the characters beside it
    at = texts.select("row", "own", "aliases", F.inline(D.uses_udf("text", "aliases")))
    free = ~F.col("before").rlike(r"[\p{L}\p{N}]") & ~F.col("after").rlike("^[0-9A-Za-z]")
    alias = F.get("aliases", F.col("n"))
    mine = F.filter("own", lambda o: (o["alias"] == alias) & ~((o["start"] <= F.col("at")) & (F.col("at") < o["end"])))
    used = at.where(free).withColumnRenamed("start", "at").select("row", "at", F.explode(F.array_distinct(F.transform(mine, lambda o: F.struct(o["alias"].alias("alias"), o["entity_id"].alias("entity_id"))))).alias("o"))
    return used.select("row", F.col("at").alias("start"), (F.col("at") + F.length("o.alias")).alias("end"), "o.alias", "o.entity_id").distinct()


def fold(c: Column) -> Column:
    return T.fold_case(T.fold_width(T.nfc_where_needed(c)))


def beside(text: Column, start: Column, end: Column) -> Column:
    """(long, found): the mention, folded, and (at, short) of the short forms that stand behind a mention, or before it with the mention in parentheses."""
    after = F.substring(text, end + 1, F.length(text))
    behind = [F.struct((end + F.length(F.regexp_extract(after, p, 1))).alias("at"), F.regexp_extract(after, p, 2).alias("short")) for p in _BEHIND]
    # one of the two stands there; the second is looked at where the first does not match
    forward = F.when(behind[0]["short"] != "", behind[0]).otherwise(behind[1])
    edge = F.greatest(start - BEFORE, F.lit(0))
    wide = F.substring(text, F.greatest(edge, F.lit(1)), start - F.greatest(edge, F.lit(1)) + 1)  # one character more, where there is one, for the word's start
    short, gap = (F.when(edge > 0, F.regexp_extract(wide, rf"(?Us)^.(?:.*?){_BEFORE}", i)).otherwise(F.regexp_extract(wide, rf"(?Us)^(?:.*?){_BEFORE}", i)) for i in (1, 2))
    reverse = F.when(F.substring(text, end + 1, F.lit(8)).rlike(_CLOSED), F.struct((start - F.length(gap) - F.length(short)).alias("at"), short.alias("short")))
    return F.struct(fold(F.substring(text, start + 1, end - start)).alias("long"), F.array(forward, reverse).alias("found"))


def defined_by_mentions(mentions: DataFrame) -> DataFrame:
    """row, alias (folded), entity_id, sure, start and end of short forms that stand behind a mention, or before it with the mention in parentheses.

    mentions: row, start, end, entity_id, sure (resolved) and text, or beside() of it, which spares later steps the texts; a
    row for each entity that a mention may be. A short form is shorter than the mention.
    """
    near = F.col("beside") if "beside" in mentions.columns else beside(F.col("text"), F.col("start"), F.col("end"))
    told = mentions.select("row", "entity_id", "sure", near.alias("b")).select("row", "entity_id", "sure", F.col("b.long").alias("long"), F.explode("b.found").alias("d")).where("d.short != ''")
    out = told.select("row", fold(F.col("d.short")).alias("alias"), "long", "entity_id", "sure", F.col("d.at").alias("start"), (F.col("d.at") + F.length("d.short")).alias("end"))
    return out.where("length(alias) < length(long)").groupBy("row", "alias", "entity_id", "start", "end").agg(F.bool_or("sure").alias("sure"))


def word_occurrences(docs: DataFrame, local: DataFrame, taken: DataFrame) -> DataFrame:
    """row, start, end, alias, entity_id and sure of words that are a short form of their own row, bare or with particles.

    local: defined_by_mentions(); taken: row, start, end of mentions, whose words stay theirs. The bare word counts before
    its cores, of which the shortest does; a word whose core is where the short form is defined is none.
    """
    held = local.groupBy("row").agg(F.collect_set("alias").alias("forms"))
    found = _keyed(docs).join(held, "row").select("row", F.inline(D.words_udf("text", "forms", F.lit(LONGEST_WORD))))
    whole = found.where(~F.col("before").rlike(_WORD_CHARACTER) & ~F.col("after").rlike(_WORD_CHARACTER)).select("row", "start", "end", "word", "n").distinct()
    free = matching.overlap_join(whole, taken.select("row", "start", "end").distinct(), "row", how="anti")
    near = free.select("row", "start", "end", fold(F.left("word", F.col("n"))).alias("alias"), F.left("word", F.col("n")).alias("core"), F.substring("word", F.col("n") + 1, F.lit(LONGEST_WORD)).alias("tail"))
    read = near.select("tail", F.right("core", F.lit(1)).alias("last")).distinct().withColumn("chains", F.when(F.col("tail") == "", F.lit("-")).otherwise(H.chains_udf("tail", "last")))
    whole = near.withColumn("last", F.right("core", F.lit(1))).join(read, ["tail", "last"]).where(F.exists(F.split("chains", r"\|"), lambda c: (c != "") & ~c.endswith("*")))
    best = matching.best_first(whole.withColumn("end", F.col("start") + F.length("core")), ["row", "start"], [F.col("tail") != "", F.asc("end")]).select("row", "start", "end", "alias")
    fresh = best.join(local.select("row", "start", "end").distinct(), ["row", "start", "end"], "left_anti")
    senses = local.groupBy("row", "alias", "entity_id").agg(F.bool_or("sure").alias("sure"))
    return fresh.join(senses, ["row", "alias"]).select("row", "start", "end", "alias", "entity_id", "sure")
