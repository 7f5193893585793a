"""Tagged and masked corpora as tables: spans from tags, texts from masked usages, bad rows kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_tag_spans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (id, start, end, type, surface) of sentences (id, text, tags) and the sentences refused, with the reason.

    Tags are parted by blanks, one for each token of the text: O, or a type, a hyphen and B or I. Native: tokens and
    tags are zipped, an island begins at each B.
    """
    tokens = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    gaps = F.split("text", r"\S+")
    starts = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda g, t: F.struct(F.length(g).alias("g"), F.length(t).alias("t"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("s")),
        lambda a, x: F.struct((a["at"] + x["g"] + x["t"]).alias("at"), F.array_append(a["s"], a["at"] + x["g"]).alias("s")), lambda a: a["s"],
    )
    tags = F.filter(F.split("tags", r"\s+"), lambda t: t != "")
    told = rows.select("id", "text", tokens.alias("tokens"), tags.alias("marks"), starts.alias("starts"))
    before = F.concat(F.array(F.lit("O")), F.slice("marks", F.lit(1), F.greatest(F.size("marks") - 1, F.lit(0))))
    stray = F.exists(F.arrays_zip(F.col("marks").alias("m"), before.alias("b")), lambda x: x["m"].rlike("-I$") & ~(F.regexp_replace(x["m"], "-I$", "") == F.regexp_replace(x["b"], "-[BI]$", "")))
    reason = (
        F.when(F.size("tokens") <= 0, "empty_sentence").when(F.size("tokens") != F.size("marks"), "token_tag_length_mismatch")
        .when(F.exists("marks", lambda m: (m != "O") & ~m.rlike("^.+-[BI]$")), "invalid_bio_tag").when(stray, "invalid_bio_continuation")
    )
    judged = told.withColumn("reason", reason)
    each = judged.where("reason is null").select("id", "text", F.posexplode(F.arrays_zip("tokens", "marks", "starts")).alias("i", "x"))
    island = F.sum(F.col("x.marks").rlike("-B$").cast("int")).over(Window.partitionBy("id").orderBy("i"))
    spans = each.withColumn("g", island).where("x.marks != 'O'").groupBy("id", "g").agg(
        F.min("x.starts").alias("start"), F.max(F.col("x.starts") + F.length("x.tokens")).alias("end"), F.first(F.regexp_replace("x.marks", "-[BI]$", "")).alias("type"), F.first("text").alias("text")
    )
    return spans.select("id", "start", "end", "type", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("surface")), judged.where("reason is not null").select("id", "reason")


def masked_usages(rows: DataFrame, formations: tuple[str, ...]) -> DataFrame:
    """id, text, term, components and hash of rows (id, term, analysis, usage, formation) of the formations asked for.

    The term takes the place of [MASK]; components of the analysis are parted by +. Incomplete rows are left out.
    """
    parts = F.filter(F.transform(F.split("analysis", r"\+"), lambda p: F.trim(p)), lambda p: p != "")
    whole = rows.where(F.col("formation").isin(*formations)).withColumn("components", parts)
    kept = whole.where("id is not null and term != '' and usage != '' and size(components) > 0")
    text = F.replace("usage", F.lit("[MASK]"), F.col("term"))
    return kept.select("id", text.alias("text"), "term", "components", F.sha2(text, 256).alias("document_sha"))
