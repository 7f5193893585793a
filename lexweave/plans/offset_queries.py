"""Offsets through folds and between units, over all documents with a planted paragraph."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import offsets as O
from .base import literal, planted, planted_sql, query, table

_APART = unicodedata.normalize("NFD", "한국전력")
#: Sentence, what its fold holds, and the raw span of that in the sentence.
FOLDED = [(f"앞 {_APART} 뒤", "한국전력", 2, 2 + len(_APART)), ("앞 한​국전력 뒤", "한국전력", 2, 7), ("앞 ＱＭＳ 뒤", "QMS", 2, 5), ("앞 ㎏단위 뒤", "kg단위", 2, 5), ("앞 ﬁ한 뒤", "i한", 2, 4)]
_FOLDS = planted_sql([r[0] for r in FOLDED])


@query("p01_folded_spans", f"SELECT doc_id, base + a AS start, base + b AS \"end\" FROM {_FOLDS} d JOIN {literal([(k, r[2], r[3]) for k, r in enumerate(FOLDED)], 'k', 'a', 'b')} USING (k)")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed, freed of what has no width, folded for compatibility: three maps made one, and the raw span of what the fold holds."""
    docs = planted(spark, sf_dir, [r[0] for r in FOLDED]).select("doc_id", O.nfc("text").alias("a")).withColumn("b", O.visible(F.col("a.text"))).withColumn("c", O.nfkc(F.col("b.text")))
    sought = F.element_at(F.array(*[F.lit(r[1]) for r in FOLDED]), F.pmod("doc_id", F.lit(len(FOLDED))).cast("int") + 1)
    mapped = docs.select("doc_id", F.col("c.text").alias("text"), O.then(O.then(F.col("a.runs"), F.col("b.runs")), F.col("c.runs")).alias("runs"), sought.alias("sought"))
    at = F.length("text") - F.length(F.element_at(F.split("text", F.col("sought")), -1)) - F.length("sought")
    placed = mapped.withColumn("at", at)
    return placed.select("doc_id", O.raw_start(F.col("runs"), F.col("at")).alias("start"), O.raw_end(F.col("runs"), F.col("at") + F.length("sought")).alias("end"))


#: Sentence, a key of the case and width fold, and its raw span.
CLUSTERED = [("앞 ＫＥＰＣＯ 뒤", "kepco", 2, 7), (f"앞 {_APART}은 뒤", "한국전력", 2, 2 + len(_APART)), ("앞 Cafés 뒤", "café", 2, 7)]
_CLUSTERS = planted_sql([r[0] for r in CLUSTERED])


@query("p18_clusters", f"SELECT doc_id, base + a AS start, base + b AS \"end\" FROM {_CLUSTERS} d JOIN {literal([(k, r[2], r[3]) for k, r in enumerate(CLUSTERED)], 'k', 'a', 'b')} USING (k)")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the case and width fold mapped back by whole clusters of characters."""
    docs = planted(spark, sf_dir, [r[0] for r in CLUSTERED]).select("doc_id", O.cluster("text").alias("c"))
    sought = F.element_at(F.array(*[F.lit(r[1]) for r in CLUSTERED]), F.pmod("doc_id", F.lit(len(CLUSTERED))).cast("int") + 1)
    told = docs.select("doc_id", "c", sought.alias("sought"))
    at = F.length("c.text") - F.length(F.element_at(F.split("c.text", F.col("sought")), -1)) - F.length("sought")
    placed = told.withColumn("at", at)
    return placed.select("doc_id", O.raw_start(F.col("c.runs"), F.col("at")).alias("start"), O.raw_end(F.col("c.runs"), F.col("at") + F.length("sought")).alias("end"))


@query("p12_all_offsets", """
SELECT doc_id, n + 1 AS places, strlen(text) AS bytes, coalesce(list_sum(list_transform(chars, lambda c, i: strlen(c) * (n - i + 1))), 0)::BIGINT AS byte_sum, coalesce(list_sum(list_transform(chars, lambda c, i: CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END * (n - i + 1))), 0)::BIGINT AS utf16_sum
FROM (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, regexp_extract_all(coalesce(text, ''), '(?s).') AS chars FROM documents)""")
def p12_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code point offset of every document in bytes and UTF-16 units, told by their number and sums."""
    u = O.unit_rows(table(spark, sf_dir, "documents"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return u.select("doc_id", F.size("bytes").cast("bigint").alias("places"), F.element_at("bytes", -1).alias("bytes"), total(F.col("bytes")).alias("byte_sum"), total(F.col("utf16")).alias("utf16_sum"))
