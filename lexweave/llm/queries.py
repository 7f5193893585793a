"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, fill_in_middle, filter_audit, language_id, outliers, parity_join, pii, rule_ensemble, streaming_viterbi, suffix_tree, token_counts, token_files, warc


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), folder, least=0)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(common.table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(common.table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "token-files")
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rejected(common.table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.grouped(common.table(spark, sf_dir, "documents"))


def op9_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and whether decoding them gives the text back (U+2581 as the blank that it stands for)."""
    coded = streaming_viterbi.encode(common.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), restored=True)
    return coded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "restored")


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_ensemble.scored(docs, common.table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(common.table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(common.table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    back = fill_in_middle.restore(made, ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))
    return back.withColumn("restored_sha256", F.sha2("text", 256)).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_weak_pii": op2_weak_pii,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_robust_outliers": op6_robust_outliers,
    "op7_decontamination": op7_decontamination,
    "op8_parity_join": op8_parity_join,
    "op9_streaming_viterbi": op9_streaming_viterbi,
    "op10_rule_ensemble": op10_rule_ensemble,
    "op11_filter_audit": op11_filter_audit,
    "op12_language_id": op12_language_id,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL for those that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, (i // 4)::INT * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS b FROM (SELECT DISTINCT h FROM p)),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS turn, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, b AS payload_digest, CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN best END AS refers_to FROM r JOIN d USING (h)""",
    "op8_parity_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
every AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
t AS (SELECT * FROM every WHERE g IN (SELECT g FROM every GROUP BY g HAVING count(*) > 1)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least AS component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) USING (doc_id)""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lo FROM documents),
m AS (SELECT d.part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > lo, FALSE)] AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own, list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, fails, n, good, toxic, own, fails[own] AS fails_own, step > 1 AND list_bool_or(list_transform(before, lambda i: coalesce(fails[i], FALSE))) AS gone FROM g, s),
t AS (SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE gone AND fails_own), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails_own AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_own), 0)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS k FROM d),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS lo, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS hi, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
