"""Normalization, offsets, scripts, n-grams, matching: queries over documents and literal relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching
from .base import literal, query, quoted, table

TEXTS = [(1, "ＡＰ 점검"), (2, "한​전 방문"), (3, "A.P. 장애"), (4, "한국 전력공사"), (5, "S‐Oil · KT&G"), (6, "0O 1lI 5S"), (7, ""), (8, "😀한전 AP"), (9, "한전KDN은 AP 장애 내용을 QMS에 등록했다.")]
_REL = literal(TEXTS, "id", "s")


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "id bigint, s string")


def wide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal texts and all documents as if typed in full width, with a character of no width behind each blank."""
    wide = F.translate(F.replace("text", F.lit(" "), F.lit(" \u200b")), T.NARROW, T.WIDE)
    return texts(spark).union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, wide))


def _tr(c: str, a: str, b: str) -> str:
    return f"translate({c}, {quoted(a)}, {quoted(b)})"


_WIDE = f"(SELECT id, s FROM {_REL} UNION ALL SELECT doc_id + 1000, {_tr("replace(text, ' ', ' ' || chr(8203))", T.NARROW, T.WIDE)} FROM documents) AS t(id, s)"
_KEYS = {}
for _name, (_case, _chars, _space, _ocr) in T.PROFILES.items():
    _sql = _tr(_tr("nfc_normalize(s)", T.WIDE, T.NARROW), T.ZERO_WIDTH, "")
    _sql = _tr(_sql, T.UPPER, T.LOWER) if _case else _sql
    _sql = _tr(_sql, _chars, "") if _chars else _sql
    _sql = f"regexp_replace({_sql}, '\\s', '', 'g')" if _space else _sql
    _KEYS[_name] = _tr(_sql, "".join(T.OCR_GROUPS), "".join(g[0] * len(g) for g in T.OCR_GROUPS)) if _ocr else _sql


@query("p02_width_fold", f"SELECT id, {_tr('s', T.WIDE, T.NARROW)} AS folded FROM {_WIDE}")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_texts(spark, sf_dir).select("id", T.fold_width(F.col("s")).alias("folded"))


@query("p03_case_fold", "SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS folded FROM documents")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_case(F.col("text"))).alias("folded"))


@query("p04_drop_punctuation", f"SELECT doc_id, length(text) - length({_tr('text', T.HYPHENS + T.MIDDOTS, '')}) AS dropped FROM documents")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(c) - F.length(T.drop_chars(c, T.HYPHENS + T.MIDDOTS))).cast("bigint").alias("dropped"))


@query("p05_drop_space", r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS kept FROM documents")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.drop_space(F.col("text"))).cast("bigint").alias("kept"))


@query("p07_zero_width", f"SELECT id, {_tr('s', T.ZERO_WIDTH, '')} AS cleaned, length(s) - length({_tr('s', T.ZERO_WIDTH, '')}) AS gaps FROM {_WIDE}")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_texts(spark, sf_dir).select("id", T.drop_zero_width(F.col("s")).alias("cleaned"), T.zero_width_gaps(F.col("s")).alias("gaps"))


@query("p08_ocr_fold", f"SELECT id, {_tr('s', ''.join(T.OCR_GROUPS), ''.join(g[0] * len(g) for g in T.OCR_GROUPS))} AS folded FROM {_WIDE}")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_texts(spark, sf_dir).select("id", T.fold_ocr(F.col("s")).alias("folded"))


@query("p10_alias_keys", " UNION ALL ".join(f"SELECT id, '{n}' AS profile, md5({k}) AS alias_key FROM {_WIDE}" for n, k in _KEYS.items()))
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under all profiles in one pass, told by their digests."""
    keys = F.array(*[F.struct(F.lit(n).alias("profile"), F.md5(T.alias_key(F.col("s"), n)).alias("alias_key")) for n in T.PROFILES])
    return wide_texts(spark, sf_dir).select("id", F.inline(keys))


PROFILE_ROWS = [("b1", "latin_acronym", None, None), ("b2", "korean_org_name", "strict", True), ("b3", "nowhere", None, None), ("b4", None, "tolerant", False)]


@query("p11_profile_override", f"""
SELECT b.binding, coalesce(b.spacing, p.spacing, 'strict') AS spacing, coalesce(b.folds, p.folds, FALSE) AS folds
FROM {literal(PROFILE_ROWS, 'binding', 'profile', 'spacing', 'folds').replace('AS t(', 'AS b(')}
LEFT JOIN {literal([(n, 'tolerant' if v[2] else 'strict', v[0]) for n, v in T.PROFILES.items()], 'profile', 'spacing', 'folds').replace('AS t(', 'AS p(')} ON b.profile = p.profile""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.createDataFrame(PROFILE_ROWS, "binding string, profile string, spacing string, folds boolean").alias("b")
    p = spark.createDataFrame([(n, "tolerant" if v[2] else "strict", v[0]) for n, v in T.PROFILES.items()], "profile string, spacing string, folds boolean").alias("p")
    return b.join(F.broadcast(p), F.col("b.profile") == F.col("p.profile"), "left").select("binding", F.coalesce("b.spacing", "p.spacing", F.lit("strict")).alias("spacing"), F.coalesce("b.folds", "p.folds", F.lit(False)).alias("folds"))


@query("p12_offsets", f"""
SELECT id, p::BIGINT AS codepoint, strlen(substring(s, 1, p))::BIGINT AS byte,
       (SELECT coalesce(sum(CASE WHEN unicode(substring(s, i::INT, 1)) > 65535 THEN 2 ELSE 1 END), 0) FROM range(1, p + 1) r(i))::BIGINT AS utf16
FROM (SELECT id, s, unnest(range(0, length(s) + 1))::INT AS p FROM {_REL}) x""")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = texts(spark).select("id", "s", F.explode(F.sequence(F.lit(0), F.length("s"))).alias("p"))
    return at.select("id", F.col("p").cast("bigint").alias("codepoint"), T.byte_offset(F.col("s"), F.col("p")).alias("byte"), T.utf16_offset(F.col("s"), F.col("p")).alias("utf16"))


@query("p13_content_id", "SELECT n_nationkey, substring(sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'), 1, 32) AS content_id FROM nation")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", T.content_id(F.col("n_nationkey"), F.col("n_name")).alias("content_id"))


@query("p20_clean", r"SELECT doc_id, md5(left(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), 2000)) AS cleaned FROM documents")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = F.left(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit(2000))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned).alias("cleaned"))


@query("p21_alnum_fold", r"SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS folded FROM benchmark")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.alnum_fold(F.col("text")).alias("folded"))


ANSWERS = [(1, "  Yes "), (2, "아니오"), (3, "the  OLD \n mill"), (4, "no"), (5, "예"), (6, ""), (7, "\u1112\u1161\u11ab É"), (8, "네 ")]


@query("p22_answer", f"""
SELECT id, q AS answer, CASE WHEN q IN ('예', '네') THEN 'yes' WHEN q IN ('아니오', '아니요') THEN 'no' ELSE q END AS judged
FROM (SELECT id, lower(trim(regexp_replace(nfc_normalize(a), '\\s+', ' ', 'g'))) AS q FROM {literal(ANSWERS, 'id', 'a')}) x""")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "id int, a string").select("id", T.answer(F.col("a")).alias("answer"), T.answer(F.col("a"), True).alias("judged"))


@query("p23_profile_text", "SELECT p_partkey, concat_ws('. ', p_name, p_type, p_brand) AS profile FROM part")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(". ", "p_name", "p_type", "p_brand").alias("profile"))


_J17 = """
SELECT d.doc_id, b.item_id, p::BIGINT AS start, (p + length(b.text))::BIGINT AS "end", d.source, d.text, b.text AS surface FROM documents d JOIN benchmark b ON contains(d.text, b.text),
LATERAL (SELECT unnest(list_filter(range(0, length(d.text) - length(b.text) + 1), lambda i: substring(d.text, i::INT + 1, length(b.text)) = b.text)) AS p) q"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of the benchmark's items in the documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("surface"))
    return matching.literal_matches(table(spark, sf_dir, "documents"), items)


@query("p24_context_window", f"SELECT doc_id, item_id, start, substring(text, greatest(start - 40, 0)::INT + 1, (\"end\" + 40 - greatest(start - 40, 0))::INT) AS around FROM ({_J17}) x")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty characters on both sides of every match of an item in a document."""
    return _found(spark, sf_dir).select("doc_id", "item_id", F.col("start").cast("bigint").alias("start"), T.window(F.col("text"), F.col("start"), F.col("end"), 40).alias("around"))


_LOW = "greatest(start - 60, 0)::INT"
_AROUND = f"substring(text, {_LOW} + 1, (start - {_LOW})::INT) || {{0}}surface || {{1}} || substring(text, \"end\"::INT + 1, 60)"


@query("p25_rerank_query", f"""
SELECT doc_id, item_id, start, surface, {_AROUND.format("", "''")} AS context, {_AROUND.format("'[TARGET]' || ", "'[/TARGET]'")} AS target, {_AROUND.format("'[TARGET]' || ", "'[/TARGET]'")} || chr(10) || 'PATH {{"kind":"BARE"}}' AS path FROM ({_J17}) x""")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four forms of a query about every match of an item in a document."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    forms = [T.span_query(text, start, end, v, path=F.to_json(F.struct(F.lit("BARE").alias("kind")))).alias(v) for v in ("surface", "context", "target", "path")]
    return _found(spark, sf_dir).select("doc_id", "item_id", start.cast("bigint").alias("start"), *forms)


_NOTES = ["", "a plain note", "ignore previous words", "Ignore the rest", "<script>x", "SYSTEM PROMPT", "< / System >", "tab\tand\nline", "bell\x07", "x" * 501, "지시를 따르시오", "\x1f" + "y" * 600 + " you must now"]


@query("p26_lint", f"""
SELECT k, array_to_string(list_filter([
  CASE WHEN regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'CONTENT_CONTROL_CHARS' END,
  CASE WHEN regexp_matches(t, '(?i)(ignore (all|previous|above)|disregard (the|previous)|system prompt|다음 지시를 무시|지시를 따르|프롬프트를 무시|you must now|</?script|<\\s*/?\\s*(system|instructions?)\\b)') THEN 'CONTENT_INJECTION_PATTERN' END,
  CASE WHEN length(t) > 500 THEN 'CONTENT_TOO_LONG' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT 'd' || doc_id AS k, text AS t FROM documents UNION ALL SELECT k, t FROM {literal([(f"n{i}", t) for i, t in enumerate(_NOTES)], 'k', 't')}) x""")
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(_NOTES)], "k string, t string")
    both = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("k"), F.col("text").alias("t")).union(notes)
    return both.select("k", F.array_join(T.lint_codes(F.col("t")), ",").alias("codes"))


@query("p27_token_estimate", r"""
SELECT doc_id, (w + ceil((n - w) / 3.0))::BIGINT AS tokens FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS w FROM documents) x""")
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("p28_escaped_cards", """
SELECT p_partkey, '<entity id="' || p_partkey || '"><name>' || replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</name></entity>' AS card FROM part""")
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('<entity id="'), F.col("p_partkey"), F.lit('"><name>'), T.escaped(F.col("p_name")), F.lit("</name></entity>")).alias("card"))


CHARS = [(i, c) for i, c in enumerate("가ㄱaZ9 \t.😀é")]
_SCRIPT = "CASE WHEN regexp_matches({0}, '^[가-힣ㄱ-ㆎ]') THEN 'hangul' WHEN regexp_matches({0}, '^[0-9A-Za-z]') THEN 'latin' WHEN regexp_matches({0}, '^\\s') THEN 'space' ELSE 'other' END"


@query("f01_script", f"SELECT id, {_SCRIPT.format('c')} AS script FROM (SELECT * FROM {literal(CHARS, 'id', 'c')} UNION ALL SELECT DISTINCT unicode(x) + 1000, x FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS x FROM documents)) AS t(id, c)")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some characters of each script, and every character that documents hold."""
    held = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))).alias("c")).distinct()
    rows = spark.createDataFrame(CHARS, "id bigint, c string").union(held.select(F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("bigint") + 1000, "c"))
    return rows.select("id", T.script(F.col("c")).alias("script"))


@query("f10_input_limits", "SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) > 65536 THEN 'TOO_LARGE' WHEN length(trim(text)) = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM documents")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("n_bytes"), F.when(size > 65536, "TOO_LARGE").when(F.length(F.trim("text")) == 0, "EMPTY").otherwise("OK").alias("status"))


WORDS = ["kepco", "kepc", "kepko", "epco", "kkepco", "kepcos", "kecpo", "msit", "mist", "msi", "ms", "m", "", "한전", "한국전", "한국전력", "힌전", "kepco"]
_WORDS = literal([(i, w) for i, w in enumerate(WORDS)], "k", "s")


@query("m10_one_edit", f"SELECT a.k AS a, b.k AS b FROM (SELECT * FROM {_WORDS}) a, (SELECT * FROM {_WORDS}) b WHERE a.k < b.k AND strlen(a.s || b.s) = length(a.s || b.s) AND levenshtein(a.s, b.s) = 1 UNION ALL SELECT * FROM (VALUES (13, 14), (13, 16), (14, 15)) AS hangul(a, b) UNION ALL SELECT -1 - a.n_nationkey, -1 - b.n_nationkey FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) = 1")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "k bigint, s string")
    nations = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("k"), F.col("n_name").alias("s"))
    pairs = matching.one_edit_pairs(rows, "k", "s").union(matching.one_edit_pairs(nations, "k", "s").select(F.greatest("a", "b"), F.least("a", "b")))
    return pairs.select("a", "b")


_GRAMS = "list_distinct(CASE WHEN length({0}) >= 2 THEN list_transform(range(1, length({0})), lambda i: substring({0}, i::INT, 2)) WHEN length({0}) > 0 THEN [{0}] ELSE [] END)"


@query("m12_grams", f"SELECT p_partkey, len({_GRAMS.format('p_name')}) AS n_grams FROM part")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.grams(F.col("p_name"))).cast("bigint").alias("n_grams"))


@query("m13_dice", f"""
SELECT a, b, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS dice FROM (
  SELECT p.p_partkey AS a, q.p_partkey AS b, {_GRAMS.format('p.p_name')} AS x, {_GRAMS.format('q.p_name')} AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1) z""")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").select("p_partkey", T.grams(F.col("p_name")).alias("g"))
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(T.dice(F.col("a.g"), F.col("b.g")), 9).alias("dice"))


@query("m14_character_f1", """
WITH c AS (SELECT item_id, ch, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark) x WHERE ch <> '' GROUP BY ALL),
t AS (SELECT item_id, sum(n) AS size FROM c GROUP BY 1)
SELECT a.item_id, round(2.0 * sum(least(a.n, b.n)) / (min(s.size) + min(u.size)), 9) AS f1
FROM c a JOIN c b ON b.item_id = a.item_id + 1 AND a.ch = b.ch JOIN t s ON s.item_id = a.item_id JOIN t u ON u.item_id = a.item_id + 1 GROUP BY a.item_id""")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("size"), F.explode(F.split("text", "")).alias("ch")).where("ch != ''").groupBy("item_id", "size", "ch").agg(F.count("*").alias("n"))
    a, b = c.alias("a"), c.alias("b")
    both = a.join(b, (F.col("b.item_id") == F.col("a.item_id") + 1) & (F.col("a.ch") == F.col("b.ch")))
    return both.groupBy(F.col("a.item_id").alias("item_id")).agg(F.round(2.0 * F.sum(F.least("a.n", "b.n")) / (F.min("a.size") + F.min("b.size")), 9).alias("f1"))


BUDGETS = [(1, 6, 2), (2, 8, 3), (3, 10, 4), (4, 12, 5), (5, 30, 10)]


@query("m11_fuzzy_budget", f"SELECT id, CASE WHEN s <= 2 THEN NULL WHEN s <= 4 THEN 0.35 ELSE round(least(1.2, 0.25 + 0.06 * j), 9) END::DOUBLE AS budget FROM (SELECT * FROM {literal(BUDGETS, 'id', 'j', 's')} UNION ALL SELECT p_partkey + 1000, length(p_name), p_partkey % 9 FROM part) AS t(id, j, s)")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey") + 1000, F.length("p_name"), (F.col("p_partkey") % 9).cast("int"))
    return spark.createDataFrame(BUDGETS, "id bigint, j int, s int").union(parts).select("id", F.round(T.fuzzy_budget(F.col("j"), F.col("s")), 9).alias("budget"))


@query("m16_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z]+|[가-힣]+')) AS runs, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS words FROM documents")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit("[0-9A-Za-z]+|[가-힣]+"), F.lit(0))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(runs).cast("bigint").alias("runs"), F.size(words).cast("bigint").alias("words"))


@query("s23_sentences", r"""
SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*\n?|\n') AS s FROM documents) x WHERE len(s) > 0""")
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]*\n?|\n"), F.lit(0)).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"))


PROSE = [(1, "첫 문단. 둘째 문장!\n\n 둘째 문단"), (2, "a.b c. d"), (3, "\n\n\n"), (4, "one\n \t\n\n\ntwo? three"), (5, ""), (6, "end.\n\n\n"), (7, "3.14 is pi. ok")]
PARAGRAPHS = [(1, 0, 12), (1, 14, 20), (2, 0, 8), (4, 0, 3), (4, 9, 19), (6, 0, 4), (7, 0, 14)]
SENTENCES = [(1, 0, 5), (1, 5, 12), (1, 12, 20), (2, 0, 6), (2, 6, 8), (4, 0, 13), (4, 13, 19), (6, 0, 4), (7, 0, 11), (7, 11, 14)]


@query("m17_paragraphs", "SELECT 'paragraph' AS kind, * FROM " + literal(PARAGRAPHS, "id", "start", '"end"') + " UNION ALL SELECT 'sentence', * FROM " + literal(SENTENCES, "id", "start", '"end"'))
def m17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs between blank lines, and sentences, with offsets."""
    rows = spark.createDataFrame(PROSE, "id int, s string")
    parts = rows.select(F.lit("paragraph").alias("kind"), "id", F.inline(T.spans_between(F.col("s"), T.PARAGRAPH_BREAK)))
    return parts.union(rows.select(F.lit("sentence"), "id", F.inline(T.sentence_spans(F.col("s")))))


@query("m17_document_paragraphs", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n+'), lambda x: regexp_matches(x, '\S'))) AS paragraphs FROM documents")
def m17_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.spans_between(F.col("text"), T.PARAGRAPH_BREAK)).cast("bigint").alias("paragraphs"))


@query("m19_passages", "SELECT doc_id, s AS start, least(s + 1000, length(text)) AS \"end\", md5(substring(text, s::INT + 1, 1000)) AS passage FROM (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS s FROM documents) x WHERE s = 0 OR s + 100 < length(text)")
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 1000 characters, 100 shared by neighbours; none that the one before holds already."""
    cut = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(T.passages(F.col("text"))).alias("s"))
    return cut.select("doc_id", F.col("s").cast("bigint").alias("start"), F.least(F.col("s") + 1000, F.length("text")).cast("bigint").alias("end"), F.md5(F.substring("text", F.col("s") + 1, F.lit(1000))).alias("passage"))


@query("j17_literal_matches", f'SELECT doc_id, item_id, start, "end" FROM ({_J17}) x')
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "item_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("f02_boundaries", f"""
SELECT doc_id, item_id, start, (start = 0 OR sa IN ('space', 'other') OR sb IN ('space', 'other') OR sa <> sb) AND (edge = '' OR sc IN ('space', 'other') OR sd IN ('space', 'other') OR sc <> sd) AS bounded FROM (
  SELECT doc_id, item_id, start, edge, {_SCRIPT.format('pre')} AS sa, {_SCRIPT.format('fst')} AS sb, {_SCRIPT.format('lst')} AS sc, {_SCRIPT.format('edge')} AS sd FROM (
    SELECT *, CASE WHEN start > 0 THEN substring(text, start::INT, 1) ELSE '' END AS pre, substring(text, start::INT + 1, 1) AS fst, substring(text, "end"::INT, 1) AS lst, substring(text, "end"::INT + 1, 1) AS edge FROM ({_J17}) x) y) z""")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("surface"))
    found = matching.with_boundaries(matching.literal_matches(table(spark, sf_dir, "documents"), items))
    return found.select("doc_id", "item_id", F.col("start").cast("bigint").alias("start"), "bounded")


@query("q01_primary_mentions", f"""
WITH m AS (SELECT doc_id, item_id, start, "end", source, strlen(surface) AS n FROM ({_J17}) x),
kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.start < m."end" AND m.start < o."end"
  AND (o."end" - o.start > m."end" - m.start OR o."end" - o.start = m."end" - m.start AND (o.start < m.start OR o.start = m.start AND o.item_id < m.item_id))))
SELECT source, count(*) AS mentions, count(DISTINCT doc_id) AS docs, sum(n)::BIGINT AS bytes FROM kept GROUP BY source""")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary match, non-overlapping primary mentions, counts by source."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("surface"))
    found = matching.literal_matches(docs, items).withColumn("bytes", F.octet_length("surface").cast("bigint")).drop("text", "surface")
    order = [F.col("start") - F.col("end"), F.col("start"), F.col("item_id")]
    kept = matching.greedy_intervals(found, "doc_id", order, ["item_id", "bytes"])
    named = kept.join(docs.select("doc_id", "source"), "doc_id")
    return named.groupBy("source").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"), F.sum("bytes").alias("bytes"))


SPANS = [(1, 0, 5, "a", False), (1, 3, 9, "b", True), (1, 9, 12, "c", False), (1, 4, 5, "d", True), (2, 0, 2, "e", True), (2, 0, 2, "f", True), (2, 2, 8, "g", False), (3, 7, 7, "h", True)]


@query("t01_primary_intervals", "SELECT * FROM (VALUES (1, 3, 9, 'b'), (1, 9, 12, 'c'), (2, 0, 2, 'e'), (2, 2, 8, 'g'), (3, 7, 7, 'h')) AS t(doc, start, \"end\", alias)")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact spans first, then longer, earlier, least alias."""
    rows = spark.createDataFrame(SPANS, "doc int, start int, end int, alias string, exact boolean")
    return matching.greedy_intervals(rows, "doc", [~F.col("exact"), F.col("start") - F.col("end"), F.col("start"), F.col("alias")], ["alias"])


_SP = literal(SPANS, "doc", "s", "e", "alias", "exact")


@query("j11_overlap", f"SELECT a.alias AS a, b.alias AS b FROM {_SP.replace('AS t(', 'AS a(')} JOIN {_SP.replace('AS t(', 'AS b(')} ON a.doc = b.doc AND a.s < b.e AND b.s < a.e AND a.alias < b.alias")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in SPANS], "doc int, start int, end int, alias string")
    return matching.overlap_join(rows, rows, "doc", 4).where("alias < r_alias").select(F.col("alias").alias("a"), F.col("r_alias").alias("b"))


@query("j12_uncovered", f"SELECT a.alias FROM {_SP.replace('AS t(', 'AS a(')} WHERE NOT EXISTS (SELECT 1 FROM {_SP.replace('AS t(', 'AS b(')} WHERE b.exact AND a.doc = b.doc AND a.s < b.e AND b.s < a.e)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SPANS, "doc int, start int, end int, alias string, exact boolean")
    return matching.overlap_join(rows, rows.where("exact").drop("exact"), "doc", 4, "anti").select("alias")


@query("j15_merged_spans", "SELECT * FROM (VALUES (1, 0, 12), (2, 0, 8), (3, 7, 7)) AS t(doc, start, \"end\")")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.merged_intervals(spark.createDataFrame([r[:3] for r in SPANS], "doc int, start int, end int"), "doc")


@query("j16_maximal_spans", f"SELECT a.alias FROM {_SP.replace('AS t(', 'AS a(')} WHERE NOT EXISTS (SELECT 1 FROM {_SP.replace('AS t(', 'AS b(')} WHERE a.doc = b.doc AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e))")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.maximal(spark.createDataFrame([r[:4] for r in SPANS], "doc int, start int, end int, alias string"), "doc").select("alias")
