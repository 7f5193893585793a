"""Native column builders for normalization, offsets, scripts, n-grams and similarity. No Python runs on the rows."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that profiles drop or fold.
HYPHENS = "-‐‑‒–—―−﹘﹣"
MIDDOTS = "·・•‧∙"
ZERO_WIDTH = "​‌‍﻿"
OCR_GROUPS = ("0OoDQ", "1lIi|", "5S", "8B", "2Z", "6G")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Full-width forms of the visible ASCII characters, and the ideographic blank.
WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "
#: Profile: (case folded, characters dropped, white space dropped, OCR look-alikes folded).
PROFILES: dict[str, tuple[bool, str, bool, bool]] = {
    "latin_acronym": (True, "." + HYPHENS, False, False),
    "latin_word": (True, HYPHENS, False, False),
    "korean_org_name": (False, HYPHENS + MIDDOTS, True, False),
    "korean_term": (False, "", False, False),
    "mixed_alnum": (True, HYPHENS + "&/", True, False),
    "ocr_tolerant": (True, "." + HYPHENS + MIDDOTS, True, True),
}


def fold_width(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def fold_case(c: Column) -> Column:
    """ASCII only: lower() would fold other scripts too."""
    return F.translate(c, UPPER, LOWER)


def drop_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "") if chars else c


def drop_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def drop_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def zero_width_gaps(c: Column) -> Column:
    return (F.length(c) - F.length(drop_zero_width(c))).cast("bigint")


def fold_ocr(c: Column) -> Column:
    """Each look-alike becomes the first of its group."""
    return F.translate(c, "".join(OCR_GROUPS), "".join(g[0] * len(g) for g in OCR_GROUPS))


def alias_key(c: Column, profile: str) -> Column:
    """The key under which a surface and a text match in a profile."""
    case, chars, space, ocr = PROFILES[profile]
    out = drop_zero_width(fold_width(nfc_where_needed(c)))
    out = fold_case(out) if case else out
    out = drop_space(drop_chars(out, chars)) if space else drop_chars(out, chars)
    return fold_ocr(out) if ocr else out  # after case: capitals that have a look-alike only as capitals stay apart


def prefix(c: Column, n: Column) -> Column:
    return F.substring(c, F.lit(1), n)


def byte_offset(c: Column, at: Column) -> Column:
    return F.octet_length(prefix(c, at)).cast("bigint")


def utf16_offset(c: Column, at: Column) -> Column:
    return (F.octet_length(F.encode(prefix(c, at), "UTF-16LE")) / 2).cast("bigint")


def content_id(*columns: Column) -> Column:
    """128 bits of the SHA-256 of the canonical JSON of the columns."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32)


def script(ch: Column) -> Column:
    return F.when(ch.rlike("^[가-힣ㄱ-ㆎ]"), "hangul").when(ch.rlike("^[0-9A-Za-z]"), "latin").when(ch.rlike(r"^\s"), "space").otherwise("other")


def token_boundary(before: Column, after: Column) -> Column:
    """Between two characters; an empty string stands for the text's edge."""
    a, b = script(before), script(after)
    return (F.length(before) == 0) | (F.length(after) == 0) | a.isin("space", "other") | b.isin("space", "other") | (a != b)


def window(c: Column, start: Column, end: Column, width: int) -> Column:
    """Up to ``width`` characters on both sides of a span, and the span."""
    low = F.greatest(start - width, F.lit(0))
    return F.substring(c, low + 1, end + width - low)


def estimated_tokens(c: Column) -> Column:
    """Characters beyond ASCII count one each, three ASCII characters count one."""
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return (wide + F.ceil((F.length(c) - wide) / 3)).cast("bigint")


def alnum_fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


YES_NO = {"예": "yes", "네": "yes", "아니요": "no", "아니오": "no"}


def answer(c: Column, yes_no: bool = False) -> Column:
    """Composed, squeezed and case-folded; with yes_no Korean yes and no become English ones."""
    out = casefolded(F.regexp_replace(F.regexp_replace(nfc_where_needed(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
    if not yes_no:
        return out
    return F.coalesce(*[F.when(out == k, F.lit(v)) for k, v in YES_NO.items()], out)


def grams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams in order; a shorter string is one gram, an empty one none."""
    whole = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(whole)).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Set F1 of two arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) == 1


def fuzzy_budget(jamo: Column, syllables: Column) -> Column:
    return F.when(syllables <= 2, F.lit(None).cast("double")).when(syllables <= 4, F.lit(0.35)).otherwise(F.least(F.lit(1.2), 0.25 + 0.06 * jamo))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


# What texts of a glossary must not hold. The Java engine folds case by Unicode with (?iu).
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
INSTRUCTS = r"(?iu)(ignore (all|previous|above)|disregard (the|previous)|system prompt|다음 지시를 무시|지시를 따르|프롬프트를 무시|you must now|</?script|<\s*/?\s*(system|instructions?)\b)"
STEERS = r"(?iu)(ignore\s+(all\s+)?previous|disregard\s+(all\s+)?previous|system\s*:|</\w+>|<\s*(system|script|terminology_context)|rm\s+-rf|sudo\s|curl\s+http|무시하(고|라)|지시를\s*무시|다음부터\s*모든|비밀|secret\s+key|api[_\s-]?key|반드시\s*실행|실행하라|출력하라)"
SENSITIVE = r"(\d{6}\s*[-–]\s*[1-4]\d{6}|\b(?:\d[ -]?){13,19}\b|\b(sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
LONGEST_DESCRIPTION = 500


def lint_codes(c: Column, most: int = LONGEST_DESCRIPTION) -> Column:
    """Codes of what a glossary's description must not hold; only control characters are errors."""
    return F.array_compact(F.array(F.when(c.rlike(CONTROL), "CONTENT_CONTROL_CHARS"), F.when(c.rlike(INSTRUCTS), "CONTENT_INJECTION_PATTERN"), F.when(F.length(c) > most, "CONTENT_TOO_LONG")))


# ---------------------------------------------------------------- kernels that Spark has no function for


def _normalized(s: pa.Array, form: str, rows: int = 64) -> pa.Array:
    """A few rows at a time: as Python objects the texts of a batch would take many times their size."""
    some = [pa.array([None if t is None else unicodedata.normalize(form, t) for t in s.slice(at, rows).to_pylist()], pa.string()) for at in range(0, len(s), rows)]
    return pa.concat_arrays(some) if some else pa.array([], pa.string())


def _nfc(s: pa.Array) -> pa.Array:
    return _normalized(s, "NFC")


def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


_nfc_udf, _casefold_udf = F.arrow_udf(_nfc, StringType()), F.pandas_udf(_casefold, StringType())


def nfc_where_needed(c: Column) -> Column:
    """NFC; texts without a character from U+0300 on are composed as they are and skip the kernel."""
    return F.when(c.rlike(r"[^\x00-˿]"), _nfc_udf(c)).otherwise(c)


def _nfd(s: pa.Array) -> pa.Array:
    return _normalized(s, "NFD")


#: NFD: conjoining jamo for Hangul syllables.
nfd = F.arrow_udf(_nfd, StringType())


def casefolded(c: Column) -> Column:
    """Unicode case folding; ASCII texts skip the kernel."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _casefold_udf(c)).otherwise(F.lower(c))


def span_query(text: Column, start: Column, end: Column, variant: str = "target", radius: int = 60, path: Column | None = None) -> Column:
    """What a reranker is asked about a span: its surface, its surroundings, these with marks, or marks and a reading."""
    low = F.greatest(start - radius, F.lit(0))
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    if variant == "surface":
        return cut(start, end)
    if variant == "context":
        return cut(low, end + radius)
    marked = F.concat(cut(low, start), F.lit("[TARGET]"), cut(start, end), F.lit("[/TARGET]"), cut(end, end + radius))
    if variant == "target":
        return marked
    if variant != "path" or path is None:
        raise ValueError(f"unknown variant {variant!r}, or no reading given")
    return F.concat(marked, F.lit("\nPATH "), path)


def codepoint_of_byte(c: Column, at: Column) -> Column:
    """The code point offset of a byte offset; null inside a character and beyond the text."""
    raw = F.encode(c, "UTF-8")
    lead = F.hex(F.substring(raw, at + 1, F.lit(1)))
    inside = lead.rlike("^[89AB]")
    return F.when((at < 0) | (at > F.octet_length(c)) | inside, F.lit(None).cast("bigint")).otherwise(F.length(F.decode(F.substring(raw, F.lit(1), at), "UTF-8")).cast("bigint"))


def spans_between(c: Column, pattern: str) -> Column:
    """[start, end) of what the matches of a pattern part, if it holds more than white space, in order. Native.

    The pattern must be free of look-around, as its matches are cut out of the text one by one.
    """
    parts = F.split(c, pattern)
    breaks = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    steps = F.arrays_zip(parts.alias("part"), breaks.alias("gap"))
    walk = F.aggregate(
        F.transform(steps, lambda x: F.struct(F.length(x["part"]).alias("n"), F.coalesce(F.length(x["gap"]), F.lit(0)).alias("gap"), x["part"].rlike(r"(?U)\S").alias("full"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")),
        lambda s, x: F.struct((s["at"] + x["n"] + x["gap"]).alias("at"), F.when(x["full"], F.array_append(s["found"], F.struct(s["at"].alias("start"), (s["at"] + x["n"]).alias("end")))).otherwise(s["found"]).alias("found")),
        lambda s: s["found"],
    )
    return walk


def matched_spans(c: Column, pattern: str, groups: int = 0) -> Column:
    """(start, end, g1, .., text) of the matches of a pattern, from the left, none overlapping. Native.

    The pattern must be free of look-around and match no empty string: the next match is then where the string that it
    matched stands next.
    """
    found = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(i + 1)).alias(f"g{i}") for i in range(groups + 1)])
    kind = "array<struct<start:int,end:int" + "".join(f",g{i}:string" for i in range(1, groups + 1)) + ",text:string>>"

    def step(s: Column, x: Column) -> Column:
        at = F.call_function("locate", x["g0"], c, s["at"] + 1) - 1
        own = F.struct(at.alias("start"), (at + F.length(x["g0"])).alias("end"), *[x[f"g{i}"].alias(f"g{i}") for i in range(1, groups + 1)], x["g0"].alias("text"))
        return F.struct((at + F.length(x["g0"])).alias("at"), F.array_append(s["found"], own).alias("found"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")), step, lambda s: s["found"])


PARAGRAPH_BREAK = r"\n[ \t\r]*\n+"


def sentence_spans(c: Column) -> Column:
    """[start, end) of sentences: up to a full stop or the like before white space or the end. Native."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(.*?[.!?。？！](?=\s|$)|.+$)"), F.lit(1))
    return F.aggregate(
        F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.rlike(r"(?U)\S").alias("full"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")),
        lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.when(x["full"], F.array_append(s["found"], F.struct(s["at"].alias("start"), (s["at"] + x["n"]).alias("end")))).otherwise(s["found"]).alias("found")),
        lambda s: s["found"],
    )


def passages(c: Column, size: int = 1000, shared: int = 100) -> Column:
    """Starts of passages of ``size`` characters, ``shared`` of them with the one before; the last one ends the text."""
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / (size - shared)).cast("int"))
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * (size - shared))).otherwise(F.array().cast("array<int>"))
