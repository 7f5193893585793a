"""Tails and prefixes of names: suffix classes as a kernel, modifiers and Latin tails as native columns."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a suffix makes of the name before it.
CLASSES = {
    "NAME_PART": "부 처 청 원 국 실 과 팀 위원회 공사 공단",
    "ORG_UNIT": "본부 지사 센터 사무국 연구원 연구소 이사회 사무처 지회 분회 지점 출장소",
    "ROLE": "장 장관 차관 청장 원장 위원장 총장 사장 회장 이사장 대표 담당자 직원",
    "AFFILIATE": "그룹 증권 카드 생명 전자 건설 병원 대학 재단 협회 교향악단 서비스 써비스 헬스케어 케미칼 네트웍스 투자 리츠 제약 미디어 몰 기술 은행 홀딩스 화학 중공업 물산 해운 캐피탈 자산운용 화재",
    "DERIVED_ORG": "노조 노동조합",
    "REFERENTIAL": "측",
    "ARTIFACT": "규정 시스템 법 법안 판결 고시 훈령 조례 규칙 시행령 시행규칙 지침 예규 공고 약관 정관",
}
SUFFIXES = {s: c for c, words in CLASSES.items() for s in words.split()}
#: Class: (does the whole name the core, relation of core and whole).
READINGS = {"NAME_PART": ("SAME", "IDENTITY"), "REFERENTIAL": ("SAME", "REFERS_TO"), "ORG_UNIT": ("DISTINCT", "PART_OF"), "ROLE": ("DISTINCT", "ROLE_OF"), "AFFILIATE": ("DISTINCT", "AFFILIATE_OF"), "DERIVED_ORG": ("DISTINCT", "DERIVED_FROM"), "ARTIFACT": ("DISTINCT", "ARTIFACT_OF"), "UNKNOWN_PART": ("DISTINCT", "UNKNOWN"), "UNKNOWN": ("UNKNOWN", "UNKNOWN")}
PREFIXES = {"가칭": "NAMING", "약칭": "NAMING", "이른바": "NAMING", **dict.fromkeys("구신전현舊新前現", "TEMPORAL")}
LATIN_TAILS = {"'s": "LATIN_POSSESSIVE", "’s": "LATIN_POSSESSIVE", "es": "LATIN_PLURAL", "s": "LATIN_PLURAL"}
LONGEST = 4


#: Catalog suffixes to the end, longer ones first, after a modifier of up to LONGEST characters where there must be one.
_TAIL = regex.compile(r"(?:(?P<modifier>.{1,%d}?)(?=.))??(?P<part>%s)*" % (LONGEST, "|".join(sorted(SUFFIXES, key=len, reverse=True))), regex.DOTALL)


@lru_cache(maxsize=100_000)
def residual(chunk: str, core_end: str = "") -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """Kind, parts and classes of what follows a core; 지사 right after 도 is a person."""
    found = _TAIL.fullmatch(chunk)
    if found is None:
        return "UNKNOWN", (chunk,), ("UNKNOWN",)
    parts, modifier = found.captures("part"), found["modifier"]
    classes = [SUFFIXES[p] for p in parts]
    if parts[:1] == ["지사"] and (modifier or core_end).endswith("도"):
        classes[0] = "ROLE"
    if modifier is None:
        return "SUFFIX", tuple(parts), tuple(classes)
    return "SUFFIX_WITH_MODIFIER", (modifier, *parts), ("UNKNOWN_PART", *classes)


def _residual_text(s: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([f"{k}:{'+'.join(p)}:{'+'.join(c)}" for k, p, c in (residual(x, y) for x, y in zip(s, end))], dtype="object")


residual_udf = F.pandas_udf(_residual_text, StringType())


def prefix_modifier(left: Column) -> Column:
    """The modifier right before a core, with or without a blank, at the start of a word; empty without one. Native."""
    words = "|".join(PREFIXES)
    return F.regexp_extract(left, rf"(?:^|[^\p{{L}}\p{{N}}])({words})\x20?$", 1)


def latin_tail(right: Column) -> Column:
    """The Latin ending right after a core at a word's end; empty without one. Native."""
    return F.regexp_extract(right, r"^('s|’s|es|s)(?![0-9A-Za-z])", 1)
