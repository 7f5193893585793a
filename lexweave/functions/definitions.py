"""Kernels that read a text for its own short forms: where it defines some, and where it uses the ones that are known.

Definitions are found from what they cannot lack, an opening parenthesis or "이하", and read backwards from there; so a text
is gone through once, whatever its length. Spans are those of the leftmost matches of the patterns, none overlapping.
Uses are sought for the short forms of the same row alone. A place comes with the characters beside it; whether these
part words is told natively.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import text as T

#: White space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NAME, _SHORT, _MARK = r"[가-힣A-Za-z0-9·\- ]", r"[가-힣A-Za-z0-9·\-]", "[\"'“”]?"
#: Characters that a name in a definition has at most.
LONGEST_NAME = 40
_PARENTHESIS = re.compile(rf"\([{_SPACE}]*(?:이하[{_SPACE}]*)?{_MARK}({_SHORT}{{1,20}}){_MARK}[{_SPACE}]*\)")
_NAME_BEFORE = re.compile(rf"{_NAME}{{2,{LONGEST_NAME}}}\Z")
_HEREAFTER = re.compile(rf"({_NAME}{{2,{LONGEST_NAME}}}),?[{_SPACE}]*이하[{_SPACE}]*{_MARK}({_SHORT}{{1,20}}){_MARK}")
_NAMED = re.compile(rf"이하[{_SPACE}]*{_MARK}{_SHORT}")
_IS_NAME, _IS_SPACE = re.compile(_NAME), re.compile(f"[{_SPACE}]")


def in_parentheses(text: str) -> Iterator[tuple[int, int, str, str]]:
    """start, end, name and short form of NAME(SHORT) and NAME(이하 SHORT)."""
    for m in _PARENTHESIS.finditer(text):
        if name := _NAME_BEFORE.search(text[max(0, m.start() - LONGEST_NAME) : m.start()]):
            yield m.start() - len(name[0]), m.end(), name[0], m[1]


def _begins(text: str, at: int, least: int) -> int:
    """The first place from ``least`` on where a name may begin that the "이하" at a place follows; -1 if none."""
    space = at
    while space > least and _IS_SPACE.match(text, space - 1):
        space -= 1
    comma = space - (space > least and text[space - 1] == ",")
    if name := _NAME_BEFORE.search(text[max(least, comma - LONGEST_NAME) : comma]):
        return comma - len(name[0])
    # a single character with a blank behind it, or two blanks
    if comma == space and least < space < at and text[space] == " " and _IS_NAME.match(text, space - 1):
        return space - 1
    return text.find("  ", space, at)


def hereafter(text: str) -> Iterator[tuple[int, int, str, str]]:
    """start, end, name and short form of NAME, 이하 SHORT."""
    last, at = 0, text.find("이하")
    while at >= 0:
        if _NAMED.match(text, at) and (start := _begins(text, at, last)) >= 0:
            m = _HEREAFTER.match(text, start)
            yield m.start(), m.end(), m[1], m[2]
            last = m.end()
        at = text.find("이하", max(at + 1, last))


def _told(text: pd.Series) -> pd.Series:
    return pd.Series([[*in_parentheses(t), *hereafter(t)] for t in text], dtype="object")


_I, _S = IntegerType(), StringType()
#: start, end, name and short form of all definitions of a text.
told_udf = F.pandas_udf(_told, ArrayType(StructType([StructField("start", _I), StructField("end", _I), StructField("long", _S), StructField("short", _S)])))


def places_of(text: str, surface: str) -> Iterator[int]:
    """Starts of occurrences that don't overlap, from the left."""
    at = text.find(surface)
    while at >= 0:
        yield at
        at = text.find(surface, at + len(surface))


def _uses(text: pd.Series, surfaces: pd.Series) -> pd.Series:
    return pd.Series([[(i, a, t[a - 1 : a] if a else "", t[a + len(s) : a + len(s) + 1]) for i, s in enumerate(own) for a in places_of(t, s)] for t, own in zip(text, surfaces)], dtype="object")


#: Number of the surface, start, and the characters beside it, of all places of a row's own surfaces in its text.
uses_udf = F.pandas_udf(_uses, ArrayType(StructType([StructField("n", _I), StructField("start", _I), StructField("before", _S), StructField("after", _S)])))

_TOKEN = re.compile("[가-힣ㄱ-ㅎㅏ-ㅣA-Za-z0-9Ａ-Ｚａ-ｚ０-９]+")
_ASCII = str.maketrans(T.WIDE + T.UPPER, T.NARROW.translate(str.maketrans(T.UPPER, T.LOWER)) + T.LOWER)


def words_from(text: str, forms: list[str], most: int) -> Iterator[tuple[int, int, str, int, str, str]]:
    """start, end, word, characters of the form, and the characters beside it, of runs of letters and digits of at most
    ``most`` characters that begin with a (folded) form, once for each form that they begin with."""
    own: dict[str, list[str]] = {}
    for f in set(forms):
        own.setdefault(f[:1], []).append(f)
    sizes = {c: sorted({len(f) for f in of}) for c, of in own.items()}
    known = set(forms)
    for m in _TOKEN.finditer(text):
        first = text[m.start()].translate(_ASCII)
        if first not in sizes or m.end() - m.start() > most:
            continue
        word = m[0].translate(_ASCII)
        for n in sizes[first]:
            if word[:n] in known and n <= len(word):
                yield m.start(), m.end(), m[0], n, text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]


def _words(text: pd.Series, forms: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([list(words_from(t, list(own), int(n))) for t, own, n in zip(text, forms, most)], dtype="object")


words_udf = F.pandas_udf(_words, ArrayType(StructType([StructField("start", _I), StructField("end", _I), StructField("word", _S), StructField("n", _I), StructField("before", _S), StructField("after", _S)])))
