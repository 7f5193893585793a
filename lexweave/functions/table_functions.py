"""Table functions for SQL: readings of what a text's tokens hold, called laterally, and folds over partitioned tables.

``register`` puts them into a session: lexical_paths(text), lexical_shapes(text), lexical_tails(run, before) and merged_spans(TABLE(..) PARTITION BY
.. ORDER BY start). Each has an analyze step, which names its columns and refuses arguments of other types before a task
starts. A worker is started once a task, whatever the number of rows; a fold holds one span of a partition at a time, so
that a partition of any size takes the same memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import segmentation as S

_PATHS = StructType([StructField("start", IntegerType()), StructField("core", StringType()), StructField("shape", StringType()), StructField("residual", StringType()), StructField("particles", ArrayType(StringType())), StructField("score", DoubleType())])
_SHAPES = StructType([StructField("shape", StringType()), StructField("n", LongType()), StructField("chars", LongType())])
_TAILS = StructType([StructField("residual", StringType()), StructField("kind", StringType()), StructField("particles", ArrayType(StringType())), StructField("identity", StringType()), StructField("score", DoubleType())])


def _of(argument: AnalyzeArgument, *kinds: type[DataType]) -> None:
    if argument.isTable or not isinstance(argument.dataType, kinds):
        raise TypeError(f"a column of type {' or '.join(k.typeName() for k in kinds)} is needed, not {'a table' if argument.isTable else argument.dataType.simpleString()}")


@lru_cache(maxsize=100_000)
def _readings(token: str) -> tuple[tuple, ...]:
    return tuple((core, tail.shape(), tail.residual, list(tail.particles), round(score, 6)) for core, tail, score in S.paths(token))


@udtf
class LexicalPaths:
    """A row for each reading of each token of a text; none for a null one."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _of(text, StringType)
        return AnalyzeResult(schema=_PATHS)

    def eval(self, text: str) -> Iterator[tuple]:
        for start, _, token, _ in S.token_spans(text or ""):
            for reading in _readings(token):
                yield start, *reading


@lru_cache(maxsize=100_000)
def _shapes(token: str) -> tuple[tuple[str, int], ...]:
    return tuple((tail.shape(), len(core)) for core, tail, _ in S.paths(token))


@udtf
class LexicalShapes:
    """A row for each shape of the readings of a text's tokens, which lexical_paths lists: how many, and the characters of
    their cores. A row for each reading is not handed over."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _of(text, StringType)
        return AnalyzeResult(schema=_SHAPES)

    def eval(self, text: str) -> Iterator[tuple]:
        n, chars = Counter(), Counter()
        for token, times in Counter(S.tokens(text or "")).items():
            for shape, size in _shapes(token):
                n[shape] += times
                chars[shape] += times * size
        for shape, of in n.items():
            yield shape, of, chars[shape]


@udtf
class LexicalTails:
    """A row for each reading of what follows a core that ends with ``before``."""

    @staticmethod
    def analyze(run: AnalyzeArgument, before: AnalyzeArgument) -> AnalyzeResult:
        _of(run, StringType)
        _of(before, StringType)
        return AnalyzeResult(schema=_TAILS)

    def eval(self, run: str, before: str) -> Iterator[tuple]:
        for t in S.tails(run or "", before or ""):
            yield t.residual, t.kind, list(t.particles), t.identity, round(t.score, 6)


@udtf
class MergedSpans:
    """Unions of touching or overlapping spans (key, start, end) of each partition, whose rows come in order of start.

    A span without a start or an end adds nothing. With ``whole`` it is counted, and rows come in order of start and end,
    nulls last: without a start it stands alone, without an end it joins the union that its start lies in, if any.
    """

    def __init__(self) -> None:
        self.held: tuple | None = None

    @staticmethod
    def analyze(spans: AnalyzeArgument, whole: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not spans.isTable:
            raise TypeError("a table of key, start and end is needed")
        if whole:
            _of(whole, BooleanType)
        names = [f.name for f in spans.dataType.fields]
        if names != ["key", "start", "end"]:
            raise TypeError(f"columns key, start and end are needed, not {', '.join(names)}")
        return AnalyzeResult(schema=StructType([spans.dataType["key"], StructField("start", LongType()), StructField("end", LongType()), StructField("spans", LongType())]))

    def eval(self, spans, whole=False) -> Iterator[tuple]:  # noqa: ANN001
        key, start, end = spans
        if not whole and (start is None or end is None):
            return
        if self.held and start is not None and self.held[2] is not None and start <= self.held[2]:
            self.held = (key, self.held[1], self.held[2] if end is None else max(self.held[2], end), self.held[3] + 1)
            return
        if self.held:
            yield self.held
        self.held = (key, start, end, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self.held


def register(spark: SparkSession) -> None:
    for name, function in (("lexical_paths", LexicalPaths), ("lexical_shapes", LexicalShapes), ("lexical_tails", LexicalTails), ("merged_spans", MergedSpans)):
        spark.udtf.register(name, function)
