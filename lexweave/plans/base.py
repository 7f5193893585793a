"""Helpers of the query modules: tables, literal relations and the registry decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query and its DuckDB counterpart."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def quoted(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(quoted, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def literal(rows: list[tuple], *names: str) -> str:
    """A DuckDB relation of literal rows."""
    body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"


# ---------------------------------------------------------------- documents with a planted sentence


def planted(spark: SparkSession, sf_dir: str, sentences: list[str]) -> DataFrame:
    """All documents, whole, each with a paragraph more: the sentence that its doc_id modulo their number picks."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), F.element_at(F.array(*map(F.lit, sentences)), F.pmod("doc_id", F.lit(len(sentences))).cast("int") + 1)))


def planted_sql(sentences: list[str]) -> str:
    """planted() as a DuckDB relation with the number of the sentence (k) and where it starts (base)."""
    return f"(SELECT * EXCLUDE (text), coalesce(text, '') || E'\\n\\n' || {quoted(sentences)}[doc_id % {len(sentences)} + 1] AS text, doc_id % {len(sentences)} AS k, length(coalesce(text, '')) + 2 AS base FROM documents)"


def place(sentence: str, surface: str, n: int = 1) -> int:
    """Where the n-th occurrence of a surface starts in a sentence."""
    at = -1
    for _ in range(n):
        at = sentence.index(surface, at + 1)
    return at
