"""Cleaning a corpus in five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of docs as they are, extra ones included. Repeated rows of documents are rows of their own until the second stage,
which keeps one row of each group of near duplicates (a row without words has no duplicates and stays).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import common, decontamination, parity_join, pii, rule_ensemble, streaming_viterbi
from lexweave.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the rule ensemble rejects; it is fitted on the labels of the documents given.

    The verdict is of a row's own text: rows that share a doc_id are judged apart.
    """
    told = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    scored = rule_ensemble.scored(told, common.table(spark, sf_dir, "labels"), ("doc_id", "__th"))
    rejected = common.cut(scored.where("predicted = 0").select(F.col("doc_id").alias("__doc_id"), F.col("__th").alias("__of")).distinct(), "rejected")
    names = F.broadcast(rejected) if rejected.count() <= parity_join.BROADCAST_ROWS else rejected
    return told.join(names, (F.col("__th") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that near-duplicate links connect, of the least doc_id; rows without words all stay."""
    return parity_join.firsts(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text by its kind; texts without any stay as they are."""
    return pii.redact(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit) and n_tokens."""
    return streaming_viterbi.encode(docs, vocabulary("piece_bpe_32k.model"), ("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("PII", mask_personal_data),
    ("SentencePiece encoding", to_pieces),
]

#: No SQL expresses the fitted stages; tests/llm holds the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of a folder; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs, f"stage-{i + 1}")
    return docs
