"""What texts say about an occurrence, over all documents with a planted paragraph; the prose around it says nothing of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, matching, resolve
from .base import literal, planted, planted_sql, query

CANDIDATES = [("flow", "승인 처리 절차", "결재 문서를 차례로 승인하는 업무 절차"), ("net", "네트워크 액세스 포인트", "무선 단말을 유선망에 잇는 중계 장치")]
#: Sentence, veto, what it is defined as, why nothing is, supporting passages, and whether the selection is allowed.
CASES = [
    ("AP는 승인 처리 절차이다.", None, "flow", None, 0),
    ("그는 \"AP 장애\"라고 말했다.", "QUOTED_ASSERTION", None, "NO_EXPLICIT_REGISTERED_DEFINITION", 0),
    ("그는 “AP 장애를 접수했다.", "UNCERTAIN_QUOTATION", None, "NO_EXPLICIT_REGISTERED_DEFINITION", 0),
    ("AP팀장이 왔다.", "DISTINCT_ROLE_SURFACE", None, "UNSUPPORTED_OR_NEGATED_CONTEXT", 0),
    ("AP로 보내지 않는다.", "NEGATED_OR_REJECTED_TARGET", None, "UNSUPPORTED_OR_NEGATED_CONTEXT", 0),
    ("영화 AP의 포스터를 붙였다.", "EXPLICIT_UNREGISTERED_OBJECT", None, "NO_EXPLICIT_REGISTERED_DEFINITION", 0),
    ("AP를 접수했다. 어느 부서인지 알 수 없다.", "EXPLICITLY_UNRESOLVED_TARGET", None, "NO_EXPLICIT_REGISTERED_DEFINITION", 0),
    ("AP를 접수했다.\n\n결재 문서를 차례로 승인한다.\n\n이 주장은 철회한다.", "SCOPED_RETRACTION_OR_UNREGISTERED", None, "NO_EXPLICIT_REGISTERED_DEFINITION", 1),
    ("AP(네트워크 액세스 포인트)\n\n무선 단말과 장치\n\n유선망\n\n날씨", None, "net", None, 2),
    ("AP 장애 접수\n\n# 다른 절\n\n이 주장은 철회한다.", None, None, "NO_EXPLICIT_REGISTERED_DEFINITION", 0),
]
HEAD = "# 덧붙임\n\n"
SENTENCES = [HEAD + c[0] for c in CASES]
_OF = planted_sql(SENTENCES)


def _expected(rows: list[tuple], *names: str) -> str:
    return f"SELECT doc_id, {', '.join(names)} FROM {_OF} d JOIN {literal(rows, 'k', *names)} USING (k)"


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bounded occurrence of the surface that two entities share, with both as candidates."""
    docs = planted(spark, sf_dir, SENTENCES)
    found = matching.literal_matches(docs, spark.createDataFrame([(1, "AP")], "item_id int, surface string"))
    both = F.array(*[F.struct(F.lit(e).alias("entity_id"), F.lit(c).alias("canonical"), F.lit(d).alias("definition"), F.array(F.lit("AP")).alias("aliases")) for e, c, d in CANDIDATES])
    return matching.with_boundaries(found).where("bounded").select("doc_id", "text", "start", "end", both.alias("candidates"))


@query("f14_vetoes", _expected([(k, c[1]) for k, c in enumerate(CASES)], "veto"))
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the text around an occurrence does not assert it: each reason of its own paragraph, or of the section's."""
    return evidence.vetoes(_occurrences(spark, sf_dir)).select("doc_id", "veto")


@query("f15_self_definitions", _expected([(k, c[2], c[3]) for k, c in enumerate(CASES)], "chosen", "abstained"))
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that the text itself defines an occurrence as, or why none."""
    return evidence.self_definitions(_occurrences(spark, sf_dir)).select("doc_id", "chosen", "abstained")


@query("t11_evidence_passages", _expected([(k, 1 + c[4], c[1]) for k, c in enumerate(CASES)], "passages", "refused"))
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph of an occurrence and at most two of its section that speak of what is registered, whole or not at all."""
    return evidence.selected(_occurrences(spark, sf_dir)).select("doc_id", F.size("passages").alias("passages"), "refused")


@query("r08_contextual", _expected([(k, "RESOLVED" if c[2] else "AMBIGUOUS", c[2]) for k, c in enumerate(CASES)], "link", "entity_id"))
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole resolver over all documents where self-definitions settle exact collisions; nothing else about them changes."""
    bindings = spark.createDataFrame([(1, "net", "AP", "latin_acronym"), (2, "flow", "AP", "latin_acronym")], "item_id int, entity_id string, surface string, profile string")
    entities = spark.createDataFrame(CANDIDATES, "entity_id string, canonical string, definition string")
    out = resolve.resolved(planted(spark, sf_dir, SENTENCES), bindings, entities=entities.select("entity_id", "canonical", "definition"), contextual=True)
    return out.where("surface = 'AP'").select("doc_id", F.col("link_decision").alias("link"), "entity_id")
