"""Short forms that documents define for themselves, over all documents with a planted paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, local_definitions, matching, resolve
from .base import literal, place, planted, planted_sql, query

BINDINGS = [
    (1, "kepco", "한국전력공사", "korean_org_name"), (3, "net_ap", "AP", "latin_acronym"), (4, "flow_ap", "AP", "latin_acronym"), (5, "fss", "금융감독원", "korean_org_name"), (6, "keri", "한국전기연구원", "korean_org_name"),
]
SENTENCES = [
    "한국전력공사(이하 한전공)는 발표했다. 한전공은 회의를 열었고 한전공에서 알렸다.",
    "KERI(한국전기연구원)는 시험했다. KERI 결과와 KERI2.",
    "금융감독원, 이하 감독원. 감독원은 조사했다. 새감독원은 아니다.",
    "무명회사(무명)는 없다. 무명은 없다.",
    "금융감독원(이하 AP) 발표. AP 점검.",
    "국전(한국전력공사)과 국전에서, 국전적인 것.",
]
S = SENTENCES
_OF = planted_sql(SENTENCES)


def _rows(rows: list[tuple], *names: str) -> str:
    """Literal rows of sentences at the places in the documents that hold them; places are start and end."""
    picked = ", ".join(f"base + {n} AS {n}" if n in ("start", "end_") else n for n in names)
    return f"SELECT doc_id, {picked} FROM {_OF} d JOIN {literal(rows, 'k', *names)} USING (k)"


def _given(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BINDINGS, "item_id int, entity_id string, surface string, profile string")


@query("j08_local_aliases", _rows([
    (0, "한전공", "한국전력공사", "kepco", 0), (1, "KERI", "한국전기연구원", "keri", 0), (2, "감독원", "금융감독원", "fss", 0), (4, "AP", "금융감독원", "fss", 0), (5, "국전", "한국전력공사", "kepco", 0),
], "alias", "long_form", "entity_id", "start"))
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of all documents; unknown long forms define nothing."""
    found = local_definitions.definitions(planted(spark, sf_dir, SENTENCES), _given(spark))
    return found.select("row.doc_id", "alias", "long_form", "entity_id", "start")


@query("j08_local_occurrences", _rows([
    (0, "한전공", "kepco", place(S[0], "한전공", 2)), (0, "한전공", "kepco", place(S[0], "한전공", 3)), (1, "KERI", "keri", place(S[1], "KERI", 2)), (2, "감독원", "fss", place(S[2], "감독원", 3)), (4, "AP", "fss", place(S[4], "AP", 2)),
    (5, "국전", "kepco", place(S[5], "국전", 3)), (5, "국전", "kepco", place(S[5], "국전", 4)),
], "alias", "entity_id", "start"))
def j08_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents use their short forms outside the definition; longer words that begin before one are none."""
    docs = planted(spark, sf_dir, SENTENCES)
    found = local_definitions.occurrences(docs, local_definitions.definitions(docs, _given(spark)))
    return found.select("row.doc_id", "alias", "entity_id", "start")


def _mentions(docs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bounded exact matches as mentions, a row for each entity; sure where there is one alone."""
    from pyspark.sql import Window

    found = resolve.proposals(docs.select(matching.row_of().alias("doc_id"), "text"), bindings).select(F.col("doc_id").alias("row"), local_definitions.beside(F.col("text"), F.col("start"), F.col("end")).alias("beside"), "start", "end", "full_end", "entity_id").distinct()
    return found.withColumn("sure", F.count(F.lit(1)).over(Window.partitionBy("row", "start", "end")) == 1)


@query("j09_local_words", _rows([
    (0, "한전공", "kepco", True, place(S[0], "한전공", 2)), (0, "한전공", "kepco", True, place(S[0], "한전공", 3)), (2, "감독원", "fss", True, place(S[2], "감독원", 3)), (1, "keri", "keri", True, place(S[1], "KERI", 2)),
    (5, "국전", "kepco", True, place(S[5], "국전", 3)),
], "alias", "entity_id", "sure", "start"))
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a document, bare or with particles, that a definition beside a mention makes a name; words of mentions stay theirs."""
    docs = planted(spark, sf_dir, SENTENCES)
    mentions = components.cut(_mentions(docs, _given(spark)))
    local = components.cut(local_definitions.defined_by_mentions(mentions))
    taken = mentions.select("row", "start", F.col("full_end").alias("end"))
    return local_definitions.word_occurrences(docs, local, taken).select("row.doc_id", "alias", "entity_id", "sure", "start")


@query("q02_local_mentions", _rows([
    (0, "한국전력공사", "TERM", "RESOLVED", "kepco", place(S[0], "한국전력공사")), (0, "한전공", "TERM", "AMBIGUOUS", None, place(S[0], "한전공")), (0, "한전공", "TERM", "RESOLVED", "kepco", place(S[0], "한전공", 2)), (0, "한전공", "TERM", "RESOLVED", "kepco", place(S[0], "한전공", 3)),
    (1, "한국전기연구원", "TERM", "RESOLVED", "keri", place(S[1], "한국전기연구원")), (1, "KERI", "TERM", "RESOLVED", "keri", place(S[1], "KERI", 2)),
    (2, "금융감독원", "TERM", "RESOLVED", "fss", 0), (2, "감독원", "TERM", "RESOLVED", "fss", place(S[2], "감독원", 2)), (2, "감독원", "TERM", "RESOLVED", "fss", place(S[2], "감독원", 3)), (4, "금융감독원", "TERM", "RESOLVED", "fss", 0), (4, "AP", "TERM", "AMBIGUOUS", None, place(S[4], "AP", 1)), (4, "AP", "TERM", "RESOLVED", "fss", place(S[4], "AP", 2)),
    (5, "한국전력공사", "TERM", "RESOLVED", "kepco", place(S[5], "한국전력공사")), (5, "국전", "TERM", "RESOLVED", "kepco", place(S[5], "국전", 3)), (5, "국전", "TERM", "RESOLVED", "kepco", place(S[5], "국전", 4)),
], "surface", "mention", "link", "entity_id", "start"))
def q02_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over all documents: terms of the planted paragraphs and what they link to, short forms by what their own document says."""
    given = _given(spark).where("surface != '한전'")
    out = resolve.resolved(planted(spark, sf_dir, SENTENCES), given).where("mention_decision = 'TERM'")
    return out.select("doc_id", "surface", F.col("mention_decision").alias("mention"), F.col("link_decision").alias("link"), "entity_id", "start")
