"""Glossary-shaped joins, rules, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import glossary, matching, retrieval
from .base import literal, query, table

TERMS = [("kepco", "한국전력공사", ["한전", "KEPCO", "한국전력공사"]), ("msit", "과학기술정보통신부", ["과기정통부"]), ("qms", "Quality Management System", ["QMS", "qms"]), ("bare", "AP", None), ("sk", "SK하이닉스", ["하닉", "하이닉스반도체"])]
BINDINGS = [("base", "AP", "e1"), ("global", "AP", "e2"), ("project", "QMS", "e3"), ("session", "AP", "e4"), ("base", "QMS", "e3"), ("document", "kdn", "e5"), ("base", "KDN", "e6")]
_B = literal(BINDINGS, "scope", "surface", "entity_id")
_RANK = "CASE scope WHEN 'base' THEN 1 WHEN 'global' THEN 2 WHEN 'project' THEN 3 WHEN 'session' THEN 4 ELSE 5 END"


@query("s03_table_entities", "SELECT n_regionkey AS id, min(upper(left(n_name, 1))) AS canonical, count(DISTINCT upper(left(n_name, 1))) AS names, string_agg(n_name, '|' ORDER BY n_name) AS aliases, count(DISTINCT upper(left(n_name, 1))) = 1 AS valid FROM nation GROUP BY 1")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.upper(F.left("n_name", F.lit(1))).alias("canonical"), F.col("n_name").alias("alias"))
    return glossary.table_entities(rows)


#: Bindings of TERMS: names as they are, acronyms and short Hangul forms are abbreviations, other surfaces aliases.
COMPILED = [
    ("kepco", 0, "한국전력공사", "name", "korean_org_name"), ("kepco", 1, "한전", "abbreviation", "korean_term"), ("kepco", 2, "KEPCO", "abbreviation", "latin_acronym"), ("msit", 0, "과학기술정보통신부", "name", "korean_org_name"), ("msit", 1, "과기정통부", "alias", "korean_org_name"),
    ("qms", 0, "Quality Management System", "name", "latin_word"), ("qms", 1, "QMS", "abbreviation", "latin_acronym"), ("qms", 2, "qms", "alias", "latin_word"), ("bare", 0, "AP", "name", "latin_acronym"), ("sk", 0, "SK하이닉스", "name", "mixed_alnum"), ("sk", 1, "하닉", "abbreviation", "korean_term"), ("sk", 2, "하이닉스반도체", "alias", "korean_term"),
]


@query("s04_compiled_terms", "SELECT entity_id, alias_no::INT AS alias_no, surface, kind, profile FROM " + literal(COMPILED, "entity_id", "alias_no", "surface", "kind", "profile"))
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.compiled_terms(spark.createDataFrame(TERMS, "key string, canonical string, surfaces array<string>"))


@query("s05_layered_glossary", f"SELECT scope, surface, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY {_RANK} DESC, entity_id) AS r FROM {_B}) x WHERE r = 1")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    won, _ = glossary.layered(spark.createDataFrame(BINDINGS, "scope string, surface string, entity_id string"), F.col("scope"), F.col("surface"))
    return won


@query("s05_shadowed", f"SELECT b.scope, b.surface, b.entity_id, w.entity_id AS winner FROM {_B.replace('AS t(', 'AS b(')} JOIN (SELECT surface, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY {_RANK} DESC, entity_id) AS r FROM {_B}) x WHERE r = 1) w USING (surface) WHERE b.entity_id <> w.entity_id")
def s05_shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lost = glossary.layered(spark.createDataFrame(BINDINGS, "scope string, surface string, entity_id string"), F.col("scope"), F.col("surface"))
    return lost


@query("s06_trusted_layers", f"SELECT scope, count(*) FILTER (trusted) AS terms, trusted, CASE WHEN NOT trusted THEN 'untrusted' END AS skipped FROM (SELECT *, scope IN ('base', 'global', 'session') AS trusted FROM {_B}) x GROUP BY scope, trusted")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each layer brings in: those of scopes that are not trusted are named and not read."""
    _, report = glossary.trusted_layers(spark.createDataFrame(BINDINGS, "scope string, surface string, entity_id string"), ("base", "global", "session"))
    return report


FOLDED = [("base", "ＡＰ", "e1"), ("project", "ap", "e2"), ("session", "Ap", "e2"), ("base", "카페", "e3"), ("global", "카페", "e4"), ("base", "É", "e5"), ("global", "é", "e6"), ("base", "QMS", "e7")]


@query("s08_folded_layers", "SELECT * FROM " + literal([("session", "Ap", "e2"), ("global", "카페", "e4"), ("base", "É", "e5"), ("global", "é", "e6"), ("base", "QMS", "e7")], "scope", "surface", "entity_id"))
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers meet on composed, width-folded and ASCII-case-folded surfaces; other scripts keep their case."""
    won, _ = glossary.layered(spark.createDataFrame(FOLDED, "scope string, surface string, entity_id string"), F.col("scope"), glossary.folded(F.col("surface")))
    return won


@query("s09_name_maps", "SELECT r_name, count(*) AS names, string_agg(n_nationkey || '=' || n_name, ';' ORDER BY n_nationkey) AS entries FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    held = both.groupBy("r_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return held.select("r_name", F.size("m").cast("bigint").alias("names"), F.array_join(entries, ";").alias("entries"))


@query("s10_serialized", "SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json FROM nation")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("json"))


LINES = [(1, '{"id": 1, "text": "AP 장애"}'), (2, '{"id": 2}'), (3, "not json"), (4, '{"id": 4, "text": ""}')]


@query("s15_jsonl_batch", f"SELECT line, CASE WHEN NOT json_valid(raw) THEN 'INVALID_JSON' WHEN json_extract_string(raw, '$.text') IS NULL THEN 'MISSING_TEXT' ELSE 'OK' END AS status, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.text') END AS text FROM {literal(LINES, 'line', 'raw')}")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line gives a record or an error; none stops the batch."""
    rows = spark.createDataFrame(LINES, "line int, raw string").withColumn("v", F.try_parse_json("raw"))
    text = F.try_variant_get("v", "$.text", "string")
    return rows.select("line", F.when(F.col("v").isNull(), "INVALID_JSON").when(text.isNull(), "MISSING_TEXT").otherwise("OK").alias("status"), text.alias("text"))


TAGS = [("s1", i, c, t) for i, (c, t) in enumerate(zip("한전은KDN과", "BIOBIIO"))] + [("s2", i, c, t) for i, (c, t) in enumerate(zip("AP서버", "BIBI"))]


@query("s17_bio_spans", f"""
SELECT sent, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end", string_agg(ch, '' ORDER BY pos) AS surface FROM (
  SELECT *, sum(CASE WHEN tag = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY sent ORDER BY pos) AS g FROM {literal(TAGS, 'sent', 'pos', 'ch', 'tag')}) x WHERE tag <> 'O' GROUP BY sent, g""")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a character-tagged corpus by islands."""
    rows = spark.createDataFrame(TAGS, "sent string, pos int, ch string, tag string")
    island = F.sum((F.col("tag") == "B").cast("int")).over(Window.partitionBy("sent").orderBy("pos"))
    spans = rows.withColumn("g", island).where("tag != 'O'").groupBy("sent", "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("cs"))
    return spans.select("sent", "start", "end", F.array_join(F.col("cs.ch"), "").alias("surface"))


BYTE_TEXTS = [(1, "가나 abc", 0), (1, "가나 abc", 1), (1, "가나 abc", 3), (1, "가나 abc", 6), (1, "가나 abc", 10), (1, "가나 abc", 11), (2, "é😀", 2), (2, "é😀", 4), (2, "é😀", 6), (3, "", 0), (3, "", 1), (1, "가나 abc", -1)]
POINTS = [0, None, 1, 2, 6, None, 1, None, 2, 0, None, None]


@query("s20_byte_offsets", "SELECT 'r' || i AS k, c::BIGINT AS codepoint FROM " + literal(list(enumerate(POINTS)), "i", "c") + " UNION ALL SELECT 'd' || doc_id, CASE WHEN b < strlen(text) AND regexp_matches(hex(encode(text)[b + 1:b + 1]), '^[89AB]') THEN NULL ELSE length(decode(CASE WHEN b < strlen(text) AND regexp_matches(hex(encode(text)[b + 1:b + 1]), '^[89AB]') THEN ''::BLOB ELSE encode(text)[1:b] END)) END FROM (SELECT doc_id, text, (strlen(text) // 2)::INT AS b FROM documents) x")
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of byte offsets, null inside characters: literal cases, and the middle of every document."""
    rows = spark.createDataFrame([(f"r{i}", *r[1:]) for i, r in enumerate(BYTE_TEXTS)], "k string, text string, b int")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id"), "text", F.floor(F.octet_length("text") / 2).cast("int"))
    return rows.union(docs).select("k", T.codepoint_of_byte(F.col("text"), F.col("b")).alias("codepoint"))


@query("s21_struct_arrays", "SELECT conv_id, unnest(t) AS turn, unnest(r) AS role FROM (SELECT conv_id, list(turn ORDER BY turn) AS t, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1) x")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s")).select("conv_id", F.col("s.turn").alias("turn"), F.col("s.role").alias("role"))
    return held.select("conv_id", F.inline(F.arrays_zip("turn", "role")))


RULES = [(1, ["hr"], None, "hr"), (2, ["hr"], None, None), (3, None, ["it"], "it"), (4, None, ["it"], None), (5, None, None, None), (6, ["hr"], ["hr"], "hr"), (7, ["hr"], None, "it")]


@query("f05_rule_status", f"SELECT id, CASE WHEN coalesce(len(deny), 0) = 0 THEN TRUE ELSE NOT list_contains(deny, v) END AND CASE WHEN coalesce(len(allow), 0) = 0 THEN TRUE ELSE list_contains(allow, v) END AS applies FROM {literal(RULES, 'id', 'allow', 'deny', 'v')}")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(RULES, "id int, allow array<string>, deny array<string>, v string")
    return rows.select("id", glossary.rule_status(F.col("allow"), F.col("deny"), F.col("v")).alias("applies"))


@query("f06_eligibility", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS eligible FROM orders GROUP BY 1")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("eligible"))


#: Rules: entity, allowed and denied departments and projects, first and last day. Departments are market segments and
#: projects order priorities of the given tables.
ENTITY_RULES = [("e1", ["BUILDING", "MACHINERY"], None, None, None, "1995-01-01", "2000-06-30"), ("e2", None, ["FURNITURE"], None, ["1-URGENT"], None, None), ("e4", None, None, None, None, "1999-01-01", None)]
BINDING_RULES = [
    ("F", "e1", None, None, ["1-URGENT", "2-HIGH"], None, None, None), ("F", "e1", None, None, None, ["2-HIGH"], None, "1999-12-31"), ("F", "e2", [], [], None, None, None, None),
    ("O", "e2", ["AUTOMOBILE", "HOUSEHOLD"], None, None, None, "1998-01-01", None), ("O", "e3", None, None, None, None, None, None), ("P", "e4", None, ["BUILDING"], None, None, None, None), ("P", "e4", ["MACHINERY"], None, None, None, None, None),
]
_RULE_NAMES = ("dep_allow", "dep_deny", "pro_allow", "pro_deny", "first_day", "last_day")
_RULE_TYPES = "dep_allow array<string>, dep_deny array<string>, pro_allow array<string>, pro_deny array<string>, first_day string, last_day string"
#: What is missing from a request: every eleventh has no department, every seventh no project, every fifth no date.
_REQUESTS = "SELECT o_orderkey, o_orderstatus AS surface, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS departments, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS projects, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS as_of FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


def _outcome_sql(r: str) -> str:
    """excluded, unknown or applies (2, 1, 0) of the columns of a rule r."""
    out, open_ = [], []
    for p, v in (("dep", "q.departments"), ("pro", "q.projects")):
        given, allow, deny = f"coalesce({v}, '') <> ''", f"coalesce({r}.{p}_allow, [])", f"coalesce({r}.{p}_deny, [])"
        out.append(f"({given} AND (list_contains({deny}, {v}) OR (len({allow}) > 0 AND NOT list_contains({allow}, {v}))))")
        open_.append(f"(NOT ({given}) AND len({allow}) + len({deny}) > 0)")
    out.append(f"(as_of IS NOT NULL AND (as_of < coalesce({r}.first_day, '0001-01-01')::DATE OR as_of > coalesce({r}.last_day, '9999-12-31')::DATE))")
    open_.append(f"(as_of IS NULL AND ({r}.first_day IS NOT NULL OR {r}.last_day IS NOT NULL))")
    return f"CASE WHEN {' OR '.join(out)} THEN 2 WHEN {' OR '.join(open_)} THEN 1 ELSE 0 END"


_ELIGIBLE = f"""
(SELECT q.o_orderkey, q.surface, b.entity_id, max(CASE WHEN e.entity_id IS NULL THEN 0 ELSE {_outcome_sql('e')} END) AS own, min({_outcome_sql('b')}) AS of
FROM ({_REQUESTS}) q JOIN {literal(BINDING_RULES, 'name', 'entity_id', *_RULE_NAMES).replace('AS t(', 'AS b(')} ON b.name = q.surface LEFT JOIN {literal(ENTITY_RULES, 'entity_id', *_RULE_NAMES).replace('AS t(', 'AS e(')} ON e.entity_id = b.entity_id
GROUP BY ALL HAVING own < 2 AND of < 2)"""


def _ruled(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    made = spark.createDataFrame(rows, f"{names}, {_RULE_TYPES}")
    both = lambda policy: F.struct(F.col(f"dep_{policy}").alias("departments"), F.col(f"pro_{policy}").alias("projects")).alias(policy)
    rule = F.struct(both("allow"), both("deny"), F.col("first_day").cast("date").alias("valid_from"), F.col("last_day").cast("date").alias("valid_to"))
    return made.select(*[n.split()[0] for n in names.split(", ")], rule.alias("rule"))


def _eligible_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    requests = both.selectExpr(
        "o_orderkey", "o_orderstatus AS surface", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS departments", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS projects", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS as_of"
    )
    return glossary.eligibility(requests, _ruled(spark, BINDING_RULES, "surface string, entity_id string"), _ruled(spark, ENTITY_RULES, "entity_id string"))


@query("f06_eligible_entities", f"SELECT o_orderkey, surface, entity_id, own = 0 AND of = 0 AS eligible FROM {_ELIGIBLE} x")
def f06_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that rules leave to each order's surface by its department, project and day, and whether they are confirmed."""
    return _eligible_orders(spark, sf_dir).select("o_orderkey", "surface", "entity_id", "eligible")


@query("q03_linked_by_rules", f"""
SELECT o_orderkey, CASE WHEN n = 1 AND sure THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS decision, CASE WHEN n = 1 AND sure THEN 'unique_eligible_alias' WHEN n > 1 THEN 'shared_alias' ELSE 'eligibility_unconfirmed' END AS reason, CASE WHEN n = 1 AND sure THEN one END AS entity_id
FROM (SELECT o_orderkey, count(*) AS n, bool_and(own = 0 AND of = 0) AS sure, min(entity_id) AS one FROM {_ELIGIBLE} x GROUP BY 1) y""")
def q03_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the single-file resolver: one confirmed entity is resolved, all else is ambiguous, with the reason."""
    return glossary.links(_eligible_orders(spark, sf_dir), "o_orderkey")


@query("f11_validation", """
SELECT 'UNKNOWN_CUSTOMER' AS code, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'UNUSED_ENTITY', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'DUPLICATE_SURFACE', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) x UNION ALL
SELECT 'BAD_NAME', count(*) FROM part WHERE NOT regexp_matches(p_name, '^[a-z ]+$')""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, part = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))

    def coded(code: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")

    out = coded("UNKNOWN_CUSTOMER", orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left_anti"))
    out = out.union(coded("UNUSED_ENTITY", customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti")))
    out = out.union(coded("DUPLICATE_SURFACE", part.groupBy("p_name").count().where("count > 1")))
    return out.union(coded("BAD_NAME", part.where(~F.col("p_name").rlike("^[a-z ]+$"))))


@query("f20_label_conflicts", "SELECT text_hash, labels FROM (SELECT md5(text) AS text_hash, count(DISTINCT source) AS labels FROM documents GROUP BY 1) x WHERE labels > 1")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.count_distinct("source").alias("labels")).where("labels > 1")


@query("j03_binding_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    dims = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return s.join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j13_composition", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem l LEFT JOIN part ON p_partkey = l_partkey AND p_size = l_linenumber")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join on two keys: the target of a pair, if there is one."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    return l.join(p, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") == F.col("l_linenumber")), "left").select("l_orderkey", "l_linenumber", "p_name")


ANCHORS = [("d", 2, "A"), ("d", 9, "B"), ("d", 4, "C"), ("e", 1, "A")]
MENTIONS = [("d", 3, "m1"), ("d", 7, "m2"), ("d", 20, "m3"), ("e", 5, "m4")]


@query("j14_nearest_anchor", f"SELECT m, anchor FROM (SELECT m.m, a.anchor, rank() OVER (PARTITION BY m.m ORDER BY abs(m.s - a.s)) AS r FROM {literal(MENTIONS, 'doc', 's', 'm').replace('AS t(', 'AS m(')} JOIN {literal(ANCHORS, 'doc', 's', 'anchor').replace('AS t(', 'AS a(')} ON m.doc = a.doc AND abs(m.s - a.s) <= 4) x WHERE r = 1")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, a = spark.createDataFrame(MENTIONS, "doc string, s int, m string").alias("m"), spark.createDataFrame(ANCHORS, "doc string, s int, anchor string").alias("a")
    near = m.join(a, (F.col("m.doc") == F.col("a.doc")) & (F.abs(F.col("m.s") - F.col("a.s")) <= 4)).select("m", "anchor", F.abs(F.col("m.s") - F.col("a.s")).alias("d"))
    return near.withColumn("r", F.rank().over(Window.partitionBy("m").orderBy("d"))).where("r = 1").select("m", "anchor")


_DENSE = "SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS r FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"


@query("j19_hybrid", f"""
SELECT query_id, vec_id, pri FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pri, spot, vec_id) AS k FROM (
  SELECT query_id, vec_id, min(pri) AS pri, arg_min(spot, pri) AS spot FROM (
    SELECT query_id, vec_id, 0 AS pri, spot FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS spot FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0) l WHERE spot <= 7
    UNION ALL SELECT query_id, vec_id, 1, r FROM ({_DENSE}) d WHERE r <= 10) x GROUP BY 1, 2) y) z WHERE k <= 14""")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven hits by label before ten by vector, each vector once, 14 at most, for each of the stated queries."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    order = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    first = matching.best_first(v.select("vec_id", "label"), ["label"], [F.asc("vec_id")], 7)  # the same for all queries of a label
    labels = asked.select("query_id", "label").join(first, "label").select("query_id", "vec_id", F.lit(0).alias("pri"), order("vec_id").alias("at"))
    near = retrieval.vector_top(v, asked, 10).select("query_id", "vec_id", F.lit(1).alias("pri"), order(F.desc(F.round("score", 9)), "vec_id").alias("at"))
    one = labels.unionByName(near).groupBy("query_id", "vec_id").agg(F.min(F.struct("pri", "at")).alias("m"))
    return matching.best_first(one.select("query_id", "vec_id", "m.pri", "m.at"), ["query_id"], [F.asc("pri"), F.asc("at"), F.asc("vec_id")], 14).drop("at")


@query("j20_surface_lookup", "SELECT p_name AS surface, count(DISTINCT p_type) AS senses, count(DISTINCT p_type) > 1 AS ambiguous FROM part GROUP BY 1")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.ambiguous_surfaces(table(spark, sf_dir, "part").select(F.col("p_name").alias("surface"), F.col("p_type").alias("entity_id")))


@query("j21_snapshot_diff", """
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT p_partkey, p_name FROM part WHERE p_size < 40) a FULL JOIN (SELECT p_partkey, CASE WHEN p_size = 7 THEN p_brand ELSE p_name END AS p_name FROM part WHERE p_size > 5) b ON a.p_partkey = b.p_partkey
WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name""")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    new = p.where("p_size > 5").select("p_partkey", F.when(F.col("p_size") == 7, F.col("p_brand")).otherwise(F.col("p_name")).alias("p_name"))
    return glossary.difference(p.where("p_size < 40"), new, "p_partkey", ["p_name"])


@query("j23_flips", "SELECT a.l_linenumber AS pair, count(*) FILTER (a.l_discount < 0.05 AND b.l_discount >= 0.05) AS helpful, count(*) FILTER (a.l_discount >= 0.05 AND b.l_discount < 0.05) AS harmful FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's outcome under each condition and the next one: the next row of the case, without a join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list("l_discount").alias("d"))  # a line number may be repeated
    after = F.lead(F.struct("l_linenumber", "d")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    both = lines.select("l_linenumber", "d", after.alias("n")).where("n.l_linenumber = l_linenumber + 1")
    low, then = (F.size(F.filter(c, lambda x: x < 0.05)) for c in (F.col("d"), F.col("n.d")))
    high, after_high = F.size("d") - low, F.size("n.d") - then
    return both.groupBy(F.col("l_linenumber").alias("pair")).agg(F.sum(low * after_high).alias("helpful"), F.sum(high * then).alias("harmful"))


SURFACES = [("e1", "한국전력공사"), ("e2", "전력공사"), ("e3", "공사"), ("e4", "한전"), ("e5", "한전KDN"), ("e6", "KDN"), ("e7", "한국전력공사노조")]


@query("j24_containment", f"SELECT a.e AS inner_id, b.e AS outer_id FROM (SELECT * FROM {literal(SURFACES, 'e', 's')}) a, (SELECT * FROM {literal(SURFACES, 'e', 's')}) b WHERE a.e <> b.e AND contains(b.s, a.s)")
def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose surface another one's holds, by an equi-join on its first two characters and a check."""
    return matching.contained(spark.createDataFrame(SURFACES, "e string, s string"), "e", "s").select(F.col("inner").alias("inner_id"), F.col("outer").alias("outer_id"))


@query("w01_rank_margin", "SELECT o_custkey, o_orderkey, round(o_totalprice - nxt, 2) AS margin FROM (SELECT *, row_number() OVER w AS r, lead(o_totalprice) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) x WHERE r = 1")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r"), F.round(F.col("o_totalprice") - F.lead("o_totalprice").over(w), 2).alias("margin")).where("r = 1").drop("r")


@query("w03_first_seen", "SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order FROM lineitem GROUP BY 1")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order"))


@query("w04_principal_cap", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) x WHERE r <= 3")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_first(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.asc("event_id")], 3)


@query("w05_quota", "SELECT user_id, count(*) AS seen, sum(CASE WHEN r > 20 THEN 1 ELSE 0 END)::BIGINT AS refused FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) x GROUP BY 1")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("user_id", n.alias("r")).groupBy("user_id").agg(F.count("*").alias("seen"), F.count_if(F.col("r") > 20).alias("refused"))


@query("w06_latest_state", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("w08_nth_occurrence", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE role = 'user') x WHERE n = 2")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", n.alias("n")).where("n = 2").drop("n")


@query("w09_numbering", "SELECT conv_id, turn, 'm' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS mention_id FROM conversations")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("m"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("mention_id"))


@query("u01_union", "SELECT 'exact' AS channel, n_name AS name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'fuzzy', n_name FROM nation WHERE n_regionkey <= 1")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.where("n_regionkey = 0").select(F.lit("exact").alias("channel"), F.col("n_name").alias("name")).unionByName(n.where("n_regionkey <= 1").select(F.lit("fuzzy").alias("channel"), F.col("n_name").alias("name")))


@query("u02_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("u03_except", "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")).subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("u05_holdout", "SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.join(p.where("p_size = 1").select("p_brand").distinct(), "p_brand", "left_anti").select("p_partkey")


@query("u06_pruned_families", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("n_nationkey")
