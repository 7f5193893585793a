"""Sources and sinks: what is written is read back, so the results are the tables themselves."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glossary
from ..sources import corpora, glossaries
from .base import literal, query, table

TERMS = [{"key": "kepco", "canonical": "한국전력공사", "surfaces": ["한전", "KEPCO"], "scope": "base"}, {"key": "qms", "canonical": "Quality: System", "surfaces": [], "scope": "project"}, {"key": "ap", "canonical": "AP"}]
_TERMS = literal([(t["key"], t["canonical"], ",".join(t.get("surfaces", []))) for t in TERMS], "key", "canonical", "surfaces")


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names, or a local one where none is named, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lexweave-")
    return f"{root}/lexweave/{next(tempfile._get_candidate_names())}"


def _flat(terms: DataFrame) -> DataFrame:
    return terms.select("key", "canonical", F.array_join("surfaces", ",").alias("surfaces"))


@query("s01_yaml_glossary", f"SELECT * FROM {_TERMS}")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authored YAML file and the same terms as dicts give one glossary."""
    lines = ["terms:"] + [f"  - {json.dumps(t, ensure_ascii=False)}" for t in TERMS]
    folder = _folder(spark)
    glossaries._put(spark, f"{folder}/terms.yaml", "\n".join(lines))
    read, made = glossaries.read_terms(spark, f"{folder}/terms.yaml"), glossaries.from_rows(spark, TERMS)
    return _flat(read.intersect(made))


@query("s02_suffixes", "SELECT r_name AS key, count(*) AS names, 'tsv' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name, count(*), 'csv' FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name, count(*), 'json' FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One glossary as a comma- and a tab-separated table with a byte order mark and as JSON lines, read by suffix."""
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select(F.col("r_name").alias("id"), F.concat(F.lit("the "), "r_name").alias("canonical"), F.col("n_name").alias("alias")).orderBy("id", "alias").collect()
    folder, out = _folder(spark), None
    for kind, sep in glossaries.TABLES.items():
        glossaries._put(spark, f"{folder}/terms.{kind}", "﻿" + "\n".join(sep.join(r) for r in [("id", "canonical", "alias"), *rows]))
        part = glossaries.read_terms(spark, f"{folder}/terms.{kind}")
        if out is None:
            lines = [r["value"] for r in glossaries.serialized(part).collect()]
            glossaries._put(spark, f"{folder}/terms.json", "[" + ",".join(lines) + "]")
            out = glossaries.read_terms(spark, f"{folder}/terms.json").withColumn("kind", F.lit("json"))
        out = out.unionByName(part.withColumn("kind", F.lit(kind)))
    return out.select("key", F.size("surfaces").cast("bigint").alias("names"), "kind")


@query("s07_layered_snapshot", "SELECT scope, terms, trusted FROM " + literal([("base", 1, True), ("project", 0, False), ("session", 1, True)], "scope", "terms", "trusted"))
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers compiled into a bundle whose manifest names them."""
    terms = spark.createDataFrame([("base", "AP", "e1"), ("project", "QMS", "e2"), ("session", "AP", "e3")], "scope string, surface string, entity_id string")
    kept, report = glossary.trusted_layers(terms, ("base", "session"))
    won, _ = glossary.layered(kept, F.col("scope"), F.col("surface"))
    folder = _folder(spark)
    manifest = glossaries.save(spark, folder, {"bindings": won}, {"layers": glossaries.layered_manifest(report, "")["layers"]})
    told = glossaries.load(spark, folder)[1]["facts"]["layers"]
    assert manifest["snapshot_id"] == glossaries.load(spark, folder)[1]["snapshot_id"]
    return spark.createDataFrame([(x["scope"], x["terms"], x["trusted"]) for x in told], "scope string, terms bigint, trusted boolean")


@query("s11_bundles", "SELECT n_nationkey, n_name FROM nation")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sealed bundle, read back after its hashes are compared."""
    folder = _folder(spark)
    glossaries.save(spark, folder, {"names": table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "regions": table(spark, sf_dir, "region")})
    return glossaries.load(spark, folder)[0]["names"]


@query("s12_broken_bundles", "SELECT * FROM " + literal([("added", "refused"), ("intact", "read"), ("unsealed", "refused")], "what", "outcome"))
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle with a row more than was sealed and one without a manifest are refused."""
    names, out = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), []
    for what in ("added", "intact", "unsealed"):
        folder = _folder(spark)
        if what == "unsealed":
            names.write.parquet(f"{folder}/names")
        else:
            glossaries.save(spark, folder, {"names": names})
        if what == "added":
            names.limit(1).write.mode("append").parquet(f"{folder}/names")
        try:
            glossaries.load(spark, folder)
            out.append((what, "read"))
        except glossaries.SourceError:
            out.append((what, "refused"))
    return spark.createDataFrame(out, "what string, outcome string")


@query("s25_opened", f"SELECT * FROM {_TERMS}")
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle is known by its manifest, any other path by its suffix."""
    folder = _folder(spark)
    glossaries.save(spark, folder, {"terms": glossaries.from_rows(spark, TERMS)})
    return _flat(glossaries.open_terms(spark, folder))


@query("s24_appended_lines", "SELECT r_regionkey, r_name FROM region")
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in a folder of their own; a second write to it is refused."""
    rows, folder = table(spark, sf_dir, "region").select("r_regionkey", "r_name"), _folder(spark)
    path = glossaries.append_lines(rows, folder, "first")
    try:
        glossaries.append_lines(rows, folder, "first")
        raise AssertionError("written over")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return spark.read.schema(rows.schema).json(path)


TAGGED = [(1, "한전 은  서울 에", "ORG-B ORG-I O LOC-B"), (2, "a b", "O"), (3, "a b", "X O"), (4, "a b", "O ORG-I"), (5, "", ""), (6, "a b c", "ORG-B LOC-B LOC-I"), (7, "a b", "ORG-B LOC-I")]


@query("s18_token_tags", "SELECT id, start::INT AS start, \"end\"::INT AS \"end\", kind, what FROM " + literal([(1, 0, 4, "ORG", "한전 은"), (1, 9, 10, "LOC", "에"), (6, 0, 1, "ORG", "a"), (6, 2, 5, "LOC", "b c"), (2, None, None, "refused", "token_tag_length_mismatch"), (3, None, None, "refused", "invalid_bio_tag"), (4, None, None, "refused", "invalid_bio_continuation"), (5, None, None, "refused", "empty_sentence"), (7, None, None, "refused", "invalid_bio_continuation")], "id", "start", '"end"', "kind", "what"))
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, refused = corpora.token_tag_spans(spark.createDataFrame(TAGGED, "id int, text string, tags string"))
    none = F.lit(None).cast("int")
    return spans.select("id", "start", "end", F.col("type").alias("kind"), F.col("surface").alias("what")).union(refused.select("id", none, none, F.lit("refused"), "reason"))


MASKED = [("1", "혼밥", "혼자 + 밥", "[MASK]을 먹는 [MASK]족", "축약"), ("2", "갓생", "갓+생", "usage", "혼성"), ("3", "x", "x", "[MASK]", "파생"), ("4", "", "a", "[MASK]", "축약"), ("5", "y", " + ", "[MASK]", "축약")]


@query("s19_masked_usages", "SELECT * FROM " + literal([("1", "혼밥을 먹는 혼밥족", "혼자|밥"), ("2", "usage", "갓|생")], "id", "text", "components"))
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(MASKED, "id string, term string, analysis string, usage string, formation string")
    return corpora.masked_usages(rows, ("축약", "혼성")).select("id", "text", F.array_join("components", "|").alias("components"))


@query("s13_single_files", f"SELECT * FROM {_TERMS}")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in one file, saved twice to equal bytes and read back."""
    folder, terms = _folder(spark), glossaries.from_rows(spark, TERMS)
    seals = {glossaries.save_file(spark, f"{folder}/{i}.snapshot", terms.repartition(i + 1)) for i in range(2)}
    assert len(seals) == 1
    return _flat(glossaries.load_file(spark, f"{folder}/1.snapshot"))


@query("s14_checked_files", "SELECT * FROM " + literal([("changed", "refused"), ("foreign", "refused"), ("future", "refused"), ("one", "read"), ("two", "read")], "what", "outcome"))
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions are read; a changed body, another head and a version to come are refused."""
    folder, terms, out = _folder(spark), glossaries.from_rows(spark, TERMS), []
    glossaries.save_file(spark, f"{folder}/one", terms, 1)
    glossaries.save_file(spark, f"{folder}/two", terms, 2)
    good = spark.read.text(f"{folder}/two", wholetext=True).first()["value"]
    for what, text in (("changed", good.replace("KEPCO", "KEPC0")), ("foreign", "x" + good), ("future", good.replace(f"{glossaries.HEAD} 2", f"{glossaries.HEAD} 3"))):
        glossaries._put(spark, f"{folder}/{what}", text)
    for what in ("changed", "foreign", "future", "one", "two"):
        try:
            out.append((what, "read" if glossaries.load_file(spark, f"{folder}/{what}").count() == len(TERMS) else "short"))
        except glossaries.SourceError:
            out.append((what, "refused"))
    return spark.createDataFrame(out, "what string, outcome string")
