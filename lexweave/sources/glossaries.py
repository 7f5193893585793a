"""Glossaries and their snapshots as files: authoring formats in, sealed bundles out and back in.

A glossary is a dict of entities and bindings; in Spark it is two tables. A bundle is a folder of Parquet tables and a
manifest that holds a hash of each table's rows, which a reader works out anew and compares; the manifest comes last and
by a rename, so a folder without one is no bundle. Paths are Hadoop's: any file system that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "lexweave-bundle-1"
TERM_SCHEMA = "key string, canonical string, surfaces array<string>, scope string"
#: Separators of tables by suffix.
TABLES = {"csv": ",", "tsv": "\t"}


class SourceError(ValueError):
    """A file that is not what it should be; the message says what is wrong with it."""


def from_rows(spark: SparkSession, terms: Iterable[dict]) -> DataFrame:
    """Terms (key, canonical, surfaces, scope) from dicts; unknown fields, missing names and repeated keys are errors."""
    rows, seen = [], set()
    for i, t in enumerate(terms):
        if not isinstance(t, dict) or set(t) - {"key", "canonical", "surfaces", "scope"}:
            raise SourceError(f"term {i} is no term or has unknown fields")
        if not t.get("key") or not t.get("canonical") or t["key"] in seen:
            raise SourceError(f"term {i} has no key, no canonical name or the key of another one")
        seen.add(t["key"])
        rows.append((str(t["key"]), str(t["canonical"]), [str(s) for s in t.get("surfaces") or []], t.get("scope")))
    return spark.createDataFrame(rows, TERM_SCHEMA)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a file by its suffix: json (an array or lines), yaml or yml, csv or tsv (id, canonical, alias: a row an alias).

    Tables may begin with a byte order mark; rows of one id that disagree on the name are an error.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in TABLES:
        rows = spark.read.csv(path, header=True, sep=TABLES[kind], mode="FAILFAST", encoding="UTF-8", multiLine=True)
        rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
        if missing := {"id", "canonical", "alias"} - set(rows.columns):
            raise SourceError(f"{path} lacks the columns {sorted(missing)}")
        one = rows.groupBy("id").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical"), F.array_sort(F.collect_set("alias")).alias("surfaces"))
        if bad := one.where("n != 1 or id is null").select("id").limit(5).collect():
            raise SourceError(f"{path}: no name, or several, for {[r['id'] for r in bad]}")
        return one.select(F.col("id").alias("key"), "canonical", "surfaces", F.lit(None).cast("string").alias("scope"))
    if kind == "json":
        return spark.read.json(path, schema=TERM_SCHEMA, multiLine=True, mode="FAILFAST")
    if kind in ("yaml", "yml"):
        import yaml

        try:
            doc = yaml.safe_load("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one authored file
        except yaml.YAMLError as e:
            raise SourceError(f"{path} is no YAML: {e}") from e
        return from_rows(spark, (doc or {}).get("terms") or [])
    raise SourceError(f"{path}: the suffix {kind} names no format")


def serialized(terms: DataFrame) -> DataFrame:
    """A JSON object for each term, as read_terms() reads it."""
    return terms.select(F.to_json(F.struct("key", "canonical", "surfaces", "scope")).alias("value"))


def seal(table: DataFrame) -> Column:
    """An aggregate over all rows of a table that any change of a row changes, whatever their order."""
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.sum(F.xxhash64(*table.columns, F.lit(k)).cast("decimal(38,0)")).cast("string") for k in range(2)]), 256)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and renames it; an existing one is an error."""
    fs, where = _fs(spark, path)
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(held, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(held, where):
        fs.delete(held, False)
        raise SourceError(f"{path} exists")


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], facts: dict | None = None) -> dict:
    """Writes a sealed bundle to a new folder and returns its manifest; its id is a hash of the tables' seals."""
    fs, where = _fs(spark, folder)
    if fs.exists(where):
        raise SourceError(f"{folder} exists")
    seals = {}
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
        back = spark.read.schema(table.schema).parquet(f"{folder}/{name}")
        seals[name] = back.agg(seal(back)).first()[0]
    spark_id = spark.createDataFrame([(json.dumps(seals, sort_keys=True),)], "s string").select(F.substring(F.sha2("s", 256), 1, 32)).first()[0]
    manifest = {"format": FORMAT, "snapshot_id": spark_id, "tables": {n: {"seal": s, "schema": tables[n].schema.json()} for n, s in seals.items()}, "facts": facts or {}}
    _put(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True, ensure_ascii=False))
    return manifest


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest of a bundle; a missing manifest, another format or a table whose seal differs is an error."""
    from pyspark.sql.types import StructType

    fs, where = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(where):
        raise SourceError(f"{folder} has no manifest")
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()["value"])
    except ValueError as e:
        raise SourceError(f"{folder}: the manifest is no JSON") from e
    if manifest.get("format") != FORMAT:
        raise SourceError(f"{folder} has the format {manifest.get('format')}")
    tables = {}
    for name, told in manifest["tables"].items():
        table = spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).parquet(f"{folder}/{name}")
        if table.agg(seal(table)).first()[0] != told["seal"]:
            raise SourceError(f"{folder}/{name} is not what was sealed")
        tables[name] = table
    return tables, manifest


def open_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a bundle where the path is a folder with a manifest, of an authored file otherwise."""
    fs, where = _fs(spark, f"{path}/manifest.json")
    return load(spark, path)[0]["terms"] if fs.exists(where) else read_terms(spark, path)


def append_lines(rows: DataFrame, folder: str, name: str) -> str:
    """Writes JSON lines to a new folder below ``folder``; what exists is never written over."""
    path = f"{folder}/{name}"
    rows.write.mode("errorifexists").json(path)
    return path


def layered_manifest(report: DataFrame, snapshot_id: str) -> dict:
    """What a compiled set of layers says of itself: its layers, their terms, and which were not trusted."""
    layers = [r.asDict() for r in report.orderBy("scope").collect()]  # five scopes at most
    return {"snapshot_id": snapshot_id, "layers": layers}


# ---------------------------------------------------------------- single-file snapshots

HEAD = "LEXWEAVE-SNAPSHOT"
VERSIONS = (1, 2)


def save_file(spark: SparkSession, path: str, terms: DataFrame, version: int = 2) -> str:
    """Writes terms as one file and returns its hash: a line with format, version and SHA-256 of the rest, then JSON.

    The terms of one glossary are an authored file's worth; larger ones are bundles. Rows are ordered by key, so equal
    terms give equal files. Version 1 knows no scopes.
    """
    if version not in VERSIONS:
        raise SourceError(f"no version {version}")
    rows = [r.asDict() for r in terms.orderBy("key").collect()]
    body = json.dumps([{k: v for k, v in r.items() if v is not None and (k != "scope" or version > 1)} for r in rows], ensure_ascii=False, sort_keys=True)
    seal_ = hashlib.sha256(body.encode()).hexdigest()
    _put(spark, path, f"{HEAD} {version} {seal_}\n{body}")
    return seal_


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a single-file snapshot; another head, an unknown version, a wrong hash or a malformed term is an error."""
    head, _, body = spark.read.text(path, wholetext=True).first()["value"].partition("\n")
    parts = head.split(" ")
    if len(parts) != 3 or parts[0] != HEAD or parts[1] not in map(str, VERSIONS):
        raise SourceError(f"{path} is no snapshot of a known version")
    if hashlib.sha256(body.encode()).hexdigest() != parts[2]:
        raise SourceError(f"{path} is not what was saved")
    rows = json.loads(body)
    if not isinstance(rows, list) or (parts[1] == "1" and any("scope" in r for r in rows)):
        raise SourceError(f"{path}: the body is no list of terms of version {parts[1]}")
    return from_rows(spark, rows)
