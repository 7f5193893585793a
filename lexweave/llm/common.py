"""What the operators share: scratch tables in the shared folder, range shards, committed files."""

from __future__ import annotations

import ctypes
import functools
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that the deterministic sample behind range bounds holds on average.
SAMPLE_KEYS = 20_000


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where none is set, and only where all tasks are local.

    A path without a scheme stays as it is: Hadoop's default file system resolves it, on the driver and in tasks alike.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="lexweave-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root, qualified by its file system; it is unique, so runs never meet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/lexweave/{name}-{uuid.uuid4().hex}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexweave_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_lexweave_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def parts_of(docs: DataFrame, column: str, target: int) -> int:
    """How many parts of about ``target`` bytes the column makes, 8 at least."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(8, -(-total // target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker remembers between tasks: a memory and the modules whose kernels use it.
_memories: list[tuple[dict, frozenset[str]]] = []


def remembered(memory: dict, *modules: str) -> dict:
    """Registers a worker's memory; kernels of other modules than those named (of this package) empty it."""
    _memories.append((memory, frozenset(f"{__package__}.{m}" for m in modules)))
    return memory


def settle(module: str) -> None:
    """Empties the memories that kernels of other modules fill; a function of its own, as closures carry copies of what they name."""
    for memory, users in _memories:
        if module not in users:
            memory.clear()
    give_back()


def give_back() -> None:
    """Returns what Arrow and the allocator hold of freed memory to the system, where the allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def settled(kernel: Callable, module: str | None = None) -> Callable:
    """Wraps a generator over batches: it starts without the memories of other operators and leaves no freed memory behind.

    Workers go from stage to stage and from operator to operator; without this what one left adds to the next one's peak.
    """
    own = module or kernel.__module__

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(own)
        yield from kernel(batches)
        give_back()

    return run


#: Bytes of a batch that a kernel gets at once, where a row alone has not more.
BATCH_BYTES = 8 << 20


def by_batch(kernel: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1000) -> Callable:
    """Wraps a kernel over at most ``rows`` rows and, but for single rows, BATCH_BYTES of an Arrow batch for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows)
                while part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                    part = part.slice(0, max(1, part.num_rows // 2))
                at += part.num_rows
                yield kernel(part)

    return settled(run, kernel.__module__)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of the texts of a batch; null is empty."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def folded_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; bytes.split cuts at just those characters."""
    return text.lower().split()


# ---------------------------------------------------------------- range shards


def range_bounds(df: DataFrame, key: str, weight: Column, target: int, most: int) -> tuple[list[int], int]:
    """Upper-exclusive bounds that cut a bigint key into shards of about ``target`` weight, ``most`` shards at most.

    The bounds hang on the rows alone, never on partitions or their order: the sample takes each key whose hash
    is under a threshold set by the row count, about SAMPLE_KEYS rows at any input size, weighted by size.
    """
    rows = df.count()
    keep = min(1.0, SAMPLE_KEYS / max(rows, 1))
    sample = df.select(F.col(key).alias("k"), weight.cast("long").alias("w"))
    if keep < 1:
        sample = sample.where(F.pmod(F.xxhash64(F.col("k"), F.lit(11)), F.lit(1 << 30)) < int(keep * (1 << 30)))
    got = sample.groupBy("k").agg(F.sum("w").alias("w")).where("k is not null").toPandas().sort_values("k")
    total = int(got["w"].sum() / keep) if len(got) else 0
    shards = int(min(most, max(1, -(-total // max(target, 1)))))
    if shards == 1:
        return [], total
    cum = got["w"].to_numpy(dtype=float).cumsum()
    at = np.searchsorted(cum, cum[-1] * np.arange(1, shards) / shards)
    return sorted({int(x) for x in got["k"].to_numpy()[np.minimum(at, len(got) - 1)]}), total


def shard_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above the key; null keys go to shard 0."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 50 else None
    if cuts is not None:
        return F.coalesce(F.size(F.filter(cuts, lambda b: b <= key)), F.lit(0))
    held = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def find(k):  # noqa: ANN001, ANN202
        gone = k.isna().to_numpy()
        out = np.searchsorted(held, k.fillna(0).to_numpy(dtype=np.int64), side="right").astype(np.int32)
        out[gone] = 0
        return __import__("pandas").Series(out)

    return find(key)


# ---------------------------------------------------------------- committed files


def opened(uri: str):  # noqa: ANN201
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def start_commit(folder: str) -> None:
    files, path = opened(folder)
    files.create_dir(f"{path}/_temporary", recursive=True)


def temporary_name(folder: str, name: str) -> str:
    """A name that no other attempt of the task uses: lost, repeated and speculative attempts never meet."""
    return f"{folder}/_temporary/{uuid.uuid4().hex}-{name}"


def commit_files(folder: str, entries: list[dict], facts: dict) -> list[dict]:
    """Renames the files of the attempts that won, then publishes manifest.json by a rename of its own.

    entries: name, temporary and facts of each file. A reader that finds no manifest finds no archive.
    """
    files, path = opened(folder)
    for e in sorted(entries, key=lambda e: e["name"]):
        files.move(opened(e["temporary"])[1], f"{path}/{e['name']}")
    kept = [{k: v for k, v in e.items() if k != "temporary"} for e in sorted(entries, key=lambda e: e["name"])]
    with files.open_output_stream(held := opened(temporary_name(folder, "manifest.json"))[1]) as out:
        out.write(json.dumps({**facts, "files": kept}, sort_keys=True).encode())
    files.move(held, f"{path}/manifest.json")
    files.delete_dir(f"{path}/_temporary")
    return kept


def read_manifest(folder: str) -> dict:
    files, path = opened(folder)
    with files.open_input_stream(f"{path}/manifest.json") as src:
        return json.loads(src.read())
