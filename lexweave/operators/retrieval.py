"""Lexical and vector ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import parts
from .matching import best_first


def terms(c: Column) -> Column:
    """Runs of letters and numbers, lower-cased: what lies between others, which takes a third of the time of seeking them."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def corpus_terms(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf, size (terms of the document)."""
    held = docs.select(key, terms(F.col("text")).alias("t")).withColumn("size", F.size("t"))
    return held.select(key, "size", F.explode("t").alias("term")).groupBy(key, "size", "term").agg(F.count("*").alias("tf"))


def _repeated(docs: DataFrame) -> DataFrame:
    """doc_id that several rows share, or that is null: their terms of equal size count as one document's."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__of"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query by BM25 over its distinct terms: query_id, doc_id, score, rank.

    One pass over the documents counts those that hold each term of the queries, one scores them where they lie: what is
    shuffled does not grow with the documents. Rows that share a doc_id are one document and meet by joins.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    wanted = F.broadcast(asked.select("term").union(asked.sparkSession.sql("SELECT ''")).distinct())
    held = docs.select("doc_id", terms(F.col("text")).alias("t"))
    twice, same = _repeated(docs), F.col("doc_id").eqNullSafe(F.col("__of"))
    some = not twice.isEmpty()
    single = held.join(twice, same, "left_anti") if some else held
    shared = corpus_terms(docs.join(twice, same, "left_semi")).join(wanted, "term", "left_semi")
    # the empty term, which no text holds, stands for each row and its size
    own = F.array_append(F.coalesce(F.array_distinct("t"), F.array().cast("array<string>")), F.lit(""))
    each = single.select(F.array_size("t").alias("size"), F.explode(own).alias("term"))
    if some:
        each = each.unionByName(held.join(twice, same, "left_semi").select(F.array_size("t").alias("size"), F.lit("").alias("term"))).unionByName(shared.select("size", "term"))
    tally = each.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.avg("size").alias("mean")).persist()  # a row for each term of the queries
    facts = tally.where("term = ''").first() or {"df": 0, "mean": None}
    df = tally.where("term != ''")
    idf = F.log1p((F.lit(facts["df"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("query_id", "term", idf.alias("idf"))
    mean = facts["mean"] or 1.0

    def scored(block: tuple, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, weights, fan, of, n = block
        rows, at, tf, sizes = _tally(batch.column("t"), known)
        gain = weights[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[rows] / mean))
        s = _spread(rows, at, gain, batch.num_rows, fan, of, n)
        return _leading(s, batch.column("doc_id").to_numpy(zero_copy_only=False), k)

    per_query = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms")).orderBy("query_id")
    found = _scans(single.select(F.col("doc_id").cast("bigint").alias("doc_id"), "t"), per_query, "doc_id", k, scored, _by_term)
    tally.unpersist()
    if some:
        gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(mean)))
        joined = shared.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.sum(gain).alias("score"))
        found = found.unionByName(joined)
    order = [F.desc(F.round("score", 9)), F.asc("doc_id")]
    return best_first(found, ["query_id"], order, k).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def _by_term(rows: list) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]:
    """Terms of a block of queries, their weights, how many queries ask each, these queries term by term, and their number."""
    at: dict[str, tuple[float, list[int]]] = {}
    for i, own in enumerate(rows):
        for term, idf in own:
            at.setdefault(term, (idf, []))[1].append(i)
    fan = np.array([len(q) for _, q in at.values()], dtype=np.int64)
    return pa.array(at, pa.string()), np.array([w for w, _ in at.values()]), fan, np.array([i for _, q in at.values() for i in q], dtype=np.int64), len(rows)


def _tally(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the known term and its count for each term of each row, and how many terms each row has."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    which = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(which >= 0)
    code, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[hit] * max(len(known), 1) + which[hit], return_counts=True)
    return code // max(len(known), 1), code % max(len(known), 1), tf, sizes


#: Gains that are dealt out to queries at once.
MOST_GAINS = 1 << 20


def _spread(rows: np.ndarray, at: np.ndarray, gain: np.ndarray, height: int, fan: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of gains by row and query; equal rows are added up in the same order, so that their scores are equal too."""
    s, first = np.zeros(height * n), np.cumsum(fan) - fan
    step = max(1, MOST_GAINS // int(fan.max(initial=1)))
    for low in range(0, len(rows), step):
        own = at[low : low + step]
        each = fan[own]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(s, np.repeat(rows[low : low + step] * n, each) + of[np.repeat(first[own], each) + inner], np.repeat(gain[low : low + step], each))
    return s.reshape(height, n)


def _leading(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of what may be among the k best of each query (a column), ties to nine digits too."""
    r = np.ascontiguousarray(np.round(s, 9).T)
    least = np.partition(r, r.shape[1] - k, axis=1)[:, r.shape[1] - k] if r.shape[1] > k else np.zeros(len(r))
    q, i = np.nonzero((r >= least[:, None]) & (s.T > 0))
    return q, ids[i].astype(np.int64), s[i, q]


def gram_rows(df: DataFrame, key: str) -> DataFrame:
    """key and gram: the distinct alphanumeric bigrams of text (the text itself where it has one character)."""
    chars = F.split(T.alnum_fold(F.col("text")), "")
    held = df.select(key, F.filter(chars, lambda x: x != "").alias("c")).withColumn("n", F.size("c"))
    rest = F.greatest(F.col("n") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("c", F.lit(1), rest), F.slice("c", F.lit(2), rest), lambda a, b: F.concat(a, b))
    return held.select(key, F.explode(F.when(F.col("n") == 1, F.col("c")).otherwise(pairs)).alias("gram")).distinct()


#: Queries that a scan of the corpus is asked at once.
QUERIES_A_SCAN = 2048


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to nine digits by the smaller id."""
    order = np.lexsort((v, -np.round(s, 9), q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    kept = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[kept], v[kept], s[kept]


def _scans(rows: DataFrame, queries: DataFrame, key: str, k: int, scored: Callable, pack: Callable = list) -> DataFrame:
    """query_id, key and score of the k best rows of each query.

    The queries are broadcast in blocks of QUERIES_A_SCAN, each of which is one scan of the rows: a task keeps the k best of
    what it has seen, so queries x k x tasks rows are shuffled and rows never are. scored: (block, batch) to the numbers of
    queries, ids and scores of what a batch has to offer.
    """
    spark, out, held = rows.sparkSession, None, []
    name = key

    def scan(block: list) -> DataFrame:
        told = spark.sparkContext.broadcast((np.array([r[0] for r in block], dtype=np.int64), pack([r[1] for r in block])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            ids, own = told.value
            for batch in parts(batches):
                best = _best(*[np.concatenate([x, y]) for x, y in zip(best, scored(own, batch))], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", name, "score"])

        return rows.mapInArrow(run, f"query_id bigint, {name} bigint, score double")

    for r in queries.toLocalIterator():
        held.append(tuple(r))
        if len(held) == QUERIES_A_SCAN:
            out, held = scan(held) if out is None else out.union(scan(held)), []
    if held or out is None:
        out = scan(held) if out is None else out.union(scan(held))
    return best_first(out, ["query_id"], [F.desc(F.round("score", 9)), F.asc(key)], k)


def lexical(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """|q & d| / sqrt(|d|) over distinct alphanumeric bigrams: query_id, doc_id and score of the k best of each query."""
    asked = gram_rows(queries, "query_id").groupBy("query_id").agg(F.collect_set("gram").alias("grams")).orderBy("query_id")

    def scored(block: tuple, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        batch = batch.filter(pc.is_valid(batch.column("doc_id")))
        rows, at, sizes = _grams_held(batch.column("folded"), block[0])
        s = _shared(rows, at, batch.num_rows, *block[1:]) / np.sqrt(np.maximum(sizes, 1))[:, None]
        return _leading(s, batch.column("doc_id").to_numpy(zero_copy_only=False), k)

    folded = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), T.alnum_fold(F.col("text")).alias("folded"))
    return _scans(folded, asked, "doc_id", k, scored, _by_gram)


#: Code points take 21 bits; this one, which is none, comes before a character that stands alone.
_BITS, _ALONE = 21, 0x1FFFFF
#: A gram that one in so many queries asks is multiplied out, others are dealt out one by one.
_COMMON = 8


def _by_gram(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a block's grams in order; column of the common ones (else -1) and which queries ask them; how many queries
    ask each gram (none of the common ones), and these queries gram by gram."""
    at: dict[int, list[int]] = {}
    for i, grams in enumerate(rows):
        for g in grams:
            at.setdefault((ord(g[0]) if len(g) > 1 else _ALONE) << _BITS | ord(g[-1]), []).append(i)
    codes = sorted(at)
    common = [c for c in codes if len(at[c]) * _COMMON >= len(rows)]
    column, asked = np.full(len(codes), -1), np.zeros((len(common), len(rows)), dtype=np.float32)
    for j, c in enumerate(common):
        column[np.searchsorted(codes, c)] = j
        asked[j, at.pop(c)] = 1
    fan = np.array([len(at.get(c, ())) for c in codes], dtype=np.int64)
    return np.array(codes, dtype=np.int64), column, asked, fan, np.array([i for c in codes for i in at.get(c, ())], dtype=np.int64)


def _grams_held(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each known gram of each text, once, and how many different grams each text has."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = row[1:] == row[:-1]
    alone = sizes[row] == 1
    keys = np.concatenate([(row[:-1] << 2 * _BITS | points[:-1] << _BITS | points[1:])[inside], (row << 2 * _BITS | _ALONE << _BITS | points)[alone]])
    keys = np.unique(keys)
    row, gram = keys >> 2 * _BITS, keys & ((1 << 2 * _BITS) - 1)
    counts = np.bincount(row, minlength=len(sizes))
    if not len(known):
        return row[:0], row[:0], counts
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    hit = known[at] == gram
    return row[hit], at[hit], counts


def _shared(rows: np.ndarray, at: np.ndarray, height: int, column: np.ndarray, asked: np.ndarray, fan: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many grams each row has in common with each query."""
    of_row = column[at] >= 0
    held = np.zeros((height, len(asked)), dtype=np.float32)
    held[rows[of_row], column[at[of_row]]] = 1
    rare = ~of_row
    return (held @ asked).astype(np.float64) + _spread(rows[rare], at[rare], np.ones(rare.sum()), height, fan, of, asked.shape[1])


def vector_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query by inner product: query_id, vec_id, score. Null vectors are no one's."""

    def scored(block: list, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = batch.num_rows
        if not n or not len(block):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        s = block.astype(np.float64) @ v.T
        r = np.round(s, 9)
        least = np.partition(r, n - k, axis=1)[:, n - k] if n > k else r.min(axis=1)
        q, i = np.nonzero(r >= least[:, None])
        return q, batch.column("vec_id").to_numpy(zero_copy_only=False)[i].astype(np.int64), s[q, i]

    kind = np.float32 if dict(queries.dtypes)["embedding"] == "array<float>" else np.float64
    packed = lambda rows: np.array(rows, dtype=kind)  # noqa: E731  as exact as the column, a tenth of a list of numbers
    return _scans(vectors.where("embedding is not null").select("vec_id", "embedding"), queries.where("embedding is not null").select("query_id", "embedding"), "vec_id", k, scored, packed)
