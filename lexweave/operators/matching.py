"""Dictionary matching and interval operators as joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T
from ..functions.batches import parts


def row_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a row by its content: rows of one doc_id with different texts and rows without doc_id stay apart.

    Rows that are equal share the key, and whatever is found by it holds for each of them.
    """
    return F.struct(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("of"))


def places(text: Column, surface: Column) -> Column:
    """0-based starts of occurrences that don't overlap, from the left; the surface is not empty."""
    size = F.length(surface)
    parts = F.split(text, F.concat(F.lit("\\Q"), surface, F.lit("\\E")))
    return F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, x: F.struct((s["at"] + F.length(x) + size).alias("at"), F.array_append(s["found"], s["at"] + F.length(x)).alias("found")), lambda s: s["found"],
    )


def occurrences(text: Column, surface: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too.

    A surface that does not begin as it ends cannot overlap itself: one split of the text gives its places. Others are
    tried at each position.
    """
    size, last = F.length(surface), F.length(text) - F.length(surface)
    none = F.array().cast("array<int>")
    bordered = F.exists(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: (k < size) & (F.left(surface, k) == F.right(surface, k))) | F.contains(surface, F.lit("\\E"))
    tried = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, size) == surface)
    return F.when((size == 0) | (last < 0), none).when(bordered, tried).otherwise(places(text, surface))


def literal_matches(docs: DataFrame, patterns: DataFrame, most: int = 4 << 20) -> DataFrame:
    """All occurrences of patterns (item_id, surface) in docs (doc_id, text), overlapping ones too: doc_id, item_id,
    surface, text, start, end. A pattern given twice matches once.

    Patterns of ``most`` bytes in all are broadcast as an automaton, which reads each text once; more of them meet the
    texts by joins on tokens. Both give the same rows. Null and empty texts and surfaces match nothing; rows that share a
    doc_id, or have none, are matched each by its own text. doc_id may be of any type that can be a key.
    """
    own = patterns.where(F.length("surface") > 0).select("item_id", "surface").distinct()
    size = own.agg(F.sum(F.octet_length("surface"))).first()[0] or 0
    return _scanned(docs, own) if size <= most else _joined(docs, own)


_automata: dict[str, object] = {}


def _scanned(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """A kernel gives one row for each text that holds something; it is opened up on the JVM's side."""
    held, key = docs.sparkSession.sparkContext.broadcast(patterns.toArrow()), uuid.uuid4().hex
    found = ArrayType(StructType([StructField("item_id", patterns.schema["item_id"].dataType), StructField("surface", patterns.schema["surface"].dataType), StructField("start", IntegerType()), StructField("end", IntegerType())]))
    out = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("text", docs.schema["text"].dataType), StructField("found", found)])

    def automaton():  # noqa: ANN202
        import ahocorasick

        if key not in _automata:
            _automata.clear()
            trie = ahocorasick.Automaton()
            at: dict[str, list[int]] = {}
            for i, s in enumerate(held.value.column("surface").to_pylist()):
                at.setdefault(s, []).append(i)
            for s, of in at.items():
                trie.add_word(s, (len(s), of))
            if at:
                trie.make_automaton()
            _automata[key] = trie
        return _automata[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, table = automaton(), held.value
        for batch in parts(batches):
            hits = [[(i, end + 1 - n, end + 1) for end, (n, of) in trie.iter(t) for i in of] if t and len(trie) else [] for t in batch.column("text").to_pylist()]
            rows = pa.array([r for r, h in enumerate(hits) if h], pa.int32())
            items, starts, ends = (pa.array(c, pa.int32()) for c in zip(*[x for h in hits for x in h])) if len(rows) else [pa.array([], pa.int32())] * 3
            own = [table.column(c).combine_chunks().take(items) for c in ("item_id", "surface")]
            offsets = pa.array([0, *accumulate(len(h) for h in hits if h)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([*own, starts, ends], names=["item_id", "surface", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text").take(rows), lists], names=out.names)

    opened = docs.select("doc_id", "text").mapInArrow(run, out).select("doc_id", "text", F.inline("found"))
    return opened.select("doc_id", "item_id", "surface", "text", "start", "end")


def _joined(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """A pattern of four blank-parted tokens and more is sought by its second and third, which the text must hold as
    tokens: an equi-join on them leaves few pairs to verify. Shorter ones meet by their first two characters.
    """
    docs = docs.select(row_of().alias("__row"), "doc_id", "text")
    parts = parts.withColumn("__t", F.split("surface", " "))
    long = parts.where(F.size("__t") >= 4).select("item_id", "surface", F.concat_ws(" ", F.col("__t")[1], F.col("__t")[2]).alias("anchor"))
    tokens = F.split("text", " ")
    held = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), held), F.slice(tokens, F.lit(2), held), lambda a, b: F.concat_ws(" ", a, b))
    short = parts.where(F.size("__t") < 4).select("item_id", "surface", F.left("surface", F.lit(2)).alias("anchor"))
    size = F.length("text")
    starts = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("text", i, F.lit(2))))
    both = F.array_distinct(F.concat(F.coalesce(starts, F.array().cast("array<string>")), F.transform(F.coalesce(starts, F.array().cast("array<string>")), lambda g: F.left(g, F.lit(1)))))
    anchored = docs.select("__row", F.explode(pairs).alias("anchor")).join(long, "anchor").union(docs.select("__row", F.explode(both).alias("anchor")).join(short, "anchor").select("anchor", "__row", "item_id", "surface"))
    # rows may repeat: a pair of a row and a pattern is one, and meets every copy of the row
    found = docs.join(anchored.select("__row", "item_id", "surface").distinct(), "__row").where(F.contains("text", "surface"))
    placed = found.select("doc_id", "item_id", "surface", "text", F.explode(occurrences(F.col("text"), F.col("surface"))).alias("start"))
    return placed.select("doc_id", "item_id", "surface", "text", "start", (F.col("start") + F.length("surface")).alias("end"))


def with_boundaries(matches: DataFrame) -> DataFrame:
    """Adds whether a match starts and ends at token boundaries."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")

    def at(i: Column) -> Column:
        return F.when(i < 0, F.lit("")).otherwise(F.substring(text, i + 1, F.lit(1)))

    return matches.withColumn("bounded", T.token_boundary(at(start - 1), at(start)) & T.token_boundary(at(end - 1), at(end)))


def greedy_intervals(spans: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """Non-overlapping spans of each key, taken greedily in ``order``; spans: key, start, end and columns ``keep``.

    The spans of one key are one array, so a key's spans must fit a task; the fold over it is native.
    """
    ranked = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"__{i}") for i, c in enumerate(order)], "start", "end", *keep))).alias("s"))
    kind = "array<" + dict(ranked.dtypes)["s"][6:-1] + ">"
    fold = F.aggregate("s", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), acc).otherwise(F.array_append(acc, x)))
    return ranked.select(key, F.explode(fold).alias("x")).select(key, "x.start", "x.end", *[F.col(f"x.{c}") for c in keep])


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: int = 256, how: str = "inner") -> DataFrame:
    """Pairs of spans of one key that overlap: an equi-join on the buckets that spans touch, each pair once.

    left and right: key, start, end; right's columns get the prefix r_. A pair is kept in the first bucket they share.
    """

    def spread(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col("start"), F.col("end") - 1)
        return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(last / bucket))))

    r = spread(right).select(*[F.col(c).alias(f"r_{c}") for c in [*right.columns, "__b"]])
    both = spread(left).join(r, (F.col(key) == F.col(f"r_{key}")) & (F.col("__b") == F.col("r___b")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    pairs = both.where(F.col("__b") == F.floor(F.greatest("start", "r_start") / bucket)).drop("__b", "r___b", f"r_{key}")
    if how == "inner":
        return pairs
    hit = pairs.select(*left.columns).distinct()
    return left.join(hit, left.columns, "left_anti" if how == "anti" else "left_semi")


def merged_intervals(spans: DataFrame, key: str) -> DataFrame:
    """Unions of touching or overlapping spans of each key."""
    w = Window.partitionBy(key).orderBy("start", "end")
    island = F.sum(F.coalesce((F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))).over(w)
    return spans.withColumn("__i", island).groupBy(key, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def maximal(spans: DataFrame, key: str) -> DataFrame:
    """Spans that no other span of the key strictly contains; repeated spans stay."""
    w = Window.partitionBy(key).orderBy(F.asc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    one = spans.select(key, "start", "end").distinct()
    kept = one.withColumn("__e", F.max("end").over(w)).where("__e is null or __e < end").drop("__e")
    return spans.join(kept, [key, "start", "end"], "left_semi")


def best_first(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def one_edit_pairs(words: DataFrame, key: str, surface: str) -> DataFrame:
    """Pairs (a, b) of keys, a below b, whose surfaces are one insertion, deletion or change of a character apart.

    Two such surfaces share a form: each as it is or with one character taken out. An equi-join on the forms leaves few
    pairs to verify, and each pair is verified once however many forms it shares.
    """
    s = F.col("__s")
    forms = F.array_distinct(F.concat(F.array(s), F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
    spread = words.select(F.col(key).alias("__k"), F.col(surface).alias("__s")).withColumn("form", F.explode(forms))
    both = spread.alias("x").join(spread.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.__k") < F.col("y.__k")) & (F.col("x.__s") != F.col("y.__s")))
    near = both.select(F.col("x.__k").alias("a"), F.col("y.__k").alias("b"), F.col("x.__s").alias("sa"), F.col("y.__s").alias("sb")).distinct()
    return near.where(T.one_edit(F.col("sa"), F.col("sb"))).select("a", "b")


def contained(words: DataFrame, key: str, surface: str) -> DataFrame:
    """Pairs (inner, outer) of keys where the outer surface holds the inner one, which has two characters at least.

    An equi-join on the inner surface's first two characters, of which the outer one must have the pair somewhere.
    """
    s = F.col(surface)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))
    inner = words.where(F.length(s) >= 2).select(F.col(key).alias("inner"), s.alias("__i"), F.left(s, F.lit(2)).alias("__g"))
    outer = words.select(F.col(key).alias("outer"), s.alias("__o"), F.explode(pairs).alias("__g"))
    return inner.join(outer, "__g").where((F.col("inner") != F.col("outer")) & F.contains("__o", "__i")).select("inner", "outer")
