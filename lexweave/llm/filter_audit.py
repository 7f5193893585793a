r"""How filters interact: what each one removes, alone and behind others, in every order of application.

Filters are conditions on a row of documents under which it fails; one more filter fails rows whose text equals that of
a smaller doc_id. It is found by refining a partition: rows are split by code-point length, then by the hashes of one
block of text after another (BLOCKS; the last one runs to the end, so that all of a text counts), and after each split
classes of a single doc_id are dropped. Whole texts of the classes that are left are compared by grouping, so a hash
never decides, and all but the smallest doc_id of equal texts are marked. Rows then shrink to counts by part, mask of
failures and label, from which every order follows; no order reads a document again.

One pass makes narrow rows of the texts; splits are aggregates with partial sums, and rows follow their class by a
left-semi join, whose hot partitions Spark splits. A second pass reads the texts of the classes that are left.

Without SQL's three values: a condition that is null does not fail. A null text is an empty one, a null source is the part "", and a text without words or characters fails no ratio. A row
of a null doc_id has no label, is equal to nothing, and counts like any other; rows that repeat a doc_id are no copies
of each other. A doc_id with several labels is good or toxic if one of them says so. An empty table gives no rows.
Columns of docs besides doc_id, text, the part's and those that conditions name are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points where blocks of text begin: the first block ends at the second number and so on, the last one at the end.
BLOCKS = (0, 64, 512, 4096)
#: Classes up to which their list, a number each, is broadcast.
BROADCAST_ROWS = 200_000
#: Filters that orders are counted for; n of them have n! orders.
MOST_FILTERS = 7
_WORDS = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """The words of a text, and "" in front or behind where it has blanks there."""
    return F.split(text, _WORDS)


def conditions() -> dict[str, Column]:
    """Failures by letter, over text (never null)."""
    text = F.col("text")
    parts = words(text)
    blank = [(F.element_at(parts, i) == "").cast("int") for i in (1, -1)]
    n = F.greatest(F.size(parts) - blank[0] - blank[1], F.lit(0))
    distinct = F.size(F.array_distinct(parts)) - F.greatest(*blank)
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("bigint") < 50 * n.cast("bigint"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") > 2 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def block_hashes(text: Column) -> list[Column]:
    """A hash of each block; the blocks cover the text."""
    ends = [*BLOCKS[1:], None]
    return [F.xxhash64(F.substring(text, a + 1, b - a if b else 2**31 - 1 - a)) for a, b in zip(BLOCKS, ends)]


def _refined(named: Column, block: int) -> Column:
    """The class of a row after the split by block; named: its class before."""
    return F.xxhash64(named, F.col(f"b{block}"))


def _alive(rows: DataFrame) -> DataFrame:
    """The rows whose class c holds several doc_ids."""
    several = rows.groupBy("c").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("c")
    return rows.join(several, "c", "left_semi")


def copies(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows that hold no smallest doc_id of their text, and the tables that they are read from.

    rows: doc_id, size, b0, b1, ... and any columns but c and lo, without the text; texts: the same rows with it.
    """
    alive = common.cut(_alive(rows.where("doc_id is not null").withColumn("c", F.col("size").cast("bigint"))), "alike-0")
    made, last = [alive], F.col("size").cast("bigint")
    for i in range(len(BLOCKS)):
        last = _refined(last, i)
        alive = common.cut(_alive(alive.withColumn("c", _refined(F.col("c"), i))), f"alike-{i + 1}")
        made.append(alive)
    classes = common.cut(alive.select("c").distinct(), "alike-classes")
    few = classes.count() <= BROADCAST_ROWS
    told = texts.where("doc_id is not null").withColumn("c", last)
    held = told.join(F.broadcast(classes) if few else classes.hint("shuffle_hash"), "c", "left_semi")
    # equal texts meet within a task first, so that a large group is a row of each task
    whole = held.groupBy("c", "text").agg(F.min("doc_id").alias("lo"))
    counted = common.cut(whole.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo")), "alike-texts")
    made += [classes, counted]
    again = alive.join(counted.where("n = 1").select("c", "lo"), "c").where("doc_id > lo").select(*rows.columns)
    mixed = counted.where("n > 1").select("c")
    if not mixed.isEmpty():  # texts that are not equal in a class: their rows meet by text
        again = again.unionByName(told.join(mixed, "c", "left_semi").join(whole.join(mixed, "c", "left_semi"), ["c", "text"]).where("doc_id > lo").select(*rows.columns))
    return again, made


def masks(docs: DataFrame, labels: DataFrame, failing: dict[str, Column] | None = None, duplicates: str = "E", part: str = "source") -> tuple[DataFrame, list[str]]:
    """part, mask, n, good and toxic (rows, and those so labelled), and the filters by bit: bit i of mask is the i-th one's."""
    failing = conditions() if failing is None else failing
    letters = sorted({*failing, duplicates})
    bit = 1 << letters.index(duplicates)
    told = docs.withColumn("text", F.coalesce(docs["text"], F.lit("")))
    mask = sum((F.when(failing[x], 1 << i).otherwise(0) for i, x in enumerate(letters) if x != duplicates), F.lit(0))
    blocks = [h.alias(f"b{i}") for i, h in enumerate(block_hashes(F.col("text")))]

    def measured(*more: str) -> DataFrame:
        return told.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.length("text").alias("size"), *blocks, *more)

    rows = common.cut(measured(), "audit-rows")
    again, made = copies(rows, measured("text"))
    moved = again.select("doc_id", "part", F.inline(F.array(F.struct(F.col("mask"), F.lit(-1).alias("k")), F.struct((F.col("mask") + bit).alias("mask"), F.lit(1).alias("k")))))
    told_of = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    every = rows.select("doc_id", "part", "mask", F.lit(1).alias("k")).unionByName(moved).join(told_of, "doc_id", "left")
    sums = [F.coalesce(F.sum(F.col("k") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")]
    out = common.cut(every.groupBy("part", "mask").agg(F.sum("k").alias("n"), *sums).where("n > 0"), "audit-masks")
    common.drop(rows, *made)
    return out, letters


def orders(sums: DataFrame, letters: list[str]) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the filters.

    What a step does hangs on its filter and on the set of those before it, not on their order: 80 pairs for five
    filters, which are summed first; orders read them by a join with the list of their steps, m! times m rows.
    """
    m = len(letters)
    if m > MOST_FILTERS:
        raise ValueError(f"{m} filters have too many orders; {MOST_FILTERS} at most")
    pairs = [(before, 1 << i) for i in range(m) for before in range(1 << m) if not before >> i & 1]
    cells = sums.select("*", F.inline(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("own")) for b, f in pairs])))
    fails, gone = (F.col("mask").bitwiseAND(F.col(c)) != 0 for c in ("own", "before"))

    def total(of: str, when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).alias(name)

    found = cells.groupBy("part", "before", "own").agg(
        total("n", ~fails & ~gone, "kept"), total("n", fails & ~gone, "removed"), total("n", fails & gone, "redundant"),
        total("n", F.col("mask") == F.col("own"), "unique_fails"), total("good", fails & ~gone, "good_lost"), total("toxic", fails & ~gone, "toxic_lost"),
    )
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(m - 1 - k)).cast("bigint") for k in range(m)]), F.bit_count("before") + 1)
    shares = found.groupBy("part", "own").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = []
    for order in permutations(range(m)):
        before = 0
        for step, i in enumerate(order):
            steps.append(("".join(letters[k] for k in order), step + 1, before, 1 << i))
            before |= 1 << i
    table = sums.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")
    full = found.join(shares, ["part", "own"]).join(F.broadcast(table), ["before", "own"])
    return full.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(docs: DataFrame, labels: DataFrame, failing: dict[str, Column] | None = None, duplicates: str = "E", part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; see orders(). Filters are named by single letters."""
    return orders(*masks(docs, labels, failing, duplicates, part))
