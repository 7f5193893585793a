"""Connected components of links to a fixpoint, by contraction; what rounds read is cut by checkpoints that outlive executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names; one is made only where none is set and all tasks are local."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="lexweave-"))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """node and comp, the least node that it reaches, of every node in links (a, b), those that only link to themselves too.

    A round hooks each node to its least neighbour, follows hooks to their ends by doubling, and contracts the links to the
    ends; links within what is joined go. Rounds are at most logarithmic in the nodes, whatever the links' shape. Links with
    a null end, repeated links and links both ways add nothing.
    """
    told = links.where("a is not null and b is not null")
    alone = told.select("a").union(told.select("b")).distinct()
    edges = cut(told.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")))
        while True:  # each pass doubles how far a hook reaches
            far = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            moved = cut(hooks.join(far, "comp").select("node", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")))
            hooks = moved.select("node", "comp")
            if moved.where("moved").isEmpty():
                break
        levels.append(hooks)
        low, high = (hooks.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_")) for c in ("a", "b"))
        edges = cut(edges.join(low, "a").join(high, "b").where("a_ != b_").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct())
    out = alone.select(F.col("a").alias("node"), F.col("a").alias("comp"))
    for level in levels:
        out = out.join(level.select(F.col("node").alias("comp"), F.col("comp").alias("__far")), "comp", "left").select("node", F.coalesce("__far", "comp").alias("comp"))
    return out


def split(nodes: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """nodes (node, comp) with held, true for about ``share`` of the components by a hash of their name: none lies on both sides."""
    return nodes.withColumn("held", F.pmod(F.xxhash64(F.col("comp").cast("string"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
