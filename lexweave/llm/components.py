"""Connected components of a table of links, by hooking nodes to least neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _ends(hooks: DataFrame) -> DataFrame:
    """node and comp, where following hooks (node, comp) ends; hooks to smaller nodes form trees."""
    while True:
        far = hooks.select(F.col("node").alias("at"), F.col("comp").alias("far"))
        moved = common.cut(hooks.join(far, hooks["comp"] == far["at"]).select("node", F.col("far").alias("comp"), F.col("comp").alias("old")), "labels")
        common.drop(hooks)
        if moved.where("comp != old").limit(1).count() == 0:
            return moved
        hooks = moved.select("node", "comp")
        hooks._lexweave_path = moved._lexweave_path


def components(links: DataFrame) -> DataFrame:
    """node and comp, its least reachable node, of each node in links (a, b).

    Each round hooks every node to the least among it and its neighbours, follows the hooks to their ends in pointer
    jumps and puts the ends in the place of the nodes. Links within what is joined by then go, so later rounds read only
    the few that are left: a node that stays alone in one round has a smaller neighbour in the next one, so two rounds
    leave at most half of the nodes. Every table of a round is cut into the shared folder and deleted once no round
    reads it; minima are taken before rows are shuffled, and Spark splits the joins of nodes with very many links.
    """
    held = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, levels = common.cut(held, "edges"), []
    while not levels or edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hooks = common.cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "hooks")
        levels.append(_ends(hooks))
        end = levels[-1].select("node", "comp")
        left = edges.join(end.withColumnRenamed("comp", "low"), edges["a"] == end["node"]).select("low", "b")
        left = left.join(end.withColumnRenamed("comp", "high"), left["b"] == end["node"]).where("low != high")
        left = common.cut(left.select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")).distinct(), "edges")
        common.drop(edges)
        edges = left
    out = levels[-1].select("node", "comp")
    for level in levels[-2::-1]:
        far = out.select(F.col("node").alias("at"), F.col("comp").alias("far"))
        out = level.join(far, level["comp"] == far["at"], "left").select("node", F.coalesce("far", "comp").alias("comp"))
    out = common.cut(out, "components")
    common.drop(edges, *levels)
    return out
