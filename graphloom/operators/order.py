"""The order in which finished vectors can be handed on: nodes after those they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbering import dense_ids
from ..session import cut


def levels(nodes: DataFrame, edges: DataFrame, simple: bool = True) -> DataFrame:
    """node_id, level. Each round takes all nodes that lead nowhere out of the graph, or, if there is none, all that more edges reach than any node beside them (ties: the smaller id); so cycles apart from one another are broken in one round.

    simple: parallel edges count once and loops not at all; else all count.
    """
    left = cut(edges.where("src <> dst").select("src", "dst").distinct() if simple else edges.select("src", "dst"))
    waiting, taken, level = cut(nodes.select("node_id")), [], 0
    while not waiting.isEmpty():
        ends = waiting.join(left.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti")
        if ends.isEmpty():
            ends = _crowded(left)
        ends = cut(ends)
        taken.append(ends.withColumn("level", F.lit(level)))
        waiting = cut(waiting.join(ends, "node_id", "left_anti"))
        gone = ends.select(F.col("node_id").alias("dst"))
        left = cut(left.join(gone, "dst", "left_anti").join(gone.withColumnRenamed("dst", "src"), "src", "left_anti").select("src", "dst"))
        level += 1
        if len(taken) > 16:  # the union stays short
            taken = [cut(_union(taken))]
    return _union(taken) if taken else nodes.select("node_id").withColumn("level", F.lit(0)).limit(0)


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _crowded(left: DataFrame) -> DataFrame:
    """node_id of the nodes that more edges reach than any node beside them, ties to the smaller id; all have an edge out."""
    reached = left.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    ends = left.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(left.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other")))
    every = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
    key = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("node")).alias("id"))
    ranked = cut(every.join(reached, "node", "left").select("node", key.alias("key")))
    best = ends.join(ranked.select(F.col("node").alias("other"), F.col("key").alias("beside")), "other").groupBy("node").agg(F.max("beside").alias("beside"))
    return ranked.join(best, "node", "left").where("beside is null or key > beside").select(F.col("node").alias("node_id"))


def order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pos, node_id: by level, then id."""
    return dense_ids(levels(nodes, edges), "pos", "level", "node_id").select("pos", "node_id")


def check(found: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row: the number of nodes, and whether the order is a permutation of 0 to n - 1; with edges also n_ahead, those between different nodes that lead to one that isn't before (each a broken cycle's)."""
    n = F.count("*")
    one = found.agg(n.alias("n"), ((n == F.countDistinct("node_id")) & (F.coalesce(F.min("node_id"), F.lit(0)) == 0) & (F.coalesce(F.max("node_id"), n - 1) == n - 1)).alias("is_permutation"))
    if edges is None:
        return one
    place = lambda end: found.select(F.col("node_id").alias(end), F.col("pos").alias(f"{end}_pos"))
    pairs = edges.where("src <> dst").select("src", "dst").distinct().join(place("src"), "src").join(place("dst"), "dst")
    return one.join(pairs.agg(F.count(F.when(F.col("dst_pos") > F.col("src_pos"), 1)).alias("n_ahead")))
