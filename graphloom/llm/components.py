"""Connected components of an edge list, by stars whose centres only fall."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _least(arcs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node; written, so that the join that follows may split a hot node's rows."""
    return cut(arcs.groupBy("u").agg(F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any comparable type -> (node, component): the smallest node reachable, for every node of an edge between two different nodes.

    Large-star and small-star rounds alternate until nothing changes; each round is written to the shared folder. Repeated edges and loops do no harm; no edges give no rows.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or sums == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = sums
        arcs = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = arcs.join(_least(arcs), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.col("u").alias("w"))
        e = cut(large.where("u > w and u != v").select("u", "v").distinct())
        small = e.join(_least(e), "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct())
