"""Sparse vectors as rows (seed, key, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("seed", "key").agg(F.sum("val").alias("val"))


def remove_self(v: DataFrame) -> DataFrame:
    return v.where(F.col("seed") != F.col("key"))


def normalise(v: DataFrame) -> DataFrame:
    """Each seed's values sum to 1."""
    return v.withColumn("val", F.col("val") / F.sum("val").over(W.partitionBy("seed")))


def render(v: DataFrame, labels: DataFrame, digits: int = 6) -> DataFrame:
    """labels (key, label) -> seed, text: `{label = value, ...}` by key."""
    return _rendered(v.join(labels, "key"), ["key"], F.col("label"), digits)


def render_pairs(v: DataFrame, nodes: DataFrame, digits: int = 6) -> DataFrame:
    """v (seed, pred, dst, val), nodes (node_id, label) -> seed, text: `{(predicate,label) = value, ...}` by object and predicate."""
    rows = v.join(nodes.select(F.col("node_id").alias("dst"), "label"), "dst")
    return _rendered(rows, ["dst", "pred"], F.concat(F.lit("("), F.col("pred"), F.lit(","), F.col("label"), F.lit(")")), digits)


def _rendered(v: DataFrame, by: list[str], name: Column, digits: int) -> DataFrame:
    entry = F.concat(name, F.lit(" = "), F.format_string(f"%.{digits}f", F.col("val")))
    rows = v.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct(*by, entry.alias("entry")))).alias("entries"))
    return rows.select("seed", F.concat(F.lit("{"), F.array_join(F.col("entries.entry"), ", "), F.lit("}")).alias("text"))
