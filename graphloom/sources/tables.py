"""The small text tables: node ranks, orders, vocabularies, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbering import dense_ids


def parse_ranks(lines: DataFrame, column: str = "value", order: str = "line_no") -> DataFrame:
    """Lines `resource<TAB>rank` -> label, weight. Blank lines and those begun by # are skipped; of a resource's lines the last holds."""
    rows = lines.where(F.col(column).rlike(r"\S") & ~F.col(column).startswith("#"))
    parts = F.split(F.col(column), "\t", 2)
    rows = rows.select(order, F.concat(F.lit("<"), F.get(parts, 0), F.lit(">")).alias("label"), F.trim(F.get(parts, 1)).cast("double").alias("weight"))
    return rows.groupBy("label").agg(F.max_by("weight", order).alias("weight"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"))
    return parse_ranks(lines)


def read_order(spark: SparkSession, path: str, nodes: int | None = None) -> DataFrame:
    """Whitespace-separated node ids -> pos, node_id; raises if their number isn't `nodes`."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "id"))
    order = dense_ids(lines.where("id <> ''"), "pos", "f", "b", "r", "i").select("pos", F.col("id").cast("long").alias("node_id"))
    if nodes is not None and (n := order.count()) != nodes:
        raise ValueError(f"the order has {n} nodes, the graph {nodes}")
    return order


def write_order(order: DataFrame, path: str) -> None:
    """One id a line; one file, as its lines' order is what it says."""
    order.orderBy("pos").select(F.col("node_id").cast("string")).coalesce(1).write.mode("overwrite").text(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """`label nofr` a line, by word_id; one file, as a line's number is its word's."""
    vocabulary.orderBy("word_id").select(F.concat("label", F.lit(" nofr"))).coalesce(1).write.mode("overwrite").text(path)


def walk_lines(walks: DataFrame) -> DataFrame:
    return walks.select(F.array_join("path", " ").alias("value"))


def write_walks(walks: DataFrame, path: str) -> None:
    walk_lines(walks).write.mode("overwrite").text(path)
