"""Edge weights by twelve strategies, normalised over each source's edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .graph import Graph, counts

DEFAULT_RANK = 0.2

Weigher = Callable[[Graph, DataFrame | None, float | None], DataFrame]
#: What the strategies of STRATEGIES do with the table that edges are joined with, so that it can be made once for many slices of edges.
Keep = Callable[[DataFrame], DataFrame]


def normalise(raw: DataFrame) -> DataFrame:
    """edges with raw -> edges with weight: a source's weights sum to 1. Totals are partial sums joined back, so that a source of many edges is no single task."""
    total = raw.groupBy("src").agg(F.sum("raw").alias("total"))
    return raw.join(total, "src").select("edge_id", "src", "dst", "pred", (F.col("raw") / F.col("total")).alias("weight"))


def _frequency(*by: str, inverse: bool = False, power: int = 1) -> Weigher:
    """Counts are partial sums joined back, so that a frequent predicate or object is no single task."""

    def raw(graph: Graph, ranks: DataFrame | None, default: float | None, keep: Keep = lambda rows: rows) -> DataFrame:
        n = F.col("n").cast("double")
        value = 1.0 / F.pow(n, F.lit(float(power))) if inverse else n
        return graph.edges.join(keep(counts(graph.edges, *by)), list(by)).withColumn("raw", value)

    return raw


def _ranked(inverse: bool, split: bool) -> Weigher:
    """The object's rank; a node without one has the default, which isn't inverted. Default None: every object needs a rank."""

    def raw(graph: Graph, ranks: DataFrame | None, default: float | None, keep: Keep = lambda rows: rows) -> DataFrame:
        if ranks is None:
            raise ValueError("this strategy needs ranks")
        rank: Column = F.col("rank")
        if inverse:
            rank = F.when(rank == 0, F.raise_error(F.lit("a rank of zero has no inverse")).cast("double")).otherwise(1.0 / rank)
        missing = F.raise_error(F.concat(F.lit("no rank for "), "label")).cast("double") if default is None else F.lit(float(default))
        known = graph.nodes.join(ranks.select("label", F.col("weight").alias("rank")), "label", "left").select(F.col("node_id").alias("dst"), F.when(F.col("rank").isNotNull(), rank).otherwise(missing).alias("raw"))
        targets = counts(graph.edges, "dst").join(known, "dst").select("dst", (F.col("raw") / F.col("n") if split else F.col("raw")).alias("raw"))
        return graph.edges.join(keep(targets), "dst")

    return raw


STRATEGIES: dict[int, tuple[str, Weigher]] = {
    1: ("uniform", lambda graph, ranks, default, keep=None: graph.edges.withColumn("raw", F.lit(1.0))),
    2: ("predicate_freq", _frequency("pred")),
    3: ("inv_predicate_freq", _frequency("pred", inverse=True)),
    4: ("object_freq", _frequency("dst")),
    5: ("inv_object_freq", _frequency("dst", inverse=True)),
    6: ("predicate_object_freq", _frequency("pred", "dst")),
    7: ("inv_predicate_object_freq", _frequency("pred", "dst", inverse=True)),
    8: ("rank", _ranked(False, False)),
    9: ("inv_rank", _ranked(True, False)),
    10: ("rank_split", _ranked(False, True)),
    11: ("inv_rank_split", _ranked(True, True)),
    12: ("inv_object_split", _frequency("dst", inverse=True, power=2)),
}


def weigh(graph: Graph, strategy: int | Weigher = 1, ranks: DataFrame | None = None, default: float | None = DEFAULT_RANK) -> DataFrame:
    """edge_id, src, dst, pred, weight. strategy: a number of STRATEGIES, or a function that gives edges with a column raw."""
    if not callable(strategy) and strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}")
    return normalise((strategy if callable(strategy) else STRATEGIES[strategy][1])(graph, ranks, default))
