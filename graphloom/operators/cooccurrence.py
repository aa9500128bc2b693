"""Co-occurrence matrices from colouring vectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from . import vectors
from .colouring import ALPHA, EPSILON, colour, colour_cached, colour_pushed
from .graph import Graph, entities, predicate_ids, predicate_object_ids, reverse
from .weigh import weigh


def records(v: DataFrame, normalise: bool = True) -> DataFrame:
    """Vectors -> word1, word2, val with ids from 1. normalise: without the seed's own entry, scaled to sum 1."""
    if normalise:
        v = vectors.normalise(vectors.remove_self(v))
    return v.select((F.col("seed") + 1).alias("word1"), (F.col("key") + 1).alias("word2"), "val")


def _seeds(graph: Graph, only_entities: bool) -> DataFrame:
    return (entities(graph) if only_entities else graph.nodes).select(F.col("node_id").alias("seed"))


def frequencies(graph: Graph, wedges: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, edges: bool = True, normalise: bool = True, only_entities: bool = False) -> DataFrame:
    """The matrix of all nodes, or of the entities; edges: with entries for predicates."""
    return records(colour(wedges, _seeds(graph, only_entities), alpha, epsilon, predicate_ids(graph) if edges else None), normalise)


def frequencies_cached(graph: Graph, wedges: DataFrame, order: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, edges: bool = True, normalise: bool = True, only_entities: bool = False) -> DataFrame:
    """The matrix from vectors that are handed on in a given order (pos, node_id) of all nodes; see colour_cached() for the size of graphs."""
    v = colour_cached(wedges, order, alpha, epsilon, predicate_ids(graph) if edges else None)
    return records(v.join(_seeds(graph, True), "seed", "left_semi") if only_entities else v, normalise)


def frequencies_both_ways(graph: Graph, forward: int = 1, backward: int = 1, ranks: DataFrame | None = None, alpha: float = ALPHA, epsilon: float = EPSILON, normalise: bool = True, only_entities: bool = False) -> DataFrame:
    """The sum of the vectors along the edges (with predicates) and against them (without). Entities are those of the graph itself, either way."""
    back = Graph(graph.nodes, reverse(graph.edges))
    seeds = _seeds(graph, only_entities)
    along = colour(weigh(graph, forward, ranks), seeds, alpha, epsilon, predicate_ids(graph))
    return records(vectors.add(along, colour(weigh(back, backward, ranks), seeds, alpha, epsilon)), normalise)


def frequencies_pushed(graph: Graph, wedges: DataFrame, alpha: float = 0.1, epsilon: float = 1e-6) -> DataFrame:
    """The matrix of resources against (predicate, object) pairs, whose ids follow the nodes'."""
    seeds = graph.nodes.where(F.col("label").startswith("<")).select(F.col("node_id").alias("seed"))
    pairs = predicate_object_ids(graph.edges)
    pushed = colour_pushed(wedges, seeds, alpha, epsilon).join(graph.edges.select("edge_id", "pred"), "edge_id").groupBy("seed", "pred", "dst").agg(F.sum("val").alias("val"))
    n = graph.nodes.count()
    return pushed.join(pairs, ["pred", "dst"]).select((F.col("seed") + 1).alias("word1"), (F.col("pair_id") + n).alias("word2"), "val")


def sweep(graph: Graph, wedges: DataFrame, settings: Iterable[tuple[float, float]], **how) -> DataFrame:
    """frequencies() for each (alpha, epsilon), with both as columns."""
    rows = [frequencies(graph, wedges, a, e, **how).withColumns({"alpha": F.lit(a), "epsilon": F.lit(e)}) for a, e in settings]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def transpose_predicates(matrix: DataFrame, first_predicate: int) -> DataFrame:
    """The records, and those whose second word is a predicate (its id at least first_predicate) the other way round as well."""
    back = matrix.where(F.col("word2") >= first_predicate).select(F.col("word2").alias("word1"), F.col("word1").alias("word2"), "val")
    return matrix.unionByName(back)
