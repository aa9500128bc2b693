"""Building and reshaping the labelled graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.numbering import dense_ids, repeats
from ..schema import OWL_THING, RDF_TYPE
from ..session import packed, slice_of, slices, swept
from ..sources.ntriples import without_literals

#: Statements of a slice, as long as there are not too many slices.
SLICE = 1 << 22


@dataclass
class Graph:
    """nodes (node_id, label) and edges (edge_id, src, dst, pred)."""

    nodes: DataFrame
    edges: DataFrame


def dedupe(triples: DataFrame) -> DataFrame:
    """Each statement once, where it first stands."""
    return triples.groupBy("s", "p", "o").agg(F.min("line_no").alias("line_no"))


def encode_nodes(triples: DataFrame) -> DataFrame:
    """Ids by first appearance, a line's subject before its object; lines with one number go by label."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("s").alias("label"), (2 * F.col("line_no")).alias("at")), F.struct(F.col("o").alias("label"), (2 * F.col("line_no") + 1).alias("at")))).alias("e")).select("e.*")
    return dense_ids(ends.groupBy("label").agg(F.min("at").alias("at")), "node_id", "at", "label").select("node_id", "label")


def _encoded(triples: DataFrame, nodes: DataFrame, i: int, n: int) -> DataFrame:
    """line_no, src, dst, pred: the distinct statements of slice i of n, by subject."""
    source, target = nodes.select(F.col("node_id").alias("src"), F.col("label").alias("s")), nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("o"))
    own = dedupe(triples.where(slice_of("s", i, n))).join(source.where(slice_of("s", i, n)), "s").select("line_no", "src", "p", "o")
    return own.join(target, "o").select("line_no", "src", "dst", F.col("p").alias("pred"))


def _numbered(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """edge_id, src, dst, pred: by line number, and of lines with one number by their text; in n slices of line numbers."""
    some = rows.where(slice_of("line_no", 0, 64))  # where slices end changes no number
    ends = [int(x) for x in some.approxQuantile("line_no", [i / n for i in range(1, n)], 0.01)] if n > 1 else []
    at = reduce(lambda c, x: c + (F.col("line_no") >= x).cast("int"), ends, F.lit(0))
    sizes = {r.at: r["count"] for r in rows.groupBy(at.alias("at")).count().collect()}
    source, target = nodes.select(F.col("node_id").alias("src"), F.col("label").alias("s")), nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("o"))
    out, first, tied = [], 0, False
    for i in range(n):
        own = rows.where(at == i)
        if not tied:
            made = dense_ids(own, "edge_id", "line_no", first=first)
            tied = repeats(made, "line_no")
        if tied:
            made = dense_ids(own.join(source, "src").join(target, "dst"), "edge_id", "line_no", "s", "pred", "o", first=first, keep=("src", "dst", "pred"))
        out.append(made.select("edge_id", "src", "dst", "pred"))
        first += sizes.get(i, 0)
    return reduce(DataFrame.unionByName, out)


def build(triples: DataFrame, literals: bool = True) -> Graph:
    """triples (line_no, s, p, o) -> the graph of their distinct statements; literal objects are left out before nodes are numbered.

    Statements are told apart and encoded in slices by subject, which read triples anew, and numbered in slices of lines; only numbers and predicates are kept of them.
    """
    triples = triples if literals else without_literals(triples)
    nodes = encode_nodes(triples)
    n = slices(triples.count(), SLICE)
    edges = _numbered(reduce(DataFrame.unionByName, [packed(_encoded(triples, nodes, i, n)) for i in range(n)]), nodes, n)
    swept(edges.sparkSession)
    return Graph(nodes, edges)


def reverse(edges: DataFrame) -> DataFrame:
    """Source and target change places; ids and labels stay."""
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def prune_leaves(graph: Graph) -> Graph:
    """One pass: nodes with an edge out stay, and the edges between them."""
    alive = graph.edges.select("src").distinct()
    return Graph(graph.nodes.join(alive.withColumnRenamed("src", "node_id"), "node_id", "left_semi"), graph.edges.join(alive.withColumnRenamed("src", "dst"), "dst", "left_semi").select(graph.edges.columns))


def entities(graph: Graph, kind: str = RDF_TYPE, thing: str = OWL_THING) -> DataFrame:
    """node_id of every node of the type."""
    of = graph.nodes.where(F.col("label") == thing).select(F.col("node_id").alias("dst"))
    return graph.edges.where(F.col("pred") == kind).join(of, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()


def predicate_ids(graph: Graph) -> DataFrame:
    """pred, pred_id: ids go on from the nodes', by first edge."""
    first = graph.edges.groupBy("pred").agg(F.min("edge_id").alias("at"))
    return dense_ids(first, "pred_id", "at", first=graph.nodes.count()).select("pred", "pred_id")


def predicate_object_ids(edges: DataFrame) -> DataFrame:
    """pred, dst, pair_id: from 1, by source and then edge."""
    first = edges.groupBy("pred", "dst").agg(F.min(F.struct("src", "edge_id")).alias("at"))
    return dense_ids(first, "pair_id", "at", first=1).select("pred", "dst", "pair_id")


def walk_graph(triples: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph without literals and leaves, and its start nodes: the entities of the graph before pruning."""
    whole = build(triples, literals=False)
    return prune_leaves(whole), entities(whole)


def vocabulary(graph: Graph, predicates: bool = True) -> DataFrame:
    """word_id (from 1), label: nodes by id, then predicates."""
    words = graph.nodes.select((F.col("node_id") + 1).alias("word_id"), "label")
    if predicates:
        words = words.unionByName(predicate_ids(graph).select((F.col("pred_id") + 1).alias("word_id"), F.col("pred").alias("label")))
    return words


def counts(edges: DataFrame, *by: str) -> DataFrame:
    return edges.groupBy(*by).agg(F.count("*").alias("n"))
