"""Bookmark colouring: approximate personalised PageRank vectors of many seeds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.queue import PaintQueue
from ..session import cut, ready

ALPHA, EPSILON = 0.5, 1e-3
#: The most edges that one task's exact propagation loads.
EXACT_EDGES = 5_000_000


def colour(wedges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, predicates: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """seeds (seed: a node id) -> seed, key, val.

    Every round, all paint of at least epsilon is taken up: alpha of it stays on its node, the rest goes along the edges by weight; less is carried until more comes. What is left at the end stays by alpha. predicates (pred, pred_id): each edge's paint also counts, in full, for its predicate's id. Paint at nodes without edges is lost but for alpha.

    State is (seed, node) rows; rounds end when none is left to take up, at most about log(epsilon) / log(1 - alpha) times a few.
    """
    ready(wedges.sparkSession)
    out = wedges.select(F.col("src").alias("node"), "dst", "weight", *([] if predicates is None else ["pred"]))
    if predicates is not None:
        out = out.join(predicates, "pred").drop("pred")
    out = cut(out)
    state = cut(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(1.0).alias("paint")).distinct())
    done: list[DataFrame] = []
    for _ in range(rounds):
        active = state.where(F.col("paint") >= epsilon)
        if active.isEmpty():
            break
        done.append(active.select("seed", F.col("node").alias("key"), (alpha * F.col("paint")).alias("val")))
        sent = active.join(out, "node").withColumn("paint", (1 - alpha) * F.col("paint") * F.col("weight"))
        if predicates is not None:
            sent = cut(sent.select("seed", "dst", "pred_id", "paint"))
            done.append(sent.groupBy("seed", F.col("pred_id").alias("key")).agg(F.sum("paint").alias("val")))
        state = cut(sent.select("seed", F.col("dst").alias("node"), "paint").unionByName(state.where(F.col("paint") < epsilon)).groupBy("seed", "node").agg(F.sum("paint").alias("paint")))
    done.append(state.select("seed", F.col("node").alias("key"), (alpha * F.col("paint")).alias("val")))
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    return rows.groupBy("seed", "key").agg(F.sum("val").alias("val"))


def colour_pushed(wedges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, rounds: int = 10_000) -> DataFrame:
    """seeds -> seed, edge_id, dst, val: what reaches a node stays with the edge it came by, by alpha; the rest goes on only where a node's paint gets above epsilon, and is else dropped."""
    out = cut(wedges.select(F.col("src").alias("node"), "edge_id", "dst", "weight"))
    state = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("paint")).distinct())
    done = []
    for _ in range(rounds):
        if state.isEmpty():
            break
        sent = cut(state.join(out, "node").select("seed", "edge_id", "dst", (F.col("paint") * F.col("weight")).alias("paint")))
        done.append(sent.select("seed", "edge_id", "dst", (alpha * F.col("paint")).alias("val")))
        state = cut(sent.groupBy("seed", F.col("dst").alias("node")).agg(((1 - alpha) * F.sum("paint")).alias("paint")).where(F.col("paint") > epsilon))
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    return rows.groupBy("seed", "edge_id", "dst").agg(F.sum("val").alias("val"))


def _adjacency(rows) -> dict[int, list[tuple[int, float, int]]]:
    near: dict[int, list[tuple[int, float, int]]] = {}
    for r in rows:
        near.setdefault(r.src, []).append((r.dst, r.weight, r.pred_id))
    return near


def propagate(seed: int, near: dict[int, list[tuple[int, float, int]]], alpha: float, epsilon: float, memo: dict[int, dict[int, float]] | None = None) -> dict[int, float]:
    """One seed's vector, largest paint first; nodes in memo hand on their finished vectors' entries that come to more than alpha x epsilon."""
    queue, vector = PaintQueue(), {}
    queue[seed] = 1.0
    while len(queue):
        node, paint = queue.pop()
        if memo is not None and node in memo:
            for key, value in memo[node].items():
                if value * paint > alpha * epsilon:
                    vector[key] = vector.get(key, 0.0) + value * paint
            continue
        vector[node] = vector.get(node, 0.0) + alpha * paint
        if paint < epsilon:
            continue
        for dst, weight, pred in near.get(node, ()):
            queue.add(dst, (1 - alpha) * paint * weight)
            if pred >= 0:
                vector[pred] = vector.get(pred, 0.0) + (1 - alpha) * paint * weight
    return vector


def _loaded(wedges: DataFrame, predicates: DataFrame | None, most: int):
    rows = wedges.withColumn("pred_id", F.lit(-1).cast("long")) if predicates is None else wedges.join(predicates, "pred")
    if (n := wedges.count()) > most:
        raise ValueError(f"{n} edges are more than one task loads ({most}); colour() has no such bound")
    return ready(wedges.sparkSession).sparkContext.broadcast(_adjacency(rows.select("src", "dst", "weight", "pred_id", "edge_id").orderBy("edge_id").collect()))


def colour_exact(wedges: DataFrame, seeds: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, predicates: DataFrame | None = None, most_edges: int = EXACT_EDGES) -> DataFrame:
    """As colour(), in exact order of paint, for graphs of at most most_edges edges: those are broadcast, and seeds go their own ways."""
    near = _loaded(wedges, predicates, most_edges)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, k, v) for s in f["seed"].tolist() for k, v in propagate(s, near.value, alpha, epsilon).items()]
            yield pd.DataFrame(rows, columns=["seed", "key", "val"])

    return seeds.select("seed").distinct().mapInPandas(run, "seed long, key long, val double")


def colour_cached(wedges: DataFrame, order: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, predicates: DataFrame | None = None, most_edges: int = EXACT_EDGES) -> DataFrame:
    """All of order's nodes (pos, node_id) as seeds, each handing on the finished vectors of those before it. One after another by definition, so for graphs of at most most_edges edges; colour() is the form for larger ones."""
    near = _loaded(wedges, predicates, most_edges)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        memo: dict[int, dict[int, float]] = {}
        for s in f.sort_values("pos")["node_id"].tolist():
            memo[s] = propagate(s, near.value, alpha, epsilon, memo)
        return pd.DataFrame([(s, k, v) for s, vector in memo.items() for k, v in vector.items()], columns=["seed", "key", "val"])

    return order.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "seed long, key long, val double")
