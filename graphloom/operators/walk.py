"""Random walks in proportion to edge weights, reproducible by hashed draws."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.chance import uniform
from ..session import Dealt, cut, packed, slice_of, slices, swept
from .graph import Graph

SEED, LENGTH, WALKS = 45645, 4, 250
#: Edges beyond which a source's running sums go by blocks, and edge ids of a block.
SPAN = 1 << 16
#: Groups of sources whose edges are counted together at first.
GROUPS = 1 << 16
#: Edges and walks of a slice, as long as there are not too many slices.
EDGES, DRAWS = 1 << 22, 1 << 21
#: Slices that walks are at most made in: each reads the cells again, but not the input.
SLICES = 16


def crowded(edges: DataFrame) -> DataFrame | None:
    """src: sources of more than SPAN edges, so at most one for SPAN edges; None if there are none. Edges are counted by groups of sources, then by source in groups that may have one, so that not all sources are shuffled."""
    grouped = edges.select("src", F.pmod(F.xxhash64("src"), F.lit(GROUPS)).alias("group"))
    full = grouped.groupBy("group").count().where(F.col("count") > SPAN).select("group")
    found = grouped.join(F.broadcast(full), "group", "left_semi").groupBy("src").count().where(F.col("count") > SPAN).select("src").collect()
    return edges.sparkSession.createDataFrame([(r.src,) for r in found], edges.select("src").schema) if found else None


def _running(rows: DataFrame, block: Column) -> DataFrame:
    """rows with block, and the sums of weights over its edges: upto with the edge's own, from without."""
    inside = W.partitionBy("src", "block").orderBy("edge_id")
    rows = rows.withColumn("block", block).withColumn("upto", F.sum("weight").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("from", F.coalesce(F.lag("upto").over(inside), F.lit(0.0))).withColumn("later", F.lead("edge_id").over(inside))


def _blocked(wedges: DataFrame, many: DataFrame | None) -> DataFrame:
    """intervals() with the block of each edge: of edge ids for the sources `many`, 0 for others."""
    last = F.when(F.col("later").isNull(), F.greatest(F.lit(1.0), "upto")).otherwise(F.col("upto"))
    few = wedges if many is None else wedges.join(F.broadcast(many), "src", "left_anti")
    few = _running(few, F.lit(0).cast("long")).select(*wedges.columns, "block", last.alias("hi"), F.col("from").alias("lo"))
    if many is None:
        return few
    blocked = _running(wedges.join(F.broadcast(many), "src", "left_semi"), F.floor(F.col("edge_id") / SPAN))
    blocks = blocked.groupBy("src", "block").agg(F.max_by("upto", "edge_id").alias("size"), F.max("edge_id").alias("last"))
    over = W.partitionBy("src").orderBy("block")
    before = F.coalesce(F.sum("size").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    blocks = blocks.select("src", "block", before.alias("before"), F.when(F.lead("block").over(over).isNull(), F.col("last")).alias("last"))
    hi = F.col("before") + F.col("upto")
    ends = F.when(F.col("edge_id") == F.col("last"), F.greatest(F.lit(1.0), hi)).otherwise(hi)
    rows = blocked.join(blocks, ["src", "block"])
    return few.unionByName(rows.select(*wedges.columns, "block", ends.alias("hi"), (F.col("before") + F.col("from")).alias("lo")))


def intervals(wedges: DataFrame) -> DataFrame:
    """wedges with lo and hi: each source's edges, by edge_id, share [0, 1); the last ends at 1 whatever rounding leaves.

    Sums run over a source's edges. For a source of more than SPAN edges they run within blocks of edge ids, and over its blocks, so that no task holds them all.
    """
    return _blocked(wedges, crowded(wedges)).select(*wedges.columns, "hi", "lo")


def _place(rows: str, x: str) -> str:
    """Of the array `rows`, by hi, the place of the first whose hi is beyond x, found by halves; -1 if there are no rows."""
    return f"case when size({rows}) > 0 then aggregate(sequence(cast(floor(log2(size({rows}))) as int), 0, -1), 0, (p, b) -> if(coalesce(get({rows}, p + shiftleft(1, b) - 1).hi <= {x}, false), p + shiftleft(1, b), p)) else -1 end"


def _parted(state: DataFrame, rows: str, seed: int, step: int) -> DataFrame:
    """state with a row for each of its rows' `rows` that draws meet: hit, null if there are none, and these draws."""
    state = state.withColumn("us", F.transform("draws", lambda d: F.struct(uniform(F.lit(seed), "start", d, F.lit(step)).alias("u"), d.alias("draw"))))
    state = state.withColumn("pairs", F.expr(f"sort_array(transform(us, x -> struct({_place(rows, 'x.u')} as place, x.draw as draw)))"))
    state = state.withColumn("firsts", F.expr("filter(sequence(1, size(pairs)), i -> i = 1 or get(pairs, i - 1).place <> get(pairs, i - 2).place)"))
    met = F.expr(f"transform(firsts, (f, i) -> struct(get({rows}, get(pairs, f - 1).place) as hit, transform(slice(pairs, f, coalesce(get(firsts, i + 1), size(pairs) + 1) - f), x -> x.draw) as draws))")
    kept = [c for c in state.columns if c not in ("us", "pairs", "firsts", "draws", rows)]
    return state.select(*kept, F.explode(met).alias("met")).select(*kept, "met.*")


class Walker:
    """A weighted graph made ready to be walked.

    cells has a row for each node and block of its edges: at, block, label, edges (hi, dst, pred) by hi, which a draw searches by halves, however many there are. ends, unless None, has the blocks (hi, block) of nodes with several. An edge does not have its target's label: a walk finds that at its next step, beside the target's edges.

    The cells are made in slices of nodes and kept as a table that all steps join as it lies; it goes with the Walker.
    """

    def __init__(self, graph: Graph, wedges: DataFrame):
        spark = graph.nodes.sparkSession
        self.graph, self.ends = graph, None
        many = crowded(graph.edges)
        self.keys = ["at"] if many is None else ["at", "block"]
        self.dealt = Dealt(spark, self.keys, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        n = slices(graph.edges.count(), EDGES)
        for i in range(n):
            own = slice_of("src", i, n)
            rows = _blocked(wedges.where(own), many if many is None else many.where(own)).groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("hi", "edge_id", "dst", "pred"))).alias("edges"))
            rows = rows.select(F.col("src").alias("node_id"), "block", F.transform("edges", lambda e: F.struct(e["hi"].alias("hi"), e["dst"].alias("dst"), e["pred"].alias("pred"))).alias("edges"))
            self.dealt.add(graph.nodes.where(slice_of("node_id", i, n)).join(rows, "node_id", "left").select(F.col("node_id").alias("at"), F.coalesce("block", F.lit(0).cast("long")).alias("block"), "label", "edges"))
        self.cells = self.dealt.rows()
        if many is not None:
            last = F.struct(F.element_at("edges", -1)["hi"].alias("hi"), "block")
            self.ends = cut(self.cells.join(F.broadcast(many.withColumnRenamed("src", "at")), "at").groupBy("at").agg(F.sort_array(F.collect_list(last)).alias("ends")))

    def _step(self, state: DataFrame, cells: DataFrame, seed: int, step: int, how: str) -> DataFrame:
        """state with the label of where it is and the edges that its draws meet, a row for each."""
        if self.ends is None:
            return _parted(state.join(cells.drop("block"), "at", how), "edges", seed, step)
        state = _parted(state.join(F.broadcast(self.ends), "at", "left"), "ends", seed, step)
        state = state.withColumn("block", F.coalesce("hit.block", F.lit(0).cast("long"))).drop("hit")
        return _parted(state.join(cells, ["at", "block"], how).drop("block"), "edges", seed, step)

    def go(self, starts: DataFrame, length: int, seed: int, paths: bool = True) -> DataFrame:
        """starts (start, draws) -> start, draws, path, or steps in its place if paths are not asked for; draws, an array that is not empty, tells a start's walks apart. A walk ends early at a node without edges.

        Walks of a start that have gone alike are one row, which parts where they part; so each path of a start is one row in the end.
        """
        parts, cells = self.dealt.parts, self.cells
        begun = F.array().cast("array<string>") if paths else F.lit(0)
        state = starts.select("start", "draws", F.col("start").alias("at"), begun.alias("done")).repartition(parts, "at")
        for step in range(length):
            met = self._step(state, cells, seed, step, "left" if step else "inner")
            if paths:
                pred = F.when(F.col("hit").isNotNull(), F.array("hit.pred")).otherwise(F.array().cast("array<string>"))
                done = F.when(F.col("label").isNotNull(), F.concat("done", F.array("label"), pred)).otherwise(F.col("done"))
            else:
                done = F.col("done") + F.col("hit").isNotNull().cast("int")
            over = -1 - F.pmod(F.xxhash64("start", F.element_at("draws", 1)), F.lit(1 << 20))  # no node; walks that have ended lie in all parts
            state = met.select("start", "draws", F.coalesce("hit.dst", over).alias("at"), done.alias("done"))
        if not length:
            state = state.join(self.graph.nodes.select(F.col("node_id").alias("at")), "at", "left_semi").select("start", "draws", "at", "done")
        if not paths:
            return state.select("start", "draws", F.col("done").alias("steps"))
        state = state.join(self.graph.nodes.withColumnRenamed("node_id", "at"), "at", "left")
        return state.select("start", "draws", F.when(F.col("label").isNotNull(), F.concat("done", F.array("label"))).otherwise(F.col("done")).alias("path"))

    def all(self, starts: DataFrame, length: int, seed: int, paths: bool = True, of: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
        """What `of` makes of go(), in slices of starts, each kept packed; the cells' table is gone afterwards."""
        n = slices(starts.agg(F.coalesce(F.sum(F.size("draws")), F.lit(0))).first()[0], DRAWS, SLICES)
        found = [packed(of(self.go(starts.where(slice_of("start", i, n)), length, seed, paths))) for i in range(n)]
        self.dealt.drop()
        swept(self.graph.nodes.sparkSession)
        return reduce(DataFrame.unionByName, found)


def _each(starts: DataFrame, per_start: int) -> DataFrame:
    """start, draws: so many walks from each start; no rows for none."""
    draws = F.sequence(F.lit(0), F.lit(per_start - 1)) if per_start > 0 else F.array().cast("array<int>")
    return starts.select(F.col("node_id").alias("start")).distinct().withColumn("draws", draws).where(F.size("draws") > 0)


def _one_by_one(found: DataFrame, name: str = "walk_no") -> DataFrame:
    return found.select("start", F.explode("draws").alias(name), "path")


def walks(graph: Graph, wedges: DataFrame, starts: DataFrame, per_start: int = WALKS, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """starts (node_id) -> start, walk_no, path: node, predicate, node ... labels, up to `length` steps; a walk ends early at a node without edges."""
    return _one_by_one(Walker(graph, wedges).all(packed(_each(starts, per_start)), length, seed))


def walk_paths(graph: Graph, wedges: DataFrame, starts: DataFrame, per_start: int = WALKS, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """walks() -> path, n: each path once, with the number of its walks. A path begins at its start, so that only a start's own walks have it, and these are not shuffled to be counted."""
    return Walker(graph, wedges).all(packed(_each(starts, per_start)), length, seed, of=lambda found: found.select("path", F.size("draws").cast("long").alias("n")))


def walk_sizes(graph: Graph, wedges: DataFrame, starts: DataFrame, per_start: int = WALKS, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """walks() -> start, tokens, n: how many walks of a start have so many tokens, without their paths."""
    sizes = lambda found: found.groupBy("start", (2 * F.col("steps") + 1).alias("tokens")).agg(F.sum(F.size("draws")).alias("n"))
    return Walker(graph, wedges).all(packed(_each(starts, per_start)), length, seed, False, sizes)


def walks_of_length(graph: Graph, wedges: DataFrame, starts: DataFrame, tokens: int, per_start: int = 1, attempts: int = 4, length: int = LENGTH, seed: int = SEED, strict: bool = True) -> DataFrame:
    """Walks of exactly `tokens` tokens: each the first of its draws that has them, however many that takes.

    A start from which no walk can have them raises if strict, and is left out else. Each walk is drawn once; those that are still open draw again, `attempts` times and then twice as often each time. Rounds only tell which draws have the length; paths are walked once, for these.
    """
    spark, steps = graph.nodes.sparkSession, (tokens - 1) // 2
    walker = Walker(graph, wedges)
    swept(spark)
    pairs = walker.cells.select(F.col("at").alias("src"), F.explode("edges.dst").alias("dst"))
    wanted = starts.select(F.col("node_id").alias("start")).distinct()
    if tokens % 2 == 0 or steps > length:
        can = graph.nodes.limit(0).select(F.col("node_id").alias("start"))
    else:
        can = graph.nodes.select(F.col("node_id").alias("start"))
        if steps < length:  # it must come to an end without edges in so many steps
            can = can.join(pairs.select(F.col("src").alias("start")), "start", "left_anti")
        for _ in range(steps):  # a node can if an edge leads to one that can with a step less
            can = pairs.join(can.withColumnRenamed("start", "dst"), "dst", "left_semi").select(F.col("src").alias("start")).distinct()
    can = cut(can)
    if strict and (bad := wanted.join(can, "start", "left_anti").first()) is not None:
        raise ValueError(f"no walk of that length from node {bad.start}")
    walk_no = F.col("draw") % per_start
    every = F.sequence(F.lit(0).cast("long"), F.lit(per_start - 1).cast("long"))
    open_, won, first, more = cut(wanted.join(can, "start", "left_semi").withColumn("open", every)), [], 0, 1
    while not open_.isEmpty():
        swept(spark)
        tries = open_.select("start", F.flatten(F.transform(F.sequence(F.lit(first), F.lit(first + more - 1)), lambda a: F.transform("open", lambda w: a * per_start + w))).alias("draws"))
        good = walker.go(tries, length, seed, paths=False).where(F.col("steps") * 2 + 1 == tokens).select("start", F.explode("draws").alias("draw"))
        least = good.groupBy("start", walk_no.alias("walk_no")).agg(F.min("draw").alias("draw"))
        won.append(cut(least.groupBy("start").agg(F.collect_list("draw").alias("draws"))))
        left = F.array_except("open", F.transform(F.coalesce("draws", F.array().cast("array<long>")), lambda d: d % per_start))
        open_ = cut(open_.join(won[-1], "start", "left").select("start", left.alias("open")).where(F.size("open") > 0))
        first, more = first + more, attempts if more == 1 and not first else more * 2
    swept(spark)
    rows = open_.select("start", F.col("open").alias("draws"))  # none are left
    for w in won:
        rows = rows.unionByName(w)
    rows = rows.groupBy("start").agg(F.flatten(F.collect_list("draws")).alias("draws"))
    return _one_by_one(walker.all(packed(rows), length, seed), "draw").select("start", walk_no.cast("int").alias("walk_no"), "path")


def walks_from_random(graph: Graph, wedges: DataFrame, n: int, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """n walks, each from a node drawn evenly; a node that is drawn twice has two walks."""
    starts = random_starts(graph, n, seed).groupBy(F.col("node_id").alias("start")).agg(F.collect_list("walk_no").alias("draws"))
    return _one_by_one(Walker(graph, wedges).all(packed(starts), length, seed))


def random_starts(graph: Graph, n: int, seed: int = SEED) -> DataFrame:
    """walk_no, node_id: n nodes drawn evenly with replacement."""
    size = graph.nodes.count()
    drawn = graph.nodes.sparkSession.range(n).withColumnRenamed("id", "walk_no")
    return drawn.withColumn("node_id", F.floor(uniform(F.lit(seed), F.lit("start"), "walk_no") * size).cast("long"))


def statistics(found: DataFrame, graph: Graph) -> DataFrame:
    """One row: starts, nodes, walks and their mean number of tokens (null without walks)."""
    return found.agg(F.countDistinct("start").alias("starts"), F.count("*").alias("walks"), F.avg(F.size("path")).alias("mean_tokens")).join(graph.nodes.agg(F.count("*").alias("nodes")))


def statistics_of_sizes(sizes: DataFrame, graph: Graph) -> DataFrame:
    """statistics() of walk_sizes()."""
    row = sizes.agg(F.countDistinct("start").alias("starts"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("walks"), (F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("mean_tokens"))
    return row.join(graph.nodes.agg(F.count("*").alias("nodes")))
