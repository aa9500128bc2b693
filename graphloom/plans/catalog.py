"""A query for each operator over the relational tables, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import murmur128_hex, murmur32_hex
from ..operators import colouring, cooccurrence, graph as g, order, roads, vectors, walk, weigh
from ..schema import OWL_THING, RDF_TYPE
from ..sources import ntriples, tables
from . import relational as r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WALKS, LENGTH, TOKENS = 50, 4, 9
SWEEP = [(0.5, 1e-3), (0.5, 1e-4), (0.5, 1e-5)]
#: Rounds of the recursive SQL; further rounds change nothing.
ROUNDS = {1e-3: 40, 1e-4: 60, 1e-5: 80}

PLACES = f"""
select 10000000000000 + n_nationkey as line_no, concat('<nation/', n_nationkey, '>') as s, '<inRegion>' as p, concat('<region/', n_regionkey, '>') as o from nation
union all select 20000000000000 + n_nationkey, concat('<region/', n_regionkey, '>'), '<hasNation>', concat('<nation/', n_nationkey, '>') from nation
union all select 30000000000000 + s_suppkey, concat('<supplier/', s_suppkey, '>'), '<inNation>', concat('<nation/', s_nationkey, '>') from supplier
union all select 40000000000000 + c_custkey, concat('<customer/', c_custkey, '>'), '<inNation>', concat('<nation/', c_nationkey, '>') from customer
union all select 50000000000000 + c_custkey, concat('<customer/', c_custkey, '>'), '{RDF_TYPE}', '{OWL_THING}' from customer
union all select 60000000000000 + c_custkey, concat('<customer/', c_custkey, '>'), '<segment>', concat('"', c_mktsegment, '"') from customer"""
TRADE = f"""{PLACES}
union all select 70000000000000 + o_orderkey, concat('<customer/', o_custkey, '>'), '<placed>', concat('<order/', o_orderkey, '>') from orders
union all select 80000000000000 + l_orderkey * 16 + l_linenumber, concat('<order/', l_orderkey, '>'), '<hasPart>', concat('<part/', l_partkey, '>') from lineitem
union all select 90000000000000 + l_orderkey * 16 + l_linenumber, concat('<part/', l_partkey, '>'), '<suppliedBy>', concat('<supplier/', l_suppkey, '>') from lineitem
union all select 100000000000000 + p_partkey, concat('<part/', p_partkey, '>'), '<brand>', concat('"', p_brand, '"') from part"""


def _graph_sql(kg: str, literals: bool = True) -> str:
    keep = "" if literals else "where not starts_with(o, '\"')"
    return f"""with recursive kg as ({kg}),
u as materialized (select s, p, o, min(line_no) as line_no from kg {keep} group by s, p, o),
nodes as materialized (select label, row_number() over (order by min(pos), label) - 1 as node_id from (select s as label, 2 * line_no as pos from u union all select o, 2 * line_no + 1 from u) group by label),
edges as materialized (select row_number() over (order by line_no, s, p, o) - 1 as edge_id, a.node_id as src, b.node_id as dst, p as pred from u join nodes a on u.s = a.label join nodes b on u.o = b.label),
preds as materialized (select pred, row_number() over (order by min(edge_id)) - 1 + (select count(*) from nodes) as pred_id from edges group by pred),
thing as (select node_id from nodes where label = '{OWL_THING}'),
entities as materialized (select distinct src as node_id from edges where pred = '{RDF_TYPE}' and dst in (select node_id from thing))"""


TRADE_SQL, PLACES_SQL = _graph_sql(TRADE), _graph_sql(PLACES, literals=False)


def _trade(spark: SparkSession, sf_dir: str) -> g.Graph:
    return g.build(r.trade(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str) -> g.Graph:
    return g.build(r.places(spark, sf_dir), literals=False)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- sources

#: By positions in the line, not by the engine's pattern: where the subject ends, where the predicate's brackets are, and what follows.
PARSE = """select line_no, s, p, case when starts_with(rest, '<') then substr(rest, 1, strpos(rest, '>')) when starts_with(rest, '_:') then split_part(rest, ' ', 1) else rtrim(rest, ' .') end as o
from (select line_no, s, substr(tail, strpos(tail, '<'), strpos(tail, '>') - strpos(tail, '<') + 1) as p, ltrim(substr(tail, strpos(tail, '>') + 1)) as rest
from (select line_no, case when starts_with(ltrim(value), '_:') then split_part(ltrim(value), ' ', 1) else substr(value, strpos(value, '<'), strpos(value, '>') - strpos(value, '<') + 1) end as s,
case when starts_with(ltrim(value), '_:') then substr(ltrim(value), strpos(ltrim(value), ' ')) else substr(value, strpos(value, '>') + 1) end as tail from lines where trim(value) <> '' and not starts_with(value, '#')))"""
LINES = f"with lines as (select line_no, concat(s, ' ', p, ' ', o, ' .') as value from ({TRADE}) union all select r_regionkey, concat('# ', r_name) from region union all select 100 + r_regionkey, '   ' from region union all select 200 + r_regionkey, concat(' _:b', r_regionkey, ' <near> _:c', r_regionkey, ' .') from region)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = r.table(spark, sf_dir, "region")
    notes = region.select(F.col("r_regionkey").cast("long").alias("line_no"), F.concat(F.lit("# "), "r_name").alias("value"))
    blank = region.select((F.col("r_regionkey") + 100).cast("long").alias("line_no"), F.lit("   ").alias("value"))
    key = F.col("r_regionkey").cast("string")
    nameless = F.concat(F.lit(" _:b"), key, F.lit(" <near> _:c"), key, F.lit(" ."))
    nodes = region.select((F.col("r_regionkey") + 200).cast("long").alias("line_no"), nameless.alias("value"))
    return r.lines(r.trade(spark, sf_dir)).unionByName(notes).unionByName(blank).unionByName(nodes)


@query(f"{LINES} {PARSE}")
def nt_parse(spark, sf_dir):
    return ntriples.parse(_lines(spark, sf_dir))


@query(f"{LINES} select * from ({PARSE}) where not starts_with(o, '\"')")
def nt_parse_no_literals(spark, sf_dir):
    return ntriples.without_literals(ntriples.parse(_lines(spark, sf_dir)))


@query(f"{LINES} select line_no from lines where regexp_matches(value, '\\S') and not starts_with(value, '#')")
def line_filter(spark, sf_dir):
    return _lines(spark, sf_dir).where(ntriples.is_statement(F.col("value"))).select("line_no")


@query("select c_custkey, regexp_replace(concat('\"', c_name, '. \"^^<string> . '), '[ .]+$', '') as literal from customer")
def literal_trim(spark, sf_dir):
    return r.table(spark, sf_dir, "customer").select("c_custkey", ntriples.trim_literal(F.concat(F.lit('"'), "c_name", F.lit('. "^^<string> . '))).alias("literal"))


RANK_LINES = "select p_partkey as line_no, concat('part/', p_partkey % 1000, chr(9), p_retailprice) as value from part union all select -r_regionkey - 1, concat('# ', r_name) from region union all select -100, ''"


@query(f"select concat('<', split_part(value, chr(9), 1), '>') as label, arg_max(cast(split_part(value, chr(9), 2) as double), line_no) as weight from ({RANK_LINES}) where value <> '' and not starts_with(value, '#') group by 1")
def rank_tsv_parse(spark, sf_dir):
    part, region = r.table(spark, sf_dir, "part"), r.table(spark, sf_dir, "region")
    rows = part.select(F.col("p_partkey").cast("long").alias("line_no"), F.concat(F.lit("part/"), (F.col("p_partkey") % 1000).cast("string"), F.lit("\t"), F.col("p_retailprice").cast("string")).alias("value"))
    rows = rows.unionByName(region.select((-F.col("r_regionkey") - 1).cast("long").alias("line_no"), F.concat(F.lit("# "), "r_name").alias("value"))).unionByName(spark.range(1).select(F.lit(-100).cast("long").alias("line_no"), F.lit("").alias("value")))
    return tables.parse_ranks(rows)


# --- graph


@query(f"{TRADE_SQL} select node_id, label from nodes")
def node_ids(spark, sf_dir):
    return g.encode_nodes(r.trade(spark, sf_dir))


@query(f"{TRADE_SQL} select s, p, o, line_no from u")
def dedupe_triples(spark, sf_dir):
    return g.dedupe(r.trade(spark, sf_dir))


@query(f"{TRADE_SQL} select edge_id, src, dst, pred from edges")
def graph_edges(spark, sf_dir):
    return _trade(spark, sf_dir).edges


@query(f"{_graph_sql(TRADE, False)} select edge_id, src, dst, pred from edges")
def graph_edges_no_literals(spark, sf_dir):
    return g.build(r.trade(spark, sf_dir), literals=False).edges


@query(f"{TRADE_SQL} select pred, pred_id from preds")
def predicate_ids(spark, sf_dir):
    return g.predicate_ids(_trade(spark, sf_dir))


@query(f"{TRADE_SQL} select pred, dst, row_number() over (order by src, edge_id) as pair_id from (select pred, dst, arg_min(edge_id, src * 1000000000000 + edge_id) as edge_id, min(src) as src from edges group by pred, dst)")
def pred_obj_ids(spark, sf_dir):
    return g.predicate_object_ids(_trade(spark, sf_dir).edges)


@query(f"{TRADE_SQL} select edge_id, dst as src, src as dst, pred from edges")
def reverse_graph(spark, sf_dir):
    return g.reverse(_trade(spark, sf_dir).edges)


PRUNED = "select edge_id, src, dst, pred from edges semi join (select distinct src as alive from edges) on dst = alive"


@query(f"{TRADE_SQL} {PRUNED}")
def prune_leaves(spark, sf_dir):
    return g.prune_leaves(_trade(spark, sf_dir)).edges


@query(f"{TRADE_SQL} select node_id from entities")
def entities(spark, sf_dir):
    return g.entities(_trade(spark, sf_dir))


@query(f"{_graph_sql(TRADE, False)}, pruned as ({PRUNED}) select node_id, coalesce(n, 0) as degree from entities left join (select src, count(*) as n from pruned group by src) on src = node_id")
def walk_starts_pruned(spark, sf_dir):
    pruned, starts = g.walk_graph(r.trade(spark, sf_dir))
    degree = g.counts(pruned.edges, "src").select(F.col("src").alias("node_id"), "n")
    return starts.join(degree, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("degree"))


@query(f"{_graph_sql(TRADE, False)} select node_id + 1 as word_id, label from nodes union all select pred_id + 1, pred from preds")
def vocab(spark, sf_dir):
    return g.vocabulary(g.build(r.trade(spark, sf_dir), literals=False))


@query(f"{_graph_sql(TRADE, False)} select node_id + 1 as word_id, label from nodes")
def vocab_nodes(spark, sf_dir):
    return g.vocabulary(g.build(r.trade(spark, sf_dir), literals=False), predicates=False)


HREFS = r"""select page_id * 100000 + i - 1 as line_no, concat('<page/', page_id, '>') as s, '<linksTo>' as p, concat('<url/', hrefs[i], '>') as o
from (select page_id, hrefs, unnest(range(1, len(hrefs) + 1)) as i from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as hrefs from pages))"""


@query(f"with kg as ({HREFS}) select o, count(distinct s) as in_degree from kg group by o")
def page_links(spark, sf_dir):
    return g.counts(g.dedupe(r.links(spark, sf_dir)), "o").withColumnRenamed("n", "in_degree")


for _name, _by in (("freq_predicate", ("pred",)), ("freq_object", ("dst",)), ("freq_pred_obj", ("pred", "dst"))):
    query(f"{TRADE_SQL} select {', '.join(_by)}, count(*) as n, 1.0::double / count(*) as inverse from edges group by {', '.join(_by)}", _name)(lambda spark, sf_dir, by=_by: g.counts(_trade(spark, sf_dir).edges, *by).withColumn("inverse", F.lit(1.0) / F.col("n")))

# --- weights

RANKS = ", ranks as materialized (select concat('<part/', p_partkey, '>') as label, max(p_retailprice) as weight from part group by 1), er as materialized (select e.*, r.weight as rank from edges e join nodes n on e.dst = n.node_id left join ranks r on n.label = r.label)"
over = "count(*) over (partition by {})::double".format
RAW = {1: "1.0::double", 2: over("pred"), 3: "1 / " + over("pred"), 4: over("dst"), 5: "1 / " + over("dst"), 6: over("pred, dst"), 7: "1 / " + over("pred, dst"), 8: "coalesce(rank, 0.2::double)", 9: "coalesce(1 / rank, 0.2::double)", 10: "coalesce(rank, 0.2::double) / " + over("dst"), 11: "coalesce(1 / rank, 0.2::double) / " + over("dst"), 12: f"1 / ({over('dst')} * {over('dst')})"}


def weights_sql(strategy: int) -> str:
    return f"{RANKS}, raw as (select edge_id, src, dst, pred, {RAW[strategy]} as raw from er), wedges as materialized (select edge_id, src, dst, pred, raw / sum(raw) over (partition by src) as weight from raw)"


def _weigh(spark, sf_dir, strategy: int) -> DataFrame:
    return weigh.weigh(_trade(spark, sf_dir), strategy, r.part_ranks(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


for _i, (_label, _) in weigh.STRATEGIES.items():
    query(f"{TRADE_SQL} {weights_sql(_i)} select edge_id, src, dst, pred, round(weight, 9) as weight from wedges", f"weigh_{_i:02d}_{_label}")(lambda spark, sf_dir, i=_i: _weigh(spark, sf_dir, i))

# --- walks

CELLS = ", cum as (select *, sum(weight) over (partition by src order by edge_id rows unbounded preceding) as top, lead(edge_id) over (partition by src order by edge_id) as later from wedges), cells as materialized (select *, coalesce(lag(case when later is null then greatest(1.0, top) else top end) over (partition by src order by edge_id), 0.0) as lo, case when later is null then greatest(1.0, top) else top end as hi from cum)"


def walks_sql(per_start: int, starts: str = "entities") -> str:
    return f", st0 as (select node_id as start, w.walk_no, node_id as at, [label] as path from {starts} join nodes using (node_id), (select unnest(range({per_start})) as walk_no) w){walk_steps_sql()}"


def walk_steps_sql() -> str:
    """CTEs from st0 (start, walk_no, at, path) to walks."""
    out, draw = "", f"(('0x' || substr(md5(concat_ws('|', {walk.SEED}, start, walk_no, {{}})), 1, 8))::ubigint)::double / 4294967296.0"
    for k in range(LENGTH):
        out += f", st{k + 1} as materialized (select w.start, w.walk_no, coalesce(c.dst, w.at) as at, case when c.dst is null then w.path else list_concat(w.path, [c.pred, n.label]) end as path from (select *, {draw.format(k)} as u from st{k}) w left join cells c on w.at = c.src and w.u >= c.lo and w.u < c.hi left join nodes n on c.dst = n.node_id)"
    return out + f", walks as (select start, walk_no, path from st{LENGTH})"


def _walks(spark, sf_dir, strategy: int, per_start: int = WALKS) -> tuple[g.Graph, DataFrame, DataFrame]:
    graph = g.build(r.trade(spark, sf_dir), literals=False)
    wedges = weigh.weigh(graph, strategy, r.part_ranks(spark, sf_dir))
    return graph, wedges, g.entities(graph)


def _walk_sql(strategy: int, per_start: int = WALKS) -> str:
    return f"{_graph_sql(TRADE, False)} {weights_sql(strategy)} {CELLS} {walks_sql(per_start)}"


@query(f"{_graph_sql(TRADE, False)} {weights_sql(3)} {CELLS} select edge_id, round(lo, 9) as lo, round(hi, 9) as hi from cells")
def walk_cdf(spark, sf_dir):
    return walk.intervals(_walks(spark, sf_dir, 3)[1]).select("edge_id", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def _statements(spark, sf_dir) -> DataFrame:
    return ntriples.without_literals(r.trade(spark, sf_dir))


def _path(df: DataFrame) -> DataFrame:
    return df.select("start", "walk_no", F.array_join("path", " ").alias("walk"))


for _name, _i in (("walk_uniform", 1), ("walk_rank_biased", 10)):
    query(f"{_walk_sql(_i)} select start, walk_no, array_to_string(path, ' ') as walk from walks", _name)(lambda spark, sf_dir, i=_i: roads.walks(_statements(spark, sf_dir), i, r.part_ranks(spark, sf_dir), WALKS, LENGTH).withColumnRenamed("text", "walk"))


#: A row is a walk's draw at a step; one that ends early begins its next draw, and none goes on once it has the length.
RETRIED = f"""{_graph_sql(TRADE, False)} {weights_sql(1)} {CELLS}, w as (
select node_id as start, k.walk_no, 0 as attempt, 0 as step, node_id as at, [label] as path from entities join nodes using (node_id), (select unnest(range({WALKS})) as walk_no) k
union all
select d.start, d.walk_no, case when c.dst is null then d.attempt + 1 else d.attempt end, case when c.dst is null then 0 else d.step + 1 end, coalesce(c.dst, d.start), case when c.dst is null then [d.path[1]] else list_concat(d.path, [c.pred, n.label]) end
from (select *, (('0x' || substr(md5(concat_ws('|', {walk.SEED}, start, attempt * {WALKS} + walk_no, step)), 1, 8))::ubigint)::double / 4294967296.0 as u from w where step < {LENGTH}) d
left join cells c on d.at = c.src and d.u >= c.lo and d.u < c.hi left join nodes n on c.dst = n.node_id where d.attempt < 100)
select start, walk_no, array_to_string(path, ' ') as walk from w where step = {LENGTH}"""


@query(RETRIED)
def walk_length_enforced(spark, sf_dir):
    return roads.walks_of_length(_statements(spark, sf_dir), TOKENS, WALKS, length=LENGTH).withColumnRenamed("text", "walk")


@query(f"{_walk_sql(1)} select count(distinct start) as starts, count(*) as walks, round(avg(len(path)), 6) as mean_tokens, (select count(*) from nodes) as nodes from walks")
def walk_stats(spark, sf_dir):
    graph, wedges, starts = _walks(spark, sf_dir, 1)
    return walk.statistics_of_sizes(walk.walk_sizes(graph, wedges, starts, WALKS, LENGTH), graph).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(f"{_walk_sql(1, walk.WALKS)} select array_to_string(path, ' ') as value, count(*) as n from walks group by 1")
def walk_text(spark, sf_dir):
    """All the walks of the workload, walk.WALKS from each start."""
    return roads.paths(_statements(spark, sf_dir), per_start=walk.WALKS, length=LENGTH).select(F.col("text").alias("value"), "n")


@query(f"{_graph_sql(TRADE, False)} select walk_no, floor((('0x' || substr(md5(concat_ws('|', {walk.SEED}, 'start', walk_no)), 1, 8))::ubigint)::double / 4294967296.0 * (select count(*) from nodes))::bigint as node_id from (select unnest(range(10000)) as walk_no)")
def walk_random_starts(spark, sf_dir):
    return walk.random_starts(g.build(r.trade(spark, sf_dir), literals=False), 10_000)


RANDOM = f", st0 as (select node_id as start, walk_no, node_id as at, [label] as path from (select walk_no, floor((('0x' || substr(md5(concat_ws('|', {walk.SEED}, 'start', walk_no)), 1, 8))::ubigint)::double / 4294967296.0 * (select count(*) from nodes))::bigint as node_id from (select unnest(range(10000)) as walk_no)) join nodes using (node_id))"


@query(f"{_graph_sql(TRADE, False)} {weights_sql(1)} {CELLS} {RANDOM} {walk_steps_sql()} select start, walk_no, array_to_string(path, ' ') as walk from walks")
def walk_from_random(spark, sf_dir):
    graph, wedges, _ = _walks(spark, sf_dir, 1)
    return _path(walk.walks_from_random(graph, wedges, 10_000, LENGTH))


# --- colouring

UNIFORM = ", wedges as materialized (select *, 1.0::double / count(*) over (partition by src) as weight from edges)"


def colour_sql(alpha: float, epsilon: float, name: str = "", edges: str = "wedges", seeds: str = "nodes", predicates: bool = True) -> str:
    """CTEs: paint{name} and bcv{name} (seed, key, val)."""
    rounds = ROUNDS[epsilon]
    deposit = f"select seed, node as key, {alpha} * paint as val from paint{name} where paint >= {epsilon} or round = {rounds}"
    if predicates:
        deposit += f" union all select seed, pred_id, {1 - alpha} * paint * weight from paint{name} join {edges} e on node = e.src and paint >= {epsilon} join preds using (pred) where round < {rounds}"
    return f""", paint{name} as (
select 0 as round, node_id as seed, node_id as node, 1.0::double as paint from {seeds}
union all
select round + 1, seed, node, sum(paint) from (
select t.round, t.seed, coalesce(e.dst, t.node) as node, case when e.dst is null then t.paint else {1 - alpha} * t.paint * e.weight end as paint
from paint{name} t left join {edges} e on t.node = e.src and t.paint >= {epsilon} where t.round < {rounds} and (e.dst is not null or t.paint < {epsilon})
) group by round, seed, node),
bcv{name} as materialized (select seed, key, sum(val) as val from ({deposit}) group by seed, key)"""


#: Sums of halves often end on a tie of the sixth digit, which engines round by their last bit; this much puts them past it.
PAST_TIE = 1.7e-8
ROUND6 = f"round(val + {PAST_TIE}, 6) as val"


def _round(df: DataFrame, column: str = "val") -> DataFrame:
    return df.withColumn(column, F.round(F.col(column) + PAST_TIE, 6))


def _coloured(spark, sf_dir, predicates: bool = True) -> tuple[g.Graph, DataFrame]:
    graph = _places(spark, sf_dir)
    seeds = graph.nodes.select(F.col("node_id").alias("seed"))
    return graph, colouring.colour(weigh.weigh(graph), seeds, predicates=g.predicate_ids(graph) if predicates else None)


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3, predicates=False)} select seed, key, {ROUND6} from bcv")
def bca_nodes(spark, sf_dir):
    return _round(_coloured(spark, sf_dir, False)[1])


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3)} select seed, key, {ROUND6} from bcv")
def bca_edges(spark, sf_dir):
    return _round(_coloured(spark, sf_dir)[1])


def pushed_sql(alpha: float, epsilon: float, seeds: str = "nodes") -> str:
    """CTE: pushed (seed, edge_id, dst, pred, val)."""
    return f""", paint as (
select 0 as round, node_id as seed, node_id as node, 1.0::double as paint from {seeds}
union all
select t.round + 1, t.seed, e.dst, sum({1 - alpha} * t.paint * e.weight) from paint t join wedges e on t.node = e.src where t.round < 100 group by t.round, t.seed, e.dst having sum({1 - alpha} * t.paint * e.weight) > {epsilon}),
pushed as (select seed, edge_id, dst, pred, sum({alpha} * paint * weight) as val from paint join wedges on node = src where round < 100 group by seed, edge_id, dst, pred)"""


@query(f"{PLACES_SQL} {UNIFORM} {pushed_sql(0.5, 1e-3)} select seed, edge_id, dst, {ROUND6} from pushed")
def bca_pushed(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return _round(colouring.colour_pushed(weigh.weigh(graph), graph.nodes.select(F.col("node_id").alias("seed"))))


@query()
def bca_exact(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return colouring.colour_exact(weigh.weigh(graph), graph.nodes.select(F.col("node_id").alias("seed")), predicates=g.predicate_ids(graph))


@query()
def bca_cached(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return colouring.colour_cached(weigh.weigh(graph), order.order(graph.nodes, graph.edges), predicates=g.predicate_ids(graph))


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3)} select seed, key, round(val / sum(val) over (partition by seed) + {PAST_TIE}, 6) as val from bcv")
def bcv_normalize(spark, sf_dir):
    return _round(vectors.normalise(_coloured(spark, sf_dir)[1]))


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3)} select seed, key, {ROUND6} from bcv where seed <> key")
def bcv_remove_self(spark, sf_dir):
    return _round(vectors.remove_self(_coloured(spark, sf_dir)[1]))


BACK = ", back as materialized (select edge_id, dst as src, src as dst, pred, 1.0::double / count(*) over (partition by dst) as weight from edges)"
BOTH = f"{UNIFORM} {BACK} {colour_sql(0.5, 1e-3, 'f')} {colour_sql(0.5, 1e-3, 'b', 'back', predicates=False)}, bcv as (select seed, key, sum(val) as val from (select * from bcvf union all select * from bcvb) group by seed, key)"


@query(f"{PLACES_SQL} {BOTH} select seed, key, {ROUND6} from bcv")
def bcv_add(spark, sf_dir):
    graph = _places(spark, sf_dir)
    seeds, back = graph.nodes.select(F.col("node_id").alias("seed")), g.Graph(graph.nodes, g.reverse(graph.edges))
    return _round(vectors.add(colouring.colour(weigh.weigh(graph), seeds, predicates=g.predicate_ids(graph)), colouring.colour(weigh.weigh(back), seeds)))


ENTRY = "printf('%.6f', round(val + 1.7e-8, 6))"


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3, predicates=False)} select seed, '{{' || string_agg(label || ' = ' || {ENTRY}, ', ' order by key) || '}}' as text from bcv join nodes on key = node_id group by seed")
def bcv_text(spark, sf_dir):
    graph, v = _coloured(spark, sf_dir, False)
    return vectors.render(_round(v), graph.nodes.select(F.col("node_id").alias("key"), "label"))


# --- order


#: Rounds of the order in SQL; the graph of places needs three.
LEVELS = 6


def levels_sql() -> str:
    """CTEs: levels (node_id, level) and simple (src, dst)."""
    out = ", simple as materialized (select distinct src, dst from edges where src <> dst), w0 as (select node_id from nodes), l0 as (select src, dst from simple)"
    for k in range(LEVELS):
        out += f""", e{k} as materialized (select node_id from w{k} where node_id not in (select src from l{k})),
n{k} as materialized (select node_id, coalesce(n, 0) as n from (select src as node_id from l{k} union select dst from l{k}) left join (select dst as node_id, count(*) as n from l{k} group by dst) using (node_id)),
b{k} as (select src as a, dst as b from l{k} union all select dst, src from l{k}),
m{k} as materialized (select node_id from n{k} anti join (select a as node_id from b{k} join n{k} x on a = x.node_id join n{k} y on b = y.node_id where y.n > x.n or (y.n = x.n and b < a)) using (node_id)),
t{k} as materialized (select node_id from e{k} union all select node_id from m{k} where not exists (select 1 from e{k})),
w{k + 1} as materialized (select node_id from w{k} anti join t{k} using (node_id)),
l{k + 1} as materialized (select src, dst from l{k} where src not in (select node_id from t{k}) and dst not in (select node_id from t{k}))"""
    return out + ", levels as (" + " union all ".join(f"select node_id, {k} as level from t{k}" for k in range(LEVELS)) + ")"


@query(f"{PLACES_SQL} {levels_sql()} select node_id, level from levels")
def order_levels(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return order.levels(graph.nodes, graph.edges)


@query(f"{PLACES_SQL} {levels_sql()}, placed as materialized (select node_id, row_number() over (order by level, node_id) as pos from levels) select (select count(*) from placed) as n, (select count(*) from placed) = (select count(*) from nodes) as is_permutation, count(*) as n_ahead from simple join placed s on src = s.node_id join placed d on dst = d.node_id where d.pos > s.pos")
def order_check(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return order.check(order.order(graph.nodes, graph.edges), graph.edges)


# --- matrices


def cooc_sql(source: str = "bcv", columns: str = "") -> str:
    return f"select seed + 1 as word1, key + 1 as word2, round(val / sum(val) over (partition by seed) + {PAST_TIE}, 6) as val{columns} from {source} where seed <> key"


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3)} {cooc_sql()}")
def cooc_edges(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return _round(cooccurrence.frequencies(graph, weigh.weigh(graph)))


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3, predicates=False)} {cooc_sql()}")
def cooc_nodes(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return _round(cooccurrence.frequencies(graph, weigh.weigh(graph), edges=False))


@query(f"{PLACES_SQL} {BOTH} {cooc_sql()}")
def cooc_forward_backward(spark, sf_dir):
    return _round(cooccurrence.frequencies_both_ways(_places(spark, sf_dir)))


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3, seeds='entities')} {cooc_sql()}")
def cooc_entities(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return _round(cooccurrence.frequencies(graph, weigh.weigh(graph), only_entities=True))


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3)} select seed + 1 as word1, key + 1 as word2, {ROUND6} from bcv")
def cooc_raw(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return _round(cooccurrence.frequencies(graph, weigh.weigh(graph), normalise=False))


@query(f"{PLACES_SQL} {UNIFORM}" + "".join(colour_sql(a, e, str(i)) for i, (a, e) in enumerate(SWEEP)) + " " + " union all ".join(cooc_sql(f"bcv{i}", f", {a}::double as alpha, {e}::double as epsilon") for i, (a, e) in enumerate(SWEEP)))
def cooc_sweep(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return _round(cooccurrence.sweep(graph, weigh.weigh(graph), SWEEP))


PAIRS = "pairs as (select pred, dst, row_number() over (order by src, edge_id) as pair_id from (select pred, dst, arg_min(edge_id, src * 1000000000000 + edge_id) as edge_id, min(src) as src from edges group by pred, dst))"
RESOURCES = ", resources as (select node_id from nodes where starts_with(label, '<'))"


@query(f"{PLACES_SQL} {UNIFORM} {RESOURCES} {pushed_sql(0.1, 1e-3, 'resources')}, {PAIRS} select seed + 1 as word1, pair_id + (select count(*) from nodes) as word2, round(sum(val) + {PAST_TIE}, 6) as val from pushed join pairs using (pred, dst) group by seed, pair_id")
def cooc_pushed(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return _round(cooccurrence.frequencies_pushed(graph, weigh.weigh(graph), epsilon=1e-3))


@query(f"{PLACES_SQL} {UNIFORM} {colour_sql(0.5, 1e-3)}, m as ({cooc_sql()}) select * from m union all select word2, word1, val from m where word2 >= (select count(*) from nodes) + 1")
def pred_transpose(spark, sf_dir):
    graph = _places(spark, sf_dir)
    return cooccurrence.transpose_predicates(_round(cooccurrence.frequencies(graph, weigh.weigh(graph))), graph.nodes.count() + 1)


@query()
def cooc_cached(spark, sf_dir):
    """By the order of levels; equal to bca_cached's vectors, normalised."""
    graph = _places(spark, sf_dir)
    return cooccurrence.frequencies_cached(graph, weigh.weigh(graph), order.order(graph.nodes, graph.edges))


@query(f"{PLACES_SQL} {UNIFORM} {pushed_sql(0.5, 1e-3)} select seed, '{{' || string_agg('(' || pred || ',' || label || ') = ' || {ENTRY}, ', ' order by dst, pred) || '}}' as text from (select seed, pred, dst, sum(val) as val from pushed group by seed, pred, dst) join nodes on dst = node_id group by seed")
def bcv_pair_text(spark, sf_dir):
    graph = _places(spark, sf_dir)
    pushed = colouring.colour_pushed(weigh.weigh(graph), graph.nodes.select(F.col("node_id").alias("seed")))
    named = pushed.join(graph.edges.select("edge_id", "pred"), "edge_id").groupBy("seed", "pred", "dst").agg(F.sum("val").alias("val"))
    return vectors.render_pairs(_round(named), graph.nodes)


@query()
def murmur32(spark, sf_dir):
    labels = g.encode_nodes(r.places(spark, sf_dir))
    return labels.select("label", murmur32_hex("label").alias("digest"))


@query()
def murmur128(spark, sf_dir):
    labels = g.encode_nodes(r.places(spark, sf_dir))
    return labels.select("label", murmur128_hex("label").alias("digest"))

