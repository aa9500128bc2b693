"""Goldens of small graphs, and invariants."""

import hashlib
import struct
import time
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from graphloom.functions import hashing
from graphloom.functions.progress import counted
from graphloom.functions.queue import PaintQueue
from graphloom.operators import colouring, cooccurrence, graph as g, order, vectors, walk, weigh
from graphloom.schema import OWL_THING, RDF_TYPE
from graphloom import session
from graphloom.session import cut
from graphloom.sources import crec, ntriples, tables

TWO = ["<A> <beta> <B> .", "<A> <gamma> <B>.", "<B> <delta> <C> ."]
FOUR = [*TWO, "<C> <beta> <A> .", "<C> <beta> <D> ."]
EIGHT = [*FOUR, "", *[f"<{x}> {RDF_TYPE} {OWL_THING} ." for x in "ABCD"]]
LITERALS = [*TWO, '<A> <beta> "jeee" .', '<A> <beta> "12.3"^<xsd:string> .']


def statements(spark, lines, mode="FAILFAST"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, value string")
    return ntriples.parse(rows, mode=mode)


def built(spark, lines, literals=False):
    return g.build(statements(spark, lines), literals)


@pytest.fixture(scope="module")
def eight(spark):
    graph = built(spark, EIGHT)
    return g.Graph(graph.nodes.cache(), graph.edges.cache())


def labels(graph):
    return [r.label for r in graph.nodes.orderBy("node_id").collect()]


def by_label(graph, v):
    names = {r.node_id: r.label[1:-1] for r in graph.nodes.collect()} | {r.pred_id: "p:" + r.pred[1:-1].split("#")[-1] for r in g.predicate_ids(graph).collect()}
    out = {}
    for r in v.collect():
        out.setdefault(names[r.seed], {})[names[r.key].split("#")[-1]] = round(r.val, 6)
    return out


@pytest.mark.parametrize(("lines", "literals", "nodes", "edges"), [([TWO[0]], False, "A B", 1), (TWO, False, "A B C", 3), (FOUR, False, "A B C D", 5), ([*FOUR, "", *TWO], False, "A B C D", 5), (LITERALS, False, "A B C", 3)])
def test_parse_and_number(spark, lines, literals, nodes, edges):
    graph = built(spark, lines, literals)
    assert labels(graph) == [f"<{x}>" for x in nodes.split()] and graph.edges.count() == edges
    assert [r.edge_id for r in graph.edges.orderBy("edge_id").collect()] == list(range(edges))


def test_literals_keep_what_is_inside(spark):
    graph = built(spark, LITERALS, True)
    assert labels(graph)[3:] == ['"jeee"', '"12.3"^<xsd:string>'] and graph.edges.count() == 5


def test_a_subject_of_literals_only_has_no_node(spark):
    assert labels(built(spark, ['<Z> <p> "x" .', "<A> <p> <B> ."])) == ["<A>", "<B>"]


def test_odd_lines(spark):
    lines = ["# note", "   ", "_:b1 <p> _:b2 .", '<A>\t<p>\t"x"@en .', "<A> <p> <A> .", '<A> <q> "1"^^<int> .']
    rows = {(r.s, r.p, r.o) for r in statements(spark, lines).collect()}
    assert rows == {("_:b1", "<p>", "_:b2"), ("<A>", "<p>", '"x"@en'), ("<A>", "<p>", "<A>"), ("<A>", "<q>", '"1"^^<int>')}
    bad = ["<A> <p> what .", "<A> <p> <B> ."]
    assert statements(spark, bad, "DROPMALFORMED").count() == 1
    assert [r._corrupt for r in statements(spark, bad, "PERMISSIVE").orderBy("line_no").collect()] == ["<A> <p> what .", None]
    with pytest.raises(Exception, match="malformed statement"):
        statements(spark, bad).collect()
    assert built(spark, ["# only a note"]).edges.count() == 0


def test_read_files_in_order(spark, tmp_path):
    (tmp_path / "a.nt").write_text("\n".join(TWO))
    (tmp_path / "b.nt").write_text("\n".join(FOUR[3:]) + "\n")
    rows = ntriples.read(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(5)) and [r.p for r in rows][:3] == ["<beta>", "<gamma>", "<delta>"] and rows[4].o == "<D>"


def test_transforms(spark, eight):
    assert sorted(r.node_id for r in g.entities(eight).collect()) == [0, 1, 2, 3]
    assert [(r.pred.split("#")[-1], r.pred_id) for r in g.predicate_ids(eight).orderBy("pred_id").collect()] == [("<beta>", 5), ("<gamma>", 6), ("<delta>", 7), ("type>", 8)]
    pruned = g.prune_leaves(eight)
    assert pruned.nodes.count() == 4 and {r.edge_id for r in pruned.edges.collect()} == {0, 1, 2, 3, 4}
    assert {(r.edge_id, r.src, r.dst) for r in g.reverse(eight.edges).collect()} == {(r.edge_id, r.dst, r.src) for r in eight.edges.collect()}
    assert [r.pair_id for r in g.predicate_object_ids(eight.edges).orderBy("pair_id").collect()] == list(range(1, 7))
    assert g.vocabulary(eight).count() == 9 and g.vocabulary(eight, False).count() == 5


WEIGHTS = {
    1: (0.333333, 0.333333, 0.5, 0.333333, 0.333333, 0.333333, 0.5, 0.333333, 1), 2: (0.375, 0.125, 0.2, 0.3, 0.3, 0.5, 0.8, 0.4, 1), 3: (0.210526, 0.631579, 0.8, 0.363636, 0.363636, 0.157895, 0.2, 0.272727, 1),
    4: (0.25, 0.25, 0.2, 0.166667, 0.166667, 0.5, 0.8, 0.666667, 1), 5: (0.4, 0.4, 0.8, 0.444444, 0.444444, 0.2, 0.2, 0.111111, 1), 6: (0.166667, 0.166667, 0.2, 0.166667, 0.166667, 0.666667, 0.8, 0.666667, 1),
    7: (0.444444, 0.444444, 0.8, 0.444444, 0.444444, 0.111111, 0.2, 0.111111, 1), 8: (0.333333, 0.333333, 0.6, 0.555556, 0.222222, 0.333333, 0.4, 0.222222, 1), 9: (0.333333, 0.333333, 0.943396, 0.833333, 0.083333, 0.333333, 0.056604, 0.083333, 1),
    10: (0.4, 0.4, 0.857143, 0.666667, 0.266667, 0.2, 0.142857, 0.066667, 1), 11: (0.4, 0.4, 0.985222, 0.888889, 0.088889, 0.2, 0.014778, 0.022222, 1), 12: (0.444444, 0.444444, 0.941176, 0.484848, 0.484848, 0.111111, 0.058824, 0.030303, 1),
}
RANK_LINES = ["# ranks", "", "A\t0.9", "A\t0.5", "C\t0.3", "Z\t0.5"]


@pytest.fixture(scope="module")
def ranks(spark):
    return tables.parse_ranks(spark.createDataFrame(list(enumerate(RANK_LINES)), "line_no long, value string"))


@pytest.mark.parametrize("strategy", sorted(WEIGHTS))
def test_weights(eight, ranks, strategy):
    rows = weigh.weigh(eight, strategy, ranks).orderBy("edge_id").collect()
    assert [r.weight for r in rows] == pytest.approx(WEIGHTS[strategy], abs=2e-6)


def test_weights_raise(spark, eight, ranks):
    with pytest.raises(ValueError, match="no strategy"):
        weigh.weigh(eight, 13)
    with pytest.raises(ValueError, match="needs ranks"):
        weigh.weigh(eight, 8)
    with pytest.raises(Exception, match="no rank for"):
        weigh.weigh(eight, 8, ranks, None).collect()
    with pytest.raises(Exception, match="no inverse"):
        weigh.weigh(eight, 9, spark.createDataFrame([("<A>", 0.0)], "label string, weight double")).collect()


COLOURED = {
    "two": (TWO, {"A": {"A": 0.5, "B": 0.25, "C": 0.125, "p:beta": 0.25, "p:gamma": 0.25, "p:delta": 0.25}, "B": {"B": 0.5, "C": 0.25, "p:delta": 0.5}, "C": {"C": 0.5}}),
    "four": (FOUR, {"A": {"A": 0.533203, "B": 0.266602, "C": 0.133301, "D": 0.033203, "p:beta": 0.399414, "p:gamma": 0.266602, "p:delta": 0.266602}, "B": {"B": 0.533203, "C": 0.266602, "A": 0.06665, "D": 0.06665, "p:delta": 0.533203, "p:beta": 0.299805, "p:gamma": 0.033203}, "D": {"D": 0.5}}),
    "eight": (EIGHT, {"B": {"B": 0.506944, "Thing": 0.161748, "C": 0.126736, "A": 0.021123, "D": 0.021123, "p:delta": 0.253472, "p:type": 0.323495, "p:beta": 0.091435, "p:gamma": 0.006944}, "D": {"D": 0.5, "Thing": 0.25, "p:type": 0.5}}),
}


def named(found):
    return {s: {k.replace("http://www.w3.org/2002/07/owl#", ""): x for k, x in v.items()} for s, v in found.items()}


@pytest.mark.parametrize("case", sorted(COLOURED))
@pytest.mark.parametrize("form", [colouring.colour, colouring.colour_exact])
def test_colouring(spark, case, form):
    lines, want = COLOURED[case]
    graph = built(spark, lines)
    found = named(by_label(graph, form(weigh.weigh(graph), graph.nodes.select(F.col("node_id").alias("seed")), predicates=g.predicate_ids(graph))))
    for seed, v in want.items():
        assert found[seed] == pytest.approx(v, abs=2e-6)


def test_colouring_at_its_ends(spark):
    graph = built(spark, FOUR)
    seeds = graph.nodes.select(F.col("node_id").alias("seed"))
    assert {(r.seed, r.key, r.val) for r in colouring.colour(weigh.weigh(graph), seeds, epsilon=1.5).collect()} == {(i, i, 0.5) for i in range(4)}
    v = colouring.colour(weigh.weigh(graph), seeds)
    assert all(r.t <= 1 + 1e-9 for r in v.groupBy("seed").agg(F.sum("val").alias("t")).collect())
    cached = by_label(graph, colouring.colour_cached(weigh.weigh(graph), order.order(graph.nodes, graph.edges)))
    plain = by_label(graph, v)
    assert all(abs(cached[s].get(k, 0) - x) < 5e-4 for s, own in plain.items() for k, x in own.items())
    with pytest.raises(ValueError, match="edges are more"):
        colouring.colour_exact(weigh.weigh(graph), seeds, most_edges=2)


def test_pushed_colouring(spark):
    graph = built(spark, TWO)
    rows = colouring.colour_pushed(weigh.weigh(graph), spark.createDataFrame([(0,)], "seed long")).collect()
    assert {(r.edge_id, r.dst, r.val) for r in rows} == {(0, 1, 0.25), (1, 1, 0.25), (2, 2, 0.25)}


def test_matrices(spark, eight):
    graph = built(spark, TWO)
    of = lambda m: {(r.word1, r.word2): round(r.val, 6) for r in m.collect()}
    m = cooccurrence.frequencies(graph, weigh.weigh(graph))
    want = {(1, 2): 0.222222, (1, 3): 0.111111, (1, 4): 0.222222, (1, 5): 0.222222, (1, 6): 0.222222, (2, 3): 0.333333, (2, 6): 0.666667}
    assert of(m) == want
    assert of(cooccurrence.transpose_predicates(m, 4)) == want | {(4, 1): 0.222222, (5, 1): 0.222222, (6, 1): 0.222222, (6, 2): 0.666667}
    both = of(cooccurrence.frequencies_both_ways(graph))
    assert {k: v for k, v in both.items() if k[0] > 1} == {(2, 1): 0.25, (2, 3): 0.25, (2, 6): 0.5, (3, 1): 0.333333, (3, 2): 0.666667}
    a = {k[1]: v for k, v in of(cooccurrence.frequencies(eight, weigh.weigh(eight), only_entities=True)).items() if k[0] == 1}
    assert a == pytest.approx({2: 0.156373, 3: 0.039093, 4: 0.006516, 5: 0.127008, 6: 0.182435, 7: 0.156373, 8: 0.078186, 9: 0.254016}, abs=2e-6)
    assert cooccurrence.frequencies(eight, weigh.weigh(eight), normalise=False).where("word1 = word2").count() == 5
    text = {r.seed: r.text for r in vectors.render(colouring.colour(weigh.weigh(graph), graph.nodes.select(F.col("node_id").alias("seed"))), graph.nodes.select(F.col("node_id").alias("key"), "label")).collect()}
    assert text[1] == "{<B> = 0.500000, <C> = 0.250000}"


@pytest.mark.parametrize(("lines", "rounds"), [(TWO, ["C", "B", "A"]), (FOUR, ["D", "B", "A", "C"])])
def test_levels(spark, lines, rounds):
    graph = built(spark, lines)
    rows = order.levels(graph.nodes, graph.edges, simple=False).join(graph.nodes, "node_id").orderBy("level").collect()
    assert [r.label[1:-1] for r in rows] == rounds
    assert order.check(order.order(graph.nodes, graph.edges)).first() == (len(rounds), True)
    assert order.check(order.order(graph.nodes, graph.edges), graph.edges).first().n_ahead == (len(rounds) == 4)


def test_walks(spark, eight, ranks):
    wedges = weigh.weigh(eight, 10, ranks)
    found = walk.walks(eight, wedges, g.entities(eight), 300, 4).collect()
    triples = {tuple(r) for r in eight.edges.join(eight.nodes.select(F.col("node_id").alias("src"), F.col("label").alias("s")), "src").join(eight.nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("o")), "dst").select("s", "pred", "o").collect()}
    names, ends = labels(eight), {OWL_THING}
    assert len(found) == 1200
    for r in found:
        assert r.path[0] == names[r.start] and len(r.path) % 2 == 1 and len(r.path) <= 9
        assert all(tuple(r.path[i : i + 3]) in triples for i in range(0, len(r.path) - 1, 2))
        assert len(r.path) == 9 or r.path[-1] in ends
    steps = [r.path[1:3] for r in found if r.start == 2]
    weights = {tuple(r): r.weight for r in wedges.where("src = 2").join(eight.nodes.withColumnRenamed("node_id", "dst"), "dst").select("pred", "label", "weight").collect()}
    weights = {k[:2]: k[2] for k in weights}
    for k, w in weights.items():
        assert sum(tuple(s) == k for s in steps) / len(steps) == pytest.approx(w, abs=0.1)
    assert {(r.start, r.walk_no): r.path for r in found} == {(r.start, r.walk_no): r.path for r in walk.walks(eight, wedges, g.entities(eight), 300, 4).collect()}
    full = walk.walks_of_length(eight, wedges, g.entities(eight).where("node_id < 3"), 5, 2, 40, 2).collect()
    assert len(full) == 6 and all(len(r.path) == 5 for r in full)
    with pytest.raises(Exception, match="no walk of that length"):
        walk.walks_of_length(eight, wedges, g.entities(eight), 8, 1, 3).collect()
    assert walk.statistics(spark.createDataFrame([], "start long, walk_no int, path array<string>"), eight).first().mean_tokens is None


def test_interval_ends_at_one(spark):
    rows = walk.intervals(spark.createDataFrame([(0, 0, 1, "p", 0.3), (1, 0, 2, "p", 0.69999)], "edge_id long, src long, dst long, pred string, weight double")).orderBy("edge_id").collect()
    assert [(r.lo, r.hi) for r in rows] == [(0.0, 0.3), (0.3, 1.0)]


def test_sinks_round_trip(spark, eight, tmp_path):
    m = cooccurrence.frequencies(eight, weigh.weigh(eight))
    crec.write(m, str(tmp_path / "m"))
    back = {tuple(r) for r in crec.read(spark, str(tmp_path / "m")).collect()}
    assert back == {(r.word1, r.word2, r.val) for r in m.collect()}
    size = sum(p.stat().st_size for p in (tmp_path / "m").glob("part-*"))
    assert size == 16 * len(back)
    assert crec.decode(struct.pack("<iid", 1, 2, 0.5)).to_pylist() == [{"word1": 1, "word2": 2, "val": 0.5}]
    with pytest.raises(ValueError, match="cut short"):
        crec.decode(b"123")
    o = order.order(eight.nodes, eight.edges)
    tables.write_order(o, str(tmp_path / "o"))
    assert {tuple(r) for r in tables.read_order(spark, str(tmp_path / "o"), 5).collect()} == {tuple(r) for r in o.collect()}
    with pytest.raises(ValueError, match="the graph 6"):
        tables.read_order(spark, str(tmp_path / "o"), 6)
    tables.write_vocabulary(g.vocabulary(eight), str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines[0] == "<A> nofr" and lines[8] == f"{RDF_TYPE} nofr"
    w = walk.walks(eight, weigh.weigh(eight), g.entities(eight), 3, 2)
    tables.write_walks(w, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).count() == 12
    (tmp_path / "r.tsv").write_text("\n".join(RANK_LINES))
    assert {tuple(r) for r in tables.read_ranks(spark, str(tmp_path / "r.tsv")).collect()} == {("<A>", 0.5), ("<C>", 0.3), ("<Z>", 0.5)}


def test_queue():
    q = PaintQueue()
    q[3] = 0.5
    q.add(4, 0.75)
    q.add(3, 0.5)
    assert (q[9], q.peek(), q.items()) == (0.0, (3, 1.0), [(3, 1.0), (4, 0.75)])
    assert [q.pop(), q.pop(), len(q)] == [(3, 1.0), (4, 0.75), 0]
    with pytest.raises(IndexError):
        q.pop()


def test_murmur_known_values():
    """Digests that are public, and of the four-lane variant one at the default seed; ends of all lengths go with their own value only."""
    words = lambda x, seed: hashing.digests([x], hashing.murmur128_words, seed)[0].hex()
    assert words(b"", 0) == "0" * 32
    assert words(b"hello", 0) == "029bbd41b3a7d8cb191dae486a901e5b"
    assert words(b"The quick brown fox jumps over the lazy dog", 0) == "6c1b07bc7bbc4be347939ac4a93c437a"
    assert hashing.digests([b"hello"], hashing.murmur32, 0)[0][::-1].hex() == "248bfa47"
    assert hashing.digests([b"hello"], hashing.murmur128_lanes)[0].hex().upper() == "817631F444F72C67A67DED06A67DED06"


def plain_lanes(data, seed):
    """The four-lane variant a value at a time, in whole numbers."""
    m = 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> (32 - r)) & m
    c, h = hashing.LANES, [seed] * 4
    for at in range(0, len(data), 16):
        block = data[at : at + 16]
        for i in range(4):
            k = int.from_bytes(block[4 * i : 4 * i + 4], "little") * c[i] & m
            h[i] ^= turn(k, (15, 16, 17, 18)[i]) * c[(i + 1) % 4] & m
            if len(block) == 16:
                h[i] = ((turn(h[i], (19, 17, 15, 13)[i]) + h[(i + 1) % 4]) * 5 + (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)[i]) & m
    h = [x ^ len(data) for x in h]
    spread = lambda h: [sum(h) & m, *((x + sum(h)) & m for x in h[1:])]
    h = spread(h)
    for i, x in enumerate(h):
        x = (x ^ x >> 16) * 0x85EBCA6B & m
        x = (x ^ x >> 13) * 0xC2B2AE35 & m
        h[i] = x ^ x >> 16
    return b"".join(x.to_bytes(4, "little") for x in spread(h))


def test_murmur_of_all_lengths(spark):
    values = [bytes((7 * i + n) % 256 for i in range(n)) for n in range(50)]
    assert hashing.digests(values, hashing.murmur128_lanes) == [plain_lanes(v, hashing.SEED) for v in values]
    rows = spark.createDataFrame([("hello",), (None,), ("",), ("hello",)], "v string").select("v", hashing.murmur128_hex("v").alias("d")).collect()
    assert [r.d for r in rows] == ["817631F444F72C67A67DED06A67DED06", None, plain_lanes(b"", hashing.SEED).hex().upper(), "817631F444F72C67A67DED06A67DED06"]


def test_a_source_of_very_many_edges(spark):
    n = 300_000
    edges = spark.range(n).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("<p>").alias("pred"))
    graph = g.Graph(spark.range(n + 1).select(F.col("id").alias("node_id"), F.concat(F.lit("<"), "id", F.lit(">")).alias("label")), edges)
    cells = walk.intervals(weigh.weigh(graph)).agg(F.min("lo"), F.max("hi"), F.sum(F.col("hi") - F.col("lo")), F.count("*"), F.max(F.abs(F.col("lo") - F.col("edge_id") / n))).first()
    assert cells[0] == 0 and cells[1] == 1 and abs(cells[2] - 1) < 1e-9 and cells[3] == n and cells[4] < 1e-9
    ordered = walk.intervals(weigh.weigh(graph)).select("lo", F.lag("hi").over(Window.orderBy("edge_id")).alias("end"))
    assert ordered.where("end is not null and end <> lo").count() == 0


def test_walks_shuffle_few_rows(spark):
    """Edges for their counts, sums and weights, then sources with all their edges: not edges for their targets' labels, nor for slots of draws (41 rows an edge)."""
    n = 40_000
    pairs = spark.range(4 * n).select(F.col("id").alias("edge_id"), (F.col("id") % n).alias("src"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("dst"), F.lit("<p>").alias("pred"))
    graph = g.Graph(cut(spark.range(n).select(F.col("id").alias("node_id"), F.concat(F.lit("<"), "id", F.lit(">")).alias("label"))), cut(pairs))
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        rows = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {x.stageId(): x.shuffleWriteRecords() for x in (rows.apply(i) for i in range(rows.size()))}

    before = set(stages())
    assert walk.walks_from_random(graph, weigh.weigh(graph), 10, 4).where("size(path) = 9").count() == 10
    sent = sum(rows for stage, rows in stages().items() if stage not in before)
    assert sent < 12 * 4 * n


def test_walks_through_a_source_of_very_many_edges(spark):
    """Its edges are in blocks; each draw still meets the edge whose interval it lies in."""
    n = 200_000
    edges = spark.range(n).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), (F.col("id") + 2).alias("dst"), F.lit("<p>").alias("pred"))
    edges = cut(edges.unionByName(spark.createDataFrame([(n, 1, 0, "<q>")], edges.schema)))
    graph = g.Graph(cut(spark.range(n + 2).select(F.col("id").alias("node_id"), F.col("id").cast("string").alias("label"))), edges)
    assert walk.Walker(graph, weigh.weigh(graph)).cells.where("at = 0").count() == 4
    found = walk.walks(graph, weigh.weigh(graph), spark.range(2).withColumnRenamed("id", "node_id"), 500, 3).collect()
    assert len(found) == 1000
    for r in found:
        draw = int(hashlib.md5(f"{walk.SEED}|{r.start}|{r.walk_no}|{r.start}".encode()).hexdigest()[:8], 16) / 2**32 * n
        assert r.path[:-1] == (["1", "<q>", "0", "<p>"] if r.start else ["0", "<p>"])
        assert draw - 1e-3 < int(r.path[-1]) - 1 and int(r.path[-1]) - 2 < draw + 1e-3
    full = walk.walks_of_length(graph, weigh.weigh(graph), spark.range(2).withColumnRenamed("id", "node_id"), 5, 3, strict=False).collect()
    assert {(r.start, r.walk_no, len(r.path)) for r in full} == {(1, i, 5) for i in range(3)}


def test_shuffles_of_a_graph_that_is_built_are_deleted(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().mkString("\n").count("/shuffle_")
    graph = built(spark, EIGHT)
    made, until = files(), time.time() + 20
    while files() >= made and time.time() < until:
        time.sleep(0.5)
    assert files() < made and graph.edges.count() == 9


def shuffled(spark):
    """Bytes of the shuffle files that lie on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_packed_rows_are_compressed_and_keep_their_order(spark):
    rows = spark.range(0, 300_000, 1, 3).select("id", F.concat(F.lit("<p/"), "id", F.lit(">")).alias("label"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("ids"))
    kept = session.packed(rows.repartition(3, "id").sortWithinPartitions(F.desc("id")))
    assert kept.dtypes == rows.dtypes and kept.exceptAll(rows).isEmpty() and kept.count() == 300_000
    placed = [r.id for r in kept.where(F.spark_partition_id() == 1).collect()]
    assert placed == sorted(placed, reverse=True)
    assert session.packed(rows.limit(0)).dtypes == rows.dtypes and session.packed(rows.limit(0)).count() == 0


def test_slices_change_no_graph_and_no_walk(spark, monkeypatch):
    """Lines have numbers that others have too, so statements go by text there."""
    n = 3_000
    rows = spark.range(n).select(F.floor(F.col("id") / 3).alias("line_no"), *[F.concat(F.lit("<"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(90)), F.lit(">")).alias(c) for i, c in enumerate("spo")])

    def seen():
        graph = g.build(rows)
        found = walk.walks(graph, weigh.weigh(graph), graph.nodes, 20, 3)
        return sorted(map(tuple, graph.nodes.collect())), sorted(map(tuple, graph.edges.collect())), sorted((r.start, r.walk_no, tuple(r.path)) for r in found.collect())

    whole = seen()
    monkeypatch.setattr(g, "SLICE", 800)
    monkeypatch.setattr(walk, "EDGES", 800)
    monkeypatch.setattr(walk, "DRAWS", 500)
    assert seen() == whole
    names, first = dict(whole[0]), {}
    for r in rows.collect():
        first[r.s, r.p, r.o] = min(r.line_no, first.get((r.s, r.p, r.o), n))
    want = [k for k, _ in sorted(first.items(), key=lambda x: (x[1], x[0]))]
    assert [(names[s], p, names[o]) for _, s, o, p in whole[1]] == want


def test_walks_leave_no_shuffles_on_disk(spark):
    """Of the shuffles of all steps together, some 90 bytes a walk lay on disk when walks were read."""
    graph = built(spark, EIGHT)
    before = shuffled(spark)
    found = walk.walks(graph, weigh.weigh(graph), graph.nodes, 20_000, 4)
    assert found.count() == 100_000 and shuffled(spark) - before < 500_000
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("graphloom_")]


def test_walks_that_go_alike_are_one_row(spark):
    """100 000 walks sent a row each at every step, and once more to be counted as text."""
    graph = built(spark, EIGHT)
    wedges, store = weigh.weigh(graph), spark.sparkContext._jsc.sc().statusStore()

    def stages():
        rows = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {x.stageId(): x.shuffleWriteRecords() for x in (rows.apply(i) for i in range(rows.size()))}

    before = set(stages())
    found = walk.walks(graph, wedges, graph.nodes, 20_000, 4)
    paths, sizes = walk.walk_paths(graph, wedges, graph.nodes, 20_000, 4).collect(), walk.walk_sizes(graph, wedges, graph.nodes, 20_000, 4)
    assert walk.statistics_of_sizes(sizes, graph).first() == walk.statistics(found, graph).first()
    assert sum(rows for stage, rows in stages().items() if stage not in before) < 50_000
    want = Counter(tuple(r.path) for r in found.collect())
    assert len(paths) == len(want) and {tuple(r.path): r.n for r in paths} == want
    empty = walk.walk_sizes(graph, wedges, graph.nodes.limit(0), 5, 4)
    assert walk.statistics_of_sizes(empty, graph).first() == walk.statistics(walk.walks(graph, wedges, graph.nodes.limit(0), 5, 4), graph).first()


def test_many_cycles_are_broken_in_one_round(spark):
    n = 10_000
    pairs = spark.range(n).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b"))
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    found = order.levels(spark.range(2 * n).withColumnRenamed("id", "node_id"), edges).groupBy("level").count().collect()
    assert {(r.level, r["count"]) for r in found} == {(0, n), (1, n)}
    loop = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "src long, dst long")
    assert order.levels(spark.range(2).withColumnRenamed("id", "node_id"), loop, simple=False).count() == 2


def test_walks_from_random_nodes(spark, eight):
    found = walk.walks_from_random(eight, weigh.weigh(eight), 200, 3).collect()
    starts = {r.walk_no: r.node_id for r in walk.random_starts(eight, 200).collect()}
    assert {r.walk_no: r.start for r in found} == starts and len(found) == 200


def test_walks_of_a_length_are_all_found(spark, eight):
    """However often the draw must be repeated; those that end early count too."""
    found = walk.walks_of_length(eight, weigh.weigh(eight), g.entities(eight).where("node_id < 3"), 9, 200, 1).collect()
    assert len(found) == 600 and all(len(r.path) == 9 for r in found)
    assert walk.walks_of_length(eight, weigh.weigh(eight), g.entities(eight), 9, 2, strict=False).select("start").distinct().count() == 3


def test_cached_vectors_and_matrix(spark):
    graph = built(spark, TWO)
    wedges, o = weigh.weigh(graph), order.order(graph.nodes, graph.edges)
    found = by_label(graph, colouring.colour_cached(wedges, o, predicates=g.predicate_ids(graph)))
    assert found == COLOURED["two"][1]
    m = cooccurrence.frequencies_cached(graph, wedges, o)
    assert {(r.word1, r.word2): round(r.val, 6) for r in m.where("word1 = 2").collect()} == {(2, 3): 0.333333, (2, 6): 0.666667}


def test_pairs_as_text(spark):
    graph = built(spark, TWO)
    v = spark.createDataFrame([(0, "<beta>", 1, 0.25), (0, "<gamma>", 1, 0.25), (0, "<delta>", 2, 0.0078125)], "seed long, pred string, dst long, val double")
    assert vectors.render_pairs(v, graph.nodes).first().text == "{(<beta>,<B>) = 0.250000, (<gamma>,<B>) = 0.250000, (<delta>,<C>) = 0.007813}"


def test_records_are_replaced_and_transposed(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 9, 0.25)], "word1 int, word2 int, val double")
    where = f"file://{tmp_path}/m"
    crec.write(rows, where)
    crec.write(rows.limit(1), where)
    assert crec.read(spark, where).count() == 1
    crec.write(rows, where)
    crec.transpose(spark, where, str(tmp_path / "t"), 9)
    assert {tuple(r) for r in crec.read(spark, str(tmp_path / "t")).collect()} == {(1, 2, 0.5), (1, 9, 0.25), (9, 1, 0.25)}


def test_progress_is_observed(spark):
    df, seen = counted(spark.range(10), "ten", "id")
    df.collect()
    assert seen.get == {"rows": 10, "id": 45}
