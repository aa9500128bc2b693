import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as g, roads, walk, weigh
from graphloom.schema import OWL_THING, RDF_TYPE


@pytest.fixture(scope="module")
def statements(spark):
    """With statements that stand twice, lines of one number, and nodes without edges."""
    r = random.Random(5)
    rows = [(i, f"<n{i}>", RDF_TYPE, OWL_THING) for i in range(12)]
    rows += [(100 + r.randrange(60), f"<n{r.randrange(14)}>", f"<p{r.randrange(3)}>", f"<n{r.randrange(30)}>") for _ in range(120)]
    return spark.createDataFrame(rows + rows[40:60], "line_no long, s string, p string, o string").repartition(3).cache()


@pytest.fixture(scope="module")
def ranked(spark):
    return spark.createDataFrame([(f"<n{i}>", 1.0 + i) for i in range(0, 30, 2)], "label string, weight double")


def rows(df):
    return sorted(map(tuple, df.collect()))


def text(df):
    return df.select("start", "walk_no", F.array_join("path", " "))


@pytest.mark.parametrize("strategy", [1, 3, 10])
def test_walks_over_statements_are_those_of_the_graph(statements, ranked, strategy, monkeypatch):
    graph = g.build(statements)
    want = rows(text(walk.walks(graph, weigh.weigh(graph, strategy, ranked), g.entities(graph), 20, 4)))
    monkeypatch.setattr(roads, "WEIGHED", 40)
    monkeypatch.setattr(roads, "DRAWS", 100)
    assert rows(roads.walks(statements, strategy, ranked, 20, 4)) == want and len(want) == 240
    monkeypatch.setattr(walk, "SPAN", 4)  # sources of very many edges are left to the graph's walks
    assert rows(roads.walks(statements, strategy, ranked, 20, 4)) == want


def test_walks_of_a_length_over_statements(statements):
    graph = g.build(statements)
    for tokens, length in ((7, 3), (5, 3)):
        want = rows(text(walk.walks_of_length(graph, weigh.weigh(graph), g.entities(graph), tokens, 5, length=length, strict=False)))
        assert rows(roads.walks_of_length(statements, tokens, 5, length=length)) == want and want


def test_edges_of_walks_are_neither_numbered_nor_told_by_numbers(statements, monkeypatch):
    """The query sorted, numbered and joined all edges before it walked them."""
    from graphloom.plans import catalog

    def never(*args, **kw):
        raise AssertionError("the graph is built")

    monkeypatch.setattr(g, "build", never)
    monkeypatch.setattr(catalog, "_statements", lambda spark, sf_dir: statements)
    monkeypatch.setattr(catalog.r, "part_ranks", lambda spark, sf_dir: statements.select(F.col("o").alias("label"), F.lit(2.0).alias("weight")).distinct())
    assert catalog.QUERIES["walk_rank_biased"](statements.sparkSession, "").count() == 12 * catalog.WALKS


def test_rounds_of_a_length_keep_their_paths(statements, monkeypatch):
    """The query built the graph, and walked once more, for their paths, the draws that had the length."""
    from graphloom.plans import catalog

    monkeypatch.setattr(g, "build", lambda *args, **kw: pytest.fail("the graph is built"))
    monkeypatch.setattr(catalog, "_statements", lambda spark, sf_dir: statements)
    assert {len(r.walk.split()) for r in catalog.QUERIES["walk_length_enforced"](statements.sparkSession, "").collect()} == {catalog.TOKENS}


def test_walk_text_has_all_walks_of_the_workload(statements, monkeypatch):
    """It had 50 of the 250 from each start."""
    from graphloom.plans import catalog

    monkeypatch.setattr(catalog, "_statements", lambda spark, sf_dir: statements)
    found = rows(catalog.QUERIES["walk_text"](statements.sparkSession, ""))
    graph = g.build(statements)
    paths = walk.walk_paths(graph, weigh.weigh(graph), g.entities(graph), 250, 4)
    assert found == rows(paths.select(F.array_join("path", " "), "n")) and sum(n for _, n in found) == 12 * 250
