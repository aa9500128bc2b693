"""Relational tables as statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import OWL_THING, RDF_TYPE
from ..session import ready

#: Lines of one family are numbered from a multiple of this.
FAMILY = 10**13


def iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"<{kind}/"), F.col(key).cast("string"), F.lit(">"))


def quoted(column: str) -> Column:
    return F.concat(F.lit('"'), F.col(column), F.lit('"'))


def _family(i: int, df: DataFrame, key: str, s: Column, p: str, o: Column) -> DataFrame:
    return df.select((F.lit(i * FAMILY) + F.expr(key)).cast("long").alias("line_no"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers; customers are the entities and have a literal."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    families = [
        _family(1, nation, "n_nationkey", iri("nation", "n_nationkey"), "<inRegion>", iri("region", "n_regionkey")),
        _family(2, nation, "n_nationkey", iri("region", "n_regionkey"), "<hasNation>", iri("nation", "n_nationkey")),
        _family(3, supplier, "s_suppkey", iri("supplier", "s_suppkey"), "<inNation>", iri("nation", "s_nationkey")),
        _family(4, customer, "c_custkey", iri("customer", "c_custkey"), "<inNation>", iri("nation", "c_nationkey")),
        _family(5, customer, "c_custkey", iri("customer", "c_custkey"), RDF_TYPE, F.lit(OWL_THING)),
        _family(6, customer, "c_custkey", iri("customer", "c_custkey"), "<segment>", quoted("c_mktsegment")),
    ]
    rows = families[0]
    for f in families[1:]:
        rows = rows.unionByName(f)
    return rows


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """places(), and what customers ordered of which parts by which suppliers."""
    orders, lines, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    line = "l_orderkey * 16 + l_linenumber"
    rows = places(spark, sf_dir)
    for f in (
        _family(7, orders, "o_orderkey", iri("customer", "o_custkey"), "<placed>", iri("order", "o_orderkey")),
        _family(8, lines, line, iri("order", "l_orderkey"), "<hasPart>", iri("part", "l_partkey")),
        _family(9, lines, line, iri("part", "l_partkey"), "<suppliedBy>", iri("supplier", "l_suppkey")),
        _family(10, part, "p_partkey", iri("part", "p_partkey"), "<brand>", quoted("p_brand")),
    ):
        rows = rows.unionByName(f)
    return rows


def part_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, weight: parts ranked by price."""
    return table(spark, sf_dir, "part").groupBy(iri("part", "p_partkey").alias("label")).agg(F.max("p_retailprice").alias("weight"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and where they link to."""
    hrefs = F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    rows = table(spark, sf_dir, "pages").select("page_id", hrefs.alias("i", "href"))
    return _family(11, rows, "page_id * 100000 + i", iri("page", "page_id"), "<linksTo>", iri("url", "href"))


def lines(triples: DataFrame) -> DataFrame:
    """line_no, value: the statements as N-Triples text."""
    return triples.select("line_no", F.concat("s", F.lit(" "), "p", F.lit(" "), "o", F.lit(" .")).alias("value"))
