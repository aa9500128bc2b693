"""N-Triples text as a table of triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbering import dense_ids

#: Subject (blank node, or what stands in the first angle brackets), predicate, and the rest of the line.
LINE = r"^(?:\s*(_:\S+)|[^<]*(<[^>]*>))[^<]*(<[^>]*>)[ \t]*(.*)$"


def is_statement(line: Column) -> Column:
    """Not white space only, and not begun by #."""
    return line.rlike(r"\S") & ~line.startswith("#")


def trim_literal(rest: Column) -> Column:
    """A literal without the spaces and dots that end its line; a type or language tag stays."""
    return F.regexp_replace(rest, r"[ .]+$", "")


def parse(lines: DataFrame, column: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """lines with a text column -> its other columns with s, p, o.

    mode: FAILFAST raises on a malformed line, DROPMALFORMED leaves it out, PERMISSIVE keeps it with nulls and the line in _corrupt.
    """
    line = F.col(column)
    part = lambda i: F.regexp_extract(line, LINE, i)
    rest = part(4)
    obj = F.when(rest.startswith("<"), F.regexp_extract(rest, r"^(<[^>]*>)", 1)).when(rest.startswith("_:"), F.regexp_extract(rest, r"^(_:\S+)", 1)).when(rest.startswith('"'), trim_literal(rest)).otherwise("")
    subject = F.when(part(1) != "", part(1)).otherwise(part(2))
    rows = lines.where(is_statement(line)).withColumns({"s": subject, "p": part(3), "o": obj})
    bad = (F.col("s") == "") | (F.col("p") == "") | (F.col("o") == "")
    if mode == "DROPMALFORMED":
        return rows.where(~bad).drop(column)
    if mode == "PERMISSIVE":
        return rows.withColumns({"_corrupt": F.when(bad, line)} | {c: F.when(~bad, F.col(c)) for c in "spo"}).drop(column)
    if mode != "FAILFAST":
        raise ValueError(f"unknown mode {mode}")
    return rows.withColumn("s", F.when(bad, F.raise_error(F.concat(F.lit("malformed statement: "), line)).cast("string")).otherwise(F.col("s"))).drop(column)


def without_literals(triples: DataFrame) -> DataFrame:
    return triples.where(~F.col("o").startswith('"'))


def read(spark: SparkSession, path: str | list[str], literals: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Files -> line_no, s, p, o; line_no counts the statements in file order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    rows = parse(lines, mode=mode)
    rows = rows if literals else without_literals(rows)
    return dense_ids(rows, "line_no", "__file", "__block", "__row").drop("__file", "__block", "__row")
