"""Statements from a stream of N-Triples lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import ntriples


def statements(lines: DataFrame, time: str = "ts", late: str = "10 minutes", literals: bool = True) -> DataFrame:
    """lines (value, ts) of a stream -> s, p, o, ts: each statement once within the watermark; malformed lines are left out."""
    rows = ntriples.parse(lines.select("value", time), mode="DROPMALFORMED").withWatermark(time, late)
    return (rows if literals else ntriples.without_literals(rows)).dropDuplicatesWithinWatermark(["s", "p", "o"])


def degrees(found: DataFrame, time: str = "ts", window: str = "1 hour") -> DataFrame:
    """Statements of a stream -> edges out of each subject in each window."""
    return found.groupBy(F.window(time, window), F.col("s").alias("label")).agg(F.count("*").alias("n"))
