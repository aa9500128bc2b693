"""Progress of a job in metrics that Spark gathers beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def counted(df: DataFrame, name: str, *sums: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that has its rows (`rows`) and the sums of some columns once an action has run; no second pass is needed."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums]), seen
