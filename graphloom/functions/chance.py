"""Reproducible draws: the same in every engine that has md5."""

from pyspark.sql import Column, functions as F


def uniform(*parts: Column | str) -> Column:
    """A double in [0, 1) from the md5 of the parts joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0
