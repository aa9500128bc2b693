"""Dense numbers 0, 1, 2 ... in a global order, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from ..session import packed

ROW_BITS = 33  # monotonically_increasing_id() keeps the row's place in these, the partition above them


def dense_ids(df: DataFrame, name: str, *order: str | Column, first: int = 0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """df, or its columns `keep`, with column `name`: its rows' numbers by `order` (which should have no ties).

    Rows are range-partitioned and sorted, and written, so that places stay as they are; then each partition's offset is the number of rows before it. Only a number for each partition reaches the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = packed(placed if keep is None else placed.select(*keep, "__at"))
    part = F.shiftright("__at", ROW_BITS)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).count().collect()}
    parts = sorted(sizes)
    offsets = dict(zip(parts, accumulate([first, *(sizes[p] for p in parts)]), strict=False))
    at = F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)
    if not offsets:
        return placed.withColumn(name, at).drop("__at")
    offset = F.element_at(F.lit([offsets.get(p, 0) for p in range(max(parts) + 1)]), part.cast("int") + 1)
    return placed.withColumn(name, at + offset).drop("__at")


def _repeats(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    last, found = None, False
    for b in batches:
        if b.num_rows:
            x = b.column(0)
            found = found or (last is not None and x[0].as_py() == last) or bool(pc.any(pc.equal(x[1:], x[:-1])).as_py())
            last = x[-1].as_py()
    yield pa.record_batch([pa.array([found])], ["found"])


def repeats(numbered: DataFrame, column: str) -> bool:
    """Whether rows numbered by `column` alone have a value of it twice; equal values lie together, so nothing is shuffled."""
    return not numbered.select(column).mapInArrow(_repeats, "found boolean").where("found").isEmpty()
