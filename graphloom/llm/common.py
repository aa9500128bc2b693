"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session
from ..session import cut  # noqa: F401

#: Rows and bytes in one Arrow batch, so that a batch of long documents fits in a worker.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 26


def ready(spark: SparkSession) -> SparkSession:
    """The library's session, with small Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return session.ready(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About `most` rows at most, picked by a hash of `key`, alike for any partitioning; all rows if there are no more than that."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def segments(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about `most` characters, cut at spaces only (so a longer word stays whole)."""
    if len(text) <= most:
        yield text
        return
    at = 0
    while at < len(text):
        end = len(text) if at + most >= len(text) else text.find(" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def groups(texts: list, chars: int = 1 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts, each group of about `chars` characters: the text's index for each part, and the parts."""
    at, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for s in segments(t or "", chars):
            at.append(i)
            parts.append(s)
            size += len(s) + 16
            if size >= chars:
                yield at, parts
                at, parts, size = [], [], 0
    if at:
        yield at, parts


class Memo:
    """A word's row of numbers, computed once; forgets all when `limit` words are known."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], width: int, dtype=np.float32, limit: int = 300_000):
        self.rows_of, self.width, self.dtype, self.limit = rows_of, width, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, self.width), self.dtype)

    def __call__(self, words: list[str]) -> np.ndarray:
        """The rows' places in `table`."""
        if len(self.at) > self.limit:
            self.clear()
        new = list(set(words).difference(self.at))
        if new:
            n = len(self.at)
            if n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(new), len(self.table)), self.width), self.dtype)])
            self.table[n : n + len(new)] = self.rows_of(new)
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))


_held: dict = {}


def held(name: str | None = None, make: Callable | None = None):
    """What an operator keeps in a worker from one task to the next. Only one thing is kept: another name, or none, lets it go."""
    if name not in _held:
        _held.clear()
        if name is not None:
            _held[name] = make()
    return _held.get(name)


def sums_by(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each owner; owners ascend."""
    out = np.zeros((n, rows.shape[1]), np.float64)
    if len(rows):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that others with clashing names don't matter."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
