"""What the two document classifiers share: labelled rows, scores by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, texts_of


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): rows of docs with a label of 0 or 1, about `most` at most; a document that is labelled twice counts as 1 if once it is."""
    own = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = bounded_sample(own, most)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # bounded by `most`


def scored(docs: DataFrame, score: Callable[[], Callable[[list], np.ndarray]], keep: list[Column]) -> DataFrame:
    """docs (text) and columns to keep -> those columns, score double, predicted int. score() is called once in each task and gives a function of a list of texts."""
    columns = docs.select(*keep, F.col("text").alias("__text"))
    kept = columns.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for b in batches:
            s = np.clip(np.asarray(of(texts_of(b, "__text")), np.float64), 0, 1)
            yield pa.record_batch([*b.columns[: len(kept)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema[: len(kept)])
    return columns.mapInArrow(run, f"{schema}, score double, predicted int")


def in_order(rows: list) -> list:
    """The same order wherever the rows came from."""
    return sorted(rows, key=lambda r: (r.doc_id, r.y))
