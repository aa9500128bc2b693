"""Data source "crec": co-occurrence records of 16 bytes (int32, int32, float64, little-endian), without headers."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.cooccurrence import transpose_predicates
from ..schema import RECORD
from ..session import ready

LAYOUT = np.dtype([("word1", "<i4"), ("word2", "<i4"), ("val", "<f8")])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    records: int


@dataclass
class Written(WriterCommitMessage):
    name: str


def encode(batch: pa.RecordBatch) -> bytes:
    out = np.empty(batch.num_rows, LAYOUT)
    for i, name in enumerate(LAYOUT.names):
        out[name] = batch.column(i).to_numpy(zero_copy_only=False)
    return out.tobytes()


def decode(data: bytes) -> pa.RecordBatch:
    if len(data) % LAYOUT.itemsize:
        raise ValueError("a record is cut short")
    rows = np.frombuffer(data, LAYOUT)
    return pa.record_batch([pa.array(np.ascontiguousarray(rows[n])) for n in LAYOUT.names], names=list(LAYOUT.names))


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, Google or Azure storage), and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), os.path.abspath(path)


def parts(path: str) -> list[fs.FileInfo]:
    """The files of records at a path: itself, or a folder's parts by name."""
    system, at = store(path)
    own = system.get_file_info(at)
    if own.type == fs.FileType.File:
        return [own]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted((i for i in found if i.base_name.startswith("part-")), key=lambda i: i.path)


class CrecReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, max(1, split)

    def partitions(self):
        out = []
        for f in parts(self.path):
            n, odd = divmod(f.size, LAYOUT.itemsize)
            if odd:
                raise ValueError(f"a record is cut short in {f.path}")
            out += [Range(f.path, at, min(self.split, n - at)) for at in range(0, n, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        left = partition.records
        if not left:
            return
        with store(self.path)[0].open_input_file(partition.path) as f:
            f.seek(partition.start * LAYOUT.itemsize)
            while left:
                data = f.read(min(left, 1 << 16) * LAYOUT.itemsize)
                if not data:
                    raise ValueError("a record is cut short")
                left -= len(data) // LAYOUT.itemsize
                yield decode(data)


class CrecWriter(DataSourceArrowWriter):
    """Tasks write hidden files; the driver gives them their names once all are there, and only then removes what they replace."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        system, at = store(self.path)
        system.create_dir(at)
        name = f"part-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{at}/.{name}") as f:
            for batch in iterator:
                f.write(encode(batch))
        return Written(name)

    def commit(self, messages):
        system, at = store(self.path)
        system.create_dir(at)
        old = [f.path for f in parts(self.path)] if self.overwrite else []
        for m in messages:
            if m:
                system.move(f"{at}/.{m.name}", f"{at}/{m.name}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages):
        system, at = store(self.path)
        for m in messages:
            if m and system.get_file_info(f"{at}/.{m.name}").type == fs.FileType.File:
                system.delete_file(f"{at}/.{m.name}")


class CrecSource(DataSource):
    """Options: path, a folder or URI that all executors reach; records, the most records of a read partition."""

    @classmethod
    def name(cls):
        return "crec"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return CrecReader(self.options["path"], int(self.options.get("records", 1 << 22)))

    def writer(self, schema, overwrite):
        return CrecWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ready(spark).dataSource.register(CrecSource)


def write(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.select(F.col("word1").cast("int"), F.col("word2").cast("int"), F.col("val").cast("double")).write.format("crec").mode("overwrite").option("path", path).save()


def transpose(spark: SparkSession, source: str, target: str, first_predicate: int) -> None:
    """Records from one place to another, those of predicates the other way round as well."""
    write(transpose_predicates(read(spark, source), first_predicate), target)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("crec").option("path", path).load()
