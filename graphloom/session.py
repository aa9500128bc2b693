"""What the library asks of a session: a shared folder for cut lineages, and itself on the executors."""

from __future__ import annotations

import gc
import io
import tempfile
import threading
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes beyond which rows that are packed go into a block of their own.
BLOCK_ROWS, BLOCK_BYTES = 1 << 17, 1 << 23
#: Slices that a step is at most done in: each reads the whole input again.
SLICES = 4
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each context."""
    context, top = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_shipped", None) == top.name or not top.is_dir():
        return
    whole = f"{tempfile.mkdtemp(prefix='package-')}/{top.name}.zip"
    with zipfile.ZipFile(whole, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(whole)
    context._shipped = top.name


def ready(spark: SparkSession) -> SparkSession:
    """Ships the package, and sets a checkpoint folder on a local master that has none; a cluster must name one that its machines share."""
    ship(spark)
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; later reads survive lost executors."""
    ready(df.sparkSession)
    return df.checkpoint()


def _pack(batches: Iterator) -> Iterator:
    """Arrow batches -> blocks of Parquet, a row each."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def block(rows: list) -> pa.RecordBatch:
        table, out = pa.Table.from_batches(rows), io.BytesIO()
        longs = {f.name: "DELTA_BINARY_PACKED" for f in table.schema if pa.types.is_int64(f.type)}
        pq.write_table(table, out, compression="zstd", use_dictionary=[f.name for f in table.schema if f.name not in longs], column_encoding=longs or None, write_statistics=False)
        return pa.record_batch([pa.array([out.getvalue()], pa.binary())], ["rows"])

    held: list = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS or sum(x.nbytes for x in held) >= BLOCK_BYTES:
            yield block(held)
            held = []
    if held:
        yield block(held)


def _unpack(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq

    for b in batches:
        for x in b.column(0):
            yield from pq.read_table(pa.BufferReader(x.as_buffer())).to_batches(max_chunksize=1 << 14)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffles of queries that are made and run inside are deleted as soon as they have run."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def packed(df: DataFrame, schema: str | None = None) -> DataFrame:
    """Like cut(), in compressed columns, as checkpoints are not compressed; partitions keep their rows and order. The shuffles behind it are deleted at once. With a schema, df is that of rows which packed_by() has packed."""
    spark = ready(df.sparkSession)
    with tidy(spark):
        blocks = (df.mapInArrow(_pack, "rows binary") if schema is None else df).checkpoint()
    return blocks.mapInArrow(_unpack, df.schema if schema is None else schema)


def packed_by(table):
    """An Arrow table -> a table of blocks, for functions of executors that pack what they make."""
    import pyarrow as pa

    return pa.Table.from_batches(_pack(iter(table.to_batches(max_chunksize=1 << 16))), pa.schema([("rows", pa.binary())]))


class Dealt:
    """Rows by hash of keys, in a compressed table of the shared folder that joins on the keys read without a shuffle. The table goes with this object, at the latest with the process."""

    def __init__(self, spark: SparkSession, keys: list[str], parts: int):
        self.spark, self.keys, self.parts, self.name = ready(spark), keys, parts, f"graphloom_{uuid.uuid4().hex}"
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{self.name}"
        self.drop = weakref.finalize(self, _dropped, spark, self.name, self.path)

    def add(self, rows: DataFrame, lie: bool = False) -> None:
        """lie: the rows lie by hash of the keys."""
        with tidy(self.spark):
            (rows if lie else rows.repartition(self.parts, *self.keys)).write.format("parquet").option("path", self.path).option("compression", "zstd").bucketBy(self.parts, *self.keys).mode("append").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)


def _dropped(spark: SparkSession, name: str, path: str) -> None:
    with suppress(Exception):  # the session may have stopped
        spark.sql(f"drop table if exists {name}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(rows: int, each: int, most: int = SLICES) -> int:
    """How many slices of about `each` rows a step is done in, so that its shuffles are never all there at once."""
    return max(1, min(most, -(-rows // each)))


def slice_of(key: str | Column, i: int, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)) == i if n > 1 else F.lit(True)


def swept(spark: SparkSession) -> None:
    """Soon lets Spark delete the files of shuffles and checkpoints that nothing refers to any more; of itself it waits until the driver's memory is short, while disks fill. What has just run is let go only after a moment, so that this waits beside what runs next."""
    jvm = spark.sparkContext._jvm

    def collect() -> None:
        gc.collect()
        with suppress(Exception):  # the session may have stopped
            jvm.System.gc()

    for after in (2, 8):
        later = threading.Timer(after, collect)
        later.daemon = True
        later.start()
