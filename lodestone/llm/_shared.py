"""Folders, written tables and fixed-size bitmaps that several operators use."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and all runs on this machine, one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{(own := tempfile.mkdtemp(prefix='lodestone-'))}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Like ``written``, and stays: what a computation returns."""
    return _write(df, new_path(df.sparkSession, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage is cut and survives lost executors.

    Inside of a ``Scratch`` the table goes with it.
    """
    open_ = getattr(_scratches, "open", None)
    return open_[-1].written(df, name) if open_ else kept(df, name)


#: Documents for which a table of a row or a few each gets a file.
FILE_DOCUMENTS = 50_000


_scratches = threading.local()


class Scratch:
    """Written tables and broadcasts of one computation, removed when it ends; its result is ``kept``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.broadcasts, self.files = spark, [], [], partitions(spark)

    def sized_for(self, documents: int) -> None:
        """Tables written with ``few`` get files in proportion to the documents, as many as shuffle partitions at most."""
        self.files = max(1, min(partitions(self.spark), -(-documents // FILE_DOCUMENTS)))

    def few(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``written``, of rows that take little to make: in few tasks, and few files."""
        return self.written(df.coalesce(self.files), name)

    def gathered(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``written``, of rows that take long to make: in as many tasks as ever, but few files."""
        return self.written(df.repartition(self.files), name)

    def __enter__(self) -> Scratch:
        _scratches.open = [*getattr(_scratches, "open", []), self]
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return _write(df, self.paths[-1])

    def broadcast(self, value: object):  # noqa: ANN201
        self.broadcasts.append(self.spark.sparkContext.broadcast(value))
        return self.broadcasts[-1]

    def __exit__(self, *_: object) -> None:
        _scratches.open = _scratches.open[:-1]
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)
        for shared in self.broadcasts:
            shared.destroy()


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Caps what goes to Python at once: 10,000 long texts a batch, Spark's default, are too much for a small executor."""
    for key, value in (("maxRecordsPerBatch", min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) or rows)), ("maxBytesPerBatch", size)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_crc32(column: str) -> Column:
    return F.crc32(F.col(column).cast("binary"))


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; rows without an id fall into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def arrow_rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def ragged_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array out of flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binary_slices(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array out of flat bytes and the length of each value."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


#: Bits of a membership bitmap at most: 128 MB, however many members it has.
BITMAP_BITS = 1 << 30


class Bitmap:
    """Members by hash, in 32 bits for each of them, up to a fixed number of bits.

    A superset: a hash that collides counts as a member.  Users must be right with
    any superset, so that the bitmap may be broadcast at every input size.
    """

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bitmap:
        """Built on the executors from a written table; at most BITMAP_BITS / 8 bytes reach the driver."""
        size = min(max(1 << (32 * df.count()).bit_length(), 1 << 15), BITMAP_BITS)
        place = F.pmod(F.col(column), F.lit(size)) + 1
        rows = df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).select("bucket", "bits")
        bits = np.zeros(size // 8, np.uint8)
        for bucket, part in rows.collect():
            at = (bucket - 1) * len(part)
            bits[at : at + len(part)] = np.frombuffer(part, np.uint8)
        return cls(bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def release() -> None:
    """Gives memory that is no longer used back to the machine: idle workers live on beside those that work."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def each_batch(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function that calls ``f`` on every batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
        release()

    return run
