"""What several of these operators need: tables in the shared folder and byte views of Arrow texts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20

_LEFT: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all tasks are local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="clauselake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write rows once to the shared folder and read them from there: computed once, safe from lost executors.

    The folders are deleted when the driver's Python ends.
    """
    spark = rows.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _LEFT.append((spark, path))
    return spark.read.schema(rows.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _LEFT:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except (Py4JError, Py4JNetworkError, AttributeError, OSError):  # the session has ended before
            return


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about `most` bytes; a longer text is a slice of its own."""
    for batch in batches:
        size = np.zeros(batch.num_rows + 1, np.int64)
        lengths = pc.binary_length(batch.column(column)).fill_null(0)
        np.cumsum(lengths.to_numpy(zero_copy_only=False), out=size[1:])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, size[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes after each other, and where each text starts (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def bucket_count(spark: SparkSession, per_task: int = 4) -> int:
    """Some buckets for every task of a shuffle, so that they spread evenly."""
    return per_task * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
