"""Small helpers shared by the training-text operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.session import ensure_checkpoint_dir

#: ASCII white space as the operators' word rules name it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """What is materialised inside leaves no shuffle files behind once it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.checkpoint(eager=True)


def unsent(df: DataFrame) -> DataFrame:
    """df, of which a join shuffles both sides. Spark judges by compressed sizes, and would send through the driver tables that
    grow with the input and are many times larger there."""
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """df, of narrow rows and few a key, whose shuffled parts a join holds as hash tables: the other side's rows are not sorted."""
    return df.hint("shuffle_hash")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark can write."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Tables:
    """The intermediate tables of one job, as Parquet in the shared checkpoint folder: a lost executor costs none of them.

    A table that no later step reads is dropped. Those behind the job's result stay, since Spark reads them when it asks for
    the result.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.base, self.n = spark, f"{ensure_checkpoint_dir(spark)}/{job}-{uuid.uuid4().hex}", 0

    def keep(self, *parts: DataFrame) -> DataFrame:
        """The parts' rows as one table. Parts are written one after the other, each with no more shuffle files than its own."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        for df in parts:
            with _shuffles_freed(self.spark):
                df.write.mode("append").parquet(path)
        out = self.spark.read.schema(parts[0].schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove_folder(self.spark, t.kept_at)


def words_of(text) -> F.Column:
    """The non-space runs of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and len + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def row_slices(off: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of at most so many bytes, or of one row where that is longer: bounds a task's scratch memory."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def texts_of(batch: pa.RecordBatch, name: str = "text"):
    """Each row's text as bytes, null as empty."""
    buf, off = utf8(batch.column(batch.schema.get_field_index(name)))
    data = memoryview(buf)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield bytes(data[a:b])
