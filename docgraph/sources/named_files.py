"""Lines in files of computed names, as a Spark data source: written as a whole or not at all, read by ranges of bytes.

`write(df, path, ...)` and `read(spark, path)` are what a job calls; `named_files` is the format they register.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docgraph.functions.session import ensure_checkpoint_dir

SCHEMA = "name string, at long, value string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it: a shared mount, or a store that Arrow reaches."""
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """The files of a folder by name, but for those that begin with _ or a dot."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name[0] not in "_."), key=lambda f: f.base_name)


def free_name(name: str, taken) -> str:
    """name, or the first of name__1, name__2 ... (before the ending) that is not taken."""
    stem, dot, end = name.partition(".")
    k, out = 0, name
    while taken(out):
        k += 1
        out = f"{stem}__{k}{dot}{end}"
    return out


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last) of what one task reads."""

    parts: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task attempt that wrote all its files."""

    task: int
    folder: str


class NamedFiles(DataSource):
    """Format `named_files`. Options: path; split_bytes, the most that one task reads (lines are never cut)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], overwrite)


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Ranges]:
        """Files cut into ranges of at most `split` bytes, small files together up to as many."""
        store, folder = opened(self.path)
        out, load = [Ranges([])], 0
        for f in _files(store, folder):
            for start in range(0, f.size, self.split):
                end = min(f.size, start + self.split)
                if out[-1].parts and load + end - start > self.split:
                    out.append(Ranges([]))
                    load = 0
                out[-1].parts.append((f.path, start, end))
                load += end - start
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """(name, at, value): the lines that begin within the ranges; `at` is a line's first byte."""
        store, _ = opened(self.path)
        for path, start, end in partition.parts:
            with store.open_input_file(path) as f:
                yield from _lines(f, os.path.basename(path), start, end)


def _lines(f, name: str, start: int, end: int, block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A block at a time, so a task holds one block and one line. It begins a byte early: what stands there, up to the line's
    end, is of the range before."""
    at = max(start - 1, 0)
    f.seek(at)
    pieces: list[bytes] = []
    while at < end:
        got = f.read(block)
        pieces.append(got)
        if got and b"\n" not in got:
            continue
        data = b"".join(pieces)
        cut = data.rfind(b"\n") + 1 if got else len(data)
        lines, pieces = data[:cut].split(b"\n"), [data[cut:]]
        if lines[-1] == b"":
            lines.pop()
        keep = []
        for line in lines:
            if start <= at < end:
                keep.append((at, line.decode("utf-8", "replace")))
            at += len(line) + 1
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep)), pa.array([p for p, _ in keep], pa.int64()), pa.array([x for _, x in keep])], ["name", "at", "value"])
        if not got:
            return


class Writer(DataSourceArrowWriter):
    """Each task writes its files into a folder of its own attempt; the commit moves those of the attempts that count into place.

    An attempt that failed, or was lost with its executor, leaves nothing but a folder beside, which commit and abort remove.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Columns name, value and perhaps group: adjacent rows of one name and group are the lines of one file."""
        store, folder = opened(self.path)
        at = TaskContext.get()
        here = f"{folder}/{self.staging}/{at.partitionId()}-{at.taskAttemptId()}"
        out, last, k = None, None, 0
        try:
            for batch in batches:
                names, values = batch.column("name").to_pylist(), batch.column("value").to_pylist()
                groups = batch.column("group").to_pylist() if "group" in batch.schema.names else names
                for name, group, value in zip(names, groups, values):
                    name = name or "unnamed"
                    if out is None or (name, group) != last:
                        if "/" in name or name[0] in "_.":
                            raise ValueError(f"not a file name: {name!r}")
                        if out is None:
                            store.create_dir(here, recursive=True)
                        else:
                            out.close()
                        out, last, k = store.open_output_stream(f"{here}/{k:09d}-{name}"), (name, group), k + 1
                    out.write((value or "").encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(at.partitionId(), here if k else "")

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        before = [f.path for f in _files(store, folder)]
        if self.overwrite:
            for path in before:
                store.delete_file(path)
            before = []
        taken = {os.path.basename(p) for p in before}
        moves = []
        for m in sorted((m for m in messages if m and m.folder), key=lambda m: m.task):
            for f in sorted(store.get_file_info(fs.FileSelector(m.folder)), key=lambda f: f.base_name):
                name = free_name(f.base_name.split("-", 1)[1], taken.__contains__)
                taken.add(name)
                moves.append((f.path, f"{folder}/{name}"))
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(*x), moves))
        self._clear(store, folder)
        store.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        there = f"{folder}/{self.staging}"
        if store.get_file_info(there).type == fs.FileType.Directory:
            store.delete_dir(there)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def write(df: DataFrame, path: str, name: str, value, order: list[str], most: int = 100_000, ending: str = "", spread=None, mode: str = "append") -> None:
    """Writes each group of `name` as the lines `value` of a file of that name, in `order`.

    A group of more than `most` rows, however large, is spread over ceil(rows / most) files name, name__1, name__2 ..., by
    `spread` (a whole number; a hash of `order` if not given), so no task writes a whole hot group. A name that is taken, by
    an earlier write or by another group's part, gets the next free suffix. Null and empty names are written as `unnamed`;
    null values as empty lines; a value with line breaks becomes several lines. An empty table writes no file. A name with a
    slash, or that begins with _ or a dot, ends the write, and no file stays. The commit lists names on the driver: files,
    not rows, are what it grows with. Needs a path that driver and executors reach through Arrow's file systems.
    """
    _register(df.sparkSession)
    key = F.coalesce(F.nullif(F.col(f"`{name}`").cast("string"), F.lit("")), F.lit("unnamed"))
    rows = df.select(key.alias("__name"), (F.xxhash64(*[f"`{c}`" for c in order]) if spread is None else spread).alias("__spread"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("__order"), value.alias("value"))
    counted = f"{ensure_checkpoint_dir(df.sparkSession)}/named-sizes-{uuid.uuid4().hex}"
    rows.groupBy(F.col("__name").alias("__of")).agg(F.count("*").alias("__n")).write.parquet(counted)
    sizes = df.sparkSession.read.parquet(counted)  # a table of known size: Spark broadcasts it only where it is small
    part = F.pmod(F.coalesce("__spread", F.lit(0)), F.ceil(F.col("__n") / most)).cast("long")
    rows = rows.join(sizes, F.col("__name") == F.col("__of")).withColumn("__part", part)
    named = F.concat("__name", F.when(F.col("__part") > 0, F.concat(F.lit("__"), F.col("__part").cast("string"))).otherwise(""), F.lit(ending))
    rows = rows.repartition("__name", "__part").sortWithinPartitions("__name", "__part", "__order")
    rows.select(named.alias("name"), "value", F.concat_ws("/", "__part", "__name").alias("group")).write.format("named_files").mode(mode).save(path)


def read(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(name, at, value): every line of every file of a folder with the file's name and the line's first byte.

    Large files are read in ranges by several tasks, small ones together by one. Empty files and an empty or absent folder
    give no rows; bytes that are not UTF-8 become replacement characters.
    """
    _register(spark)
    return spark.read.format("named_files").option("split_bytes", split_bytes).load(path)
