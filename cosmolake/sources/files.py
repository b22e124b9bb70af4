"""Files by path: listing through Spark, reading in tasks through pyarrow's file systems, bounded pieces at a time."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.session import ship

ROWS = 65_536  #: Rows of a batch that a reader yields.


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of the files under a path or glob; contents aren't read."""
    ship(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def stream(path: str) -> io.BufferedReader:
    """A file from its start, inflated if its name ends in .gz."""
    system, at = opened(path)
    raw = system.open_input_stream(at, compression=None)
    return gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)


def lines(paths: list[str]) -> Iterator[str]:
    """The lines of files that follow each other, without their ends."""
    for p in paths:
        with stream(p) as f:
            for line in io.TextIOWrapper(f, encoding="utf-8"):
                yield line.rstrip("\r\n")


def batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int = ROWS) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, kinds, names)
            held = []
    yield _batch(held, kinds, names)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def parsed(spark: SparkSession, path: str | list[str], schema: str, parse: Callable[[Iterator[str]], Iterator[tuple]], whole: bool = False) -> DataFrame:
    """Rows that ``parse`` makes of each file's lines, one task a file; ``whole`` takes a folder's parts as one file in the order of their names.

    ``schema`` is a DDL string of simple types; a column ``file`` with the
    file's (or folder's) path comes first.
    """
    fields = [f.split() for f in schema.split(",")]
    names, kinds = ["file", *(f[0] for f in fields)], [pa.string(), *(_ARROW[f[1]] for f in fields)]
    files = listed(spark, path).where("length > 0")
    folder = F.regexp_replace("path", "/[^/]*$", "") if whole else F.col("path")
    groups = files.groupBy(folder.alias("file")).agg(F.sort_array(F.collect_list("path")).alias("paths"))

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for name, paths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from batches(((name, *row) for row in parse(lines(paths))), kinds, names)

    return groups.repartition(4 * spark.sparkContext.defaultParallelism, "file").mapInArrow(task, "file string, " + schema)
