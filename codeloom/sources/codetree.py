"""A data source that reads a tree of source files: spark.read.format("codetree").load(path).

Spark's own file listing hides names that begin with _ or a dot, such as __init__.py, hence a
source of its own. The driver walks the tree, pruning ignored folders as it goes, and deals
files to partitions of about equal bytes; contents are read by the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom import schemas
from codeloom.functions import columns as C

#: Bytes in a partition, and in an Arrow batch, about.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 8 << 20
#: Rows of a table that one task makes files of.
TASK_ROWS = 2000


def walk(root: str, extensions: tuple[str, ...], ignored: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """(path, size) of the files whose name ends in an extension, case as given; no component of the path may be an ignored name."""
    root = os.path.normpath(root)
    names = set(ignored)
    if names & set(root.split("/")):
        return
    for folder, below, files in os.walk(root):
        below[:] = sorted(d for d in below if d not in names)
        for name in sorted(files):
            if name not in names and name.endswith(extensions):
                path = os.path.join(folder, name)
                try:
                    if os.path.isfile(path):
                        yield path, os.path.getsize(path)
                except OSError:
                    continue


def decode(raw: bytes) -> str | None:
    """Strict UTF-8 with universal newlines, or None."""
    try:
        return raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class CodeTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.extensions = C.normalised_extensions(options.get("extensions"))
        self.ignored = C.ignored_names(x for x in options.get("ignoredirs", "").split(",") if x)
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held, size = [], 0
        for path, n in walk(self.root, self.extensions, self.ignored):
            if held and size + n > self.partition_bytes:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n + 4096
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            ext = os.path.splitext(path)[1]
            rows.append((path, ext, C.LANGUAGES.get(ext.lower()), decode(raw), raw))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "ext", "language", "content", "bytes"])


class CodeTree(DataSource):
    """Options: path; extensions and ignoreDirs, separated by commas; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return schemas.FILES

    def reader(self, schema) -> CodeTreeReader:
        return CodeTreeReader(self.options)


def read_tree(spark: SparkSession, path: str, extensions=None, ignore_dirs=None) -> DataFrame:
    """The files table of a tree that driver and executors see under one path."""
    if not os.path.isdir(path):
        raise ValueError(f"no such directory: {path}")
    spark.dataSource.register(CodeTree)
    options = {"extensions": ",".join(C.normalised_extensions(extensions)), "ignoreDirs": ",".join(ignore_dirs or ())}
    return spark.read.format("codetree").options(**options).load(path)


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """df in partitions of about so many rows. Spark cuts tables by their bytes, which say nothing of the work on texts made of a few
    narrow columns: a million rows may be one partition, parsed by one core."""
    return df.repartition(max(1, -(-df.count() // rows)))


def from_table(df: DataFrame, path: Column, content: Column, language: Column | None = None) -> DataFrame:
    """The files table of any table with a path and a text."""
    text = F.regexp_replace(content, r"\r\n?", "\n")
    return df.select(path.alias("path"), C.extension(path).alias("ext"), (C.language(path) if language is None else language).alias("language"), text.alias("content"), F.encode(content, "UTF-8").alias("bytes"))
