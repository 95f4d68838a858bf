"""Files below a folder with their sizes, listed by the tasks, one folder a row.

The driver sees how many folders a level of the tree has, not what is in them.
"""

from __future__ import annotations

import fnmatch
import itertools
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.session import shared_root

BATCH = 4096
LISTED = "path string, length bigint, folder boolean"
# Bytes of files that one task reads, and that a batch of them holds, or one file.
TASK_BYTES, READ_BYTES = 1 << 26, 1 << 22
# Files that one task opens at most.
TASK_FILES = 20_000


def patterns(glob: str) -> list[str]:
    """A glob with alternatives in braces as plain globs."""
    parts = [p[1:-1].split(",") if p.startswith("{") else [p] for p in re.split(r"(\{[^{}]*\})", glob) if p]
    return ["".join(x) for x in itertools.product(*parts)]


def shown(name: str) -> bool:
    """Names that begin with a dot or an underscore are hidden, as they are for Spark's readers."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def opened(folder: str):
    """File system and path in it of a folder that Spark names."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", folder))


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    if folder.startswith("file:"):
        with os.scandir(re.sub("^file:/*", "/", folder)) as found:
            for e in found:
                yield e.name, 0 if e.is_dir() else e.stat().st_size, e.is_dir()
    else:
        store, inner = opened(folder)
        for e in store.get_file_info(fs.FileSelector(inner)):
            yield e.base_name, e.size or 0, e.type == fs.FileType.Directory


def _listed(folders: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column("path").to_pylist():
                found = ((f"{folder}/{name}", size, is_folder) for name, size, is_folder in _entries(folder) if shown(name))
                while rows := list(itertools.islice(found, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "length", "folder"])

    return folders.select("path").mapInArrow(run, LISTED)


def list_files(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """path and length of every file, empty ones included, in a folder (or what a glob names), below it with `recursive`.

    `pattern` is a glob on file names, with alternatives in braces.  Each level
    of folders is one job, written to the session's shared folder.  Hidden names
    are left out.  A path that names nothing is an error.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    roots = [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in files.globStatus(where) or ()]
    if not roots:
        raise FileNotFoundError(path)
    out = f"{shared_root(spark)}/listing-{uuid.uuid4().hex}"
    level = spark.createDataFrame(roots, LISTED)
    depth, names = 0, [re.compile(fnmatch.translate(p)) for p in patterns(pattern)] if pattern else None
    level.write.parquet(f"{out}/{depth}")
    many = sum(r[2] for r in roots)
    while many and (recursive or not depth):
        folders = spark.read.parquet(f"{out}/{depth}").where("folder")
        depth += 1
        tasks = min(many, 4 * spark.sparkContext.defaultParallelism)
        _listed(folders.repartition(tasks)).write.parquet(f"{out}/{depth}")
        many = spark.read.parquet(f"{out}/{depth}").where("folder").count()
    found = spark.read.schema(LISTED).parquet(*[f"{out}/{d}" for d in range(depth + 1)]).where("not folder").select("path", "length")
    if names:
        name = F.element_at(F.split("path", "/"), -1)
        found = found.where(name.rlike("|".join(f"(?:{_java(n.pattern)})" for n in names)))
    return found


def contents(files: DataFrame) -> DataFrame:
    """path, length and content of listed files (path, length), read by the tasks; the driver sees their number and size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, bytes]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            paths, lengths, read = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(lengths, pa.int64()), pa.array(read, pa.binary())], ["path", "length", "content"])

        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                if held and size + length > READ_BYTES:
                    yield packed()
                    held, size = [], 0
                held.append((path, length, _bytes(path)))
                size += length
        if held:
            yield packed()

    many, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES, many // TASK_FILES)
    return files.select("path", "length").repartition(tasks, "path").mapInArrow(run, "path string, length bigint, content binary")


def _bytes(path: str) -> bytes:
    if path.startswith("file:"):
        with open(re.sub("^file:/*", "/", path), "rb") as file:
            return file.read()
    store, inner = opened(path)
    with store.open_input_stream(inner) as file:
        return file.read()


def _java(translated: str) -> str:
    """A pattern made by fnmatch, for a matcher that looks for it anywhere."""
    inner = re.sub(r"\\[Zz]$", "", translated)
    return f"^{inner}$"
