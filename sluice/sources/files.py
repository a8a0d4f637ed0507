"""Many small files: folders are listed and files read inside tasks.

Spark's reader starts a task per folder and gathers the status of every file on the driver.  A configuration tree has a folder per
pipeline, so here each level of folders is dealt over a bounded number of tasks, and paths and contents stay on the executors.
Paths are taken as written (no globs, no ``%`` decoding).  Stores that pyarrow cannot open are left to Spark's reader (:func:`reachable`).
"""

from __future__ import annotations

import functools
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.session import scratch_root
from sluice.sinks.batches import _fs

# --- fixed values: a task's rows or bytes that go on together, and the files and bytes meant for one task
BATCH_ROWS, BATCH_BYTES, TASK_FILES, TASK_BYTES = 5000, 16 << 20, 200, 32 << 20

ENTRY_DDL = "path string, is_dir boolean, size long"
CONTENT_DDL = "path string, kind string, content binary"


@functools.lru_cache(maxsize=64)
def _open(prefix: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(f"{prefix}/")


def _store(path: str, default: str):
    """The file system of a path, and the path within it; ``default`` is the store of paths without a scheme."""
    from pyarrow import fs
    whole = f"{default.rstrip('/')}{path}" if path.startswith("/") else path
    if re.match("file:/", whole):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", whole)
    prefix, rest = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(.*)", whole, re.S).groups()
    store, base = _open(prefix)
    return store, f"{base.rstrip('/')}/{rest.lstrip('/')}"


def default_store(spark: SparkSession) -> str:
    return _fs(spark, "/")[0].getUri().toString()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and without doubled or trailing slashes, as Spark's reader names it."""
    fs, jpath = _fs(spark, path)
    return fs.makeQualified(jpath).toString()


def reachable(top: str) -> bool:
    """Whether tasks can list a (qualified) folder by themselves."""
    from pyarrow import fs
    try:
        store, inner = _store(top, "file:")
        return store.get_file_info(inner).type == fs.FileType.Directory
    except Exception:  # noqa: BLE001 - an unknown scheme or a store that needs Spark's settings
        return False


def tasks_for(spark: SparkSession, files: int, size: int = 0) -> int:
    """Tasks for so many folders or files of so many bytes: as many as a shuffle has at most, unless the bytes need more."""
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(-(-files // TASK_FILES), most), min(size // TASK_BYTES, files))


def hidden(path: Column | str) -> Column:
    """Names that Spark's readers skip."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.startswith(".") | (name.startswith("_") & ~name.contains("=")) | name.endswith("._COPYING_")


def _entries(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()),
                                           pa.array([r[2] for r in rows], pa.int64())], ["path", "is_dir", "size"])
    rows = []
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inner = _store(path, default)
            for e in store.get_file_info(fs.FileSelector(inner)):
                if e.type in (fs.FileType.Directory, fs.FileType.File):
                    rows.append((f"{path.rstrip('/')}/{e.base_name}", e.type == fs.FileType.Directory, e.size))
                if len(rows) >= BATCH_ROWS:
                    yield out(rows)
                    rows = []
    yield out(rows)


def list_files(spark: SparkSession, top: str, with_hidden: bool = False, depth: int | None = None) -> DataFrame:
    """``path, size, depth`` of the files below a folder (``depth`` 0: in it), listed level by level, down to ``depth`` if it is given."""
    default, root, levels, found = default_store(spark), scratch_root(spark, "listing"), [], 1
    folders = spark.range(1).select(F.lit(top).alias("path"))
    while found and (depth is None or len(levels) <= depth):
        seen, level = Observation(), f"{root}/level-{len(levels)}"
        entries = folders.repartition(tasks_for(spark, found)).mapInArrow(functools.partial(_entries, default=default), ENTRY_DDL)
        if not with_hidden:
            entries = entries.filter(~hidden("path"))
        (entries.withColumn("depth", F.lit(len(levels))).observe(seen, F.count_if(F.col("is_dir")).alias("folders"))
         .write.parquet(level))
        folders = spark.read.schema(f"{ENTRY_DDL}, depth int").parquet(level).filter("is_dir").select("path")
        levels.append(level)
        found = seen.get["folders"]
    return spark.read.schema(f"{ENTRY_DDL}, depth int").parquet(*levels).filter("NOT is_dir").select("path", "size", "depth")


def _content(path: str, default: str) -> tuple[str, bytes | None]:
    from pyarrow import fs
    try:
        store, inner = _store(path, default)
        info = store.get_file_info(inner)
    except Exception:  # noqa: BLE001 - left to Spark's reader, which says what is wrong
        return "other", None
    if info.type == fs.FileType.NotFound:
        return "missing", None
    if info.type != fs.FileType.File:
        return "folder", None
    with store.open_input_stream(inner, compression=None) as f:
        return "file", f.read()


def _contents(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                           pa.array([r[2] for r in rows], pa.binary())], ["path", "kind", "content"])
    rows, held = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows.append((path, *_content(path, default)))
            held += len(rows[-1][2] or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield out(rows)
                rows, held = [], 0
    yield out(rows)


def look_up(files: DataFrame) -> DataFrame:
    """``path, kind, content`` of paths (``path``, and ``size`` if known): ``file``, ``missing``, ``folder``, or ``other`` for a store that tasks cannot open."""
    spark = files.sparkSession
    size = F.sum("size") if "size" in files.columns else F.lit(0)
    n, held = files.agg(F.count(F.lit(1)), size).first()
    return files.select("path").repartition(tasks_for(spark, n, held or 0)).mapInArrow(functools.partial(_contents, default=default_store(spark)), CONTENT_DDL)


def read_files(files: DataFrame) -> DataFrame:
    """``path, content`` of listed files; one that is gone by now is an error."""
    gone = F.raise_error(F.concat(F.lit("listed, but not readable as a file: "), "path")).cast("binary")
    return look_up(files).select("path", F.when(F.col("kind") == "file", F.col("content")).otherwise(gone).alias("content"))
