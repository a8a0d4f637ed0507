"""Path destinations: every batch owns one folder of plain parquet.

``<path>/__writer=<w>/__batch=<n>/`` holds batch ``n`` of writer ``w``.  A writer is one stream (the id Spark keeps in
its checkpoint, with the destination's name) or one batch run (a fresh id), so two streams or a stream and a
batch run never share a folder, and a replayed micro-batch replaces just its own.  ``<path>/_schema`` lists the distinct
schemas written (one line each), so a read needs no pass over footers: columns added later are NULL in older
batches, and a column whose type differs is refused before anything is written.

A **refresh** is staged beside the rows in use, in ``<path>/_refresh``, by one writer.  :func:`switch` puts it in their place: a
``_switch`` file names the new writer and the ones it replaces, then one rename makes the new rows visible and the old ones
invisible.  What is left to delete is deleted by whoever finishes the switch; a refresh that ends earlier changes nothing.

Folders are listed, renamed and deleted, and the small text files read, with the file system's own calls; data is read and written by Spark only.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WRITER = "__writer"
BATCH = "__batch"
STAGE = "_refresh"
SWITCH = "_switch"


class SchemaMismatch(ValueError):
    """A batch gives a stored column another type; nothing was written."""


# ---------------------------------------------------------------- folders

def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()]
    return [f"{path}/{n}" for n in sorted(names) if n.startswith(prefix)]


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file (``None`` if it is missing)."""
    raw = read_bytes(spark, path)
    return None if raw is None else raw.decode()


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place by a rename, whole or not at all."""
    fs, jpath = _fs(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(jpath, False)
    rename(spark, temporary.toString(), path)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, jpath = _fs(spark, old)
    if not fs.rename(jpath, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def batch_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of all batches, one listing per writer."""
    root = path.rstrip("/")
    return [b for w in _children(spark, root, f"{WRITER}=") for b in _children(spark, w, f"{BATCH}=")]


# ---------------------------------------------------------------- identities

def run_writer(kind: str = "run") -> str:
    """A writer of its own for one batch run."""
    return f"{kind}-{uuid.uuid4().hex}"


def stream_writer(spark: SparkSession, checkpoint: str, destination: str = "") -> str:
    """The writer of a stream: the id in its checkpoint's ``metadata`` file, and a digest of the destination's name.

    A stream restarted on its checkpoint keeps the id; a new or emptied checkpoint has a new one.
    """
    stream_id = json.loads(read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
    return f"stream-{stream_id}-{hashlib.sha1(destination.encode()).hexdigest()[:12]}"


def batch_time(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """When Spark first planned a micro-batch, in microseconds: its offset log, written before the batch runs, keeps that for replays.

    The log counts milliseconds; the batch's number tells batches of one millisecond apart.
    """
    lines = read_text(spark, f"{checkpoint.rstrip('/')}/offsets/{batch_id}").splitlines()
    return json.loads(lines[1])["batchTimestampMs"] * 1000 + batch_id % 1000


# ---------------------------------------------------------------- schemas

def _stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Union of all schemas written so far (lines are distinct schemas, so they are few)."""
    fs, log = _fs(spark, f"{path.rstrip('/')}/_schema")
    if not fs.exists(log):
        return None
    files = [s.getPath() for s in fs.listStatus(log) if s.isFile()]
    lines = {line for f in files if f.getName()[0] not in "._" for line in read_text(spark, f.toString()).splitlines() if line}
    fields: dict[str, T.StructField] = {}
    for line in sorted(lines):
        for f in T.StructType.fromJson(json.loads(line)).fields:
            fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
    return T.StructType(list(fields.values())) if fields else None


def _nullable(dtype: T.DataType) -> T.DataType:
    """``dtype`` as a file keeps it: everything nullable, no metadata."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_nullable(dtype.elementType), True)
    if isinstance(dtype, T.MapType):
        return T.MapType(_nullable(dtype.keyType), _nullable(dtype.valueType), True)
    return dtype


def check_schema(stored: T.StructType | None, new: T.StructType) -> None:
    known = {f.name.lower(): f.dataType for f in (stored.fields if stored is not None else [])}
    bad = [f"{f.name}: stored {known[f.name.lower()].simpleString()}, given {f.dataType.simpleString()}"
           for f in new.fields if f.name.lower() in known and known[f.name.lower()] != f.dataType]
    if bad:
        raise SchemaMismatch("; ".join(bad))


def _log_schema(df: DataFrame, path: str, schema: T.StructType, mode: str) -> None:
    (df.sparkSession.createDataFrame([(schema.json(),)], "value string").coalesce(1)
     .write.mode(mode).text(f"{path.rstrip('/')}/_schema"))


# ---------------------------------------------------------------- write and read

def write_batch(df: DataFrame, path: str, writer: str, batch_id: int = 0, replace_all: bool = False) -> None:
    """Write one batch into its own folder, replacing an earlier attempt at it.

    ``replace_all`` (full refresh) stages the batch and puts it in the place of all others once it is written; any type may change.
    Two first writers that give a column different types at one time are not told apart here; reads of their rows fail.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    if replace_all:
        start_refresh(spark, root)
        write_batch(df, f"{root}/{STAGE}", writer, batch_id)
        switch(spark, root, writer)
        return
    schema = _nullable(df.schema)
    taken = {WRITER, BATCH} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"reserved column names: {', '.join(sorted(taken))}")
    stored = _stored_schema(spark, root)
    check_schema(stored, schema)
    known = {f.name.lower() for f in stored.fields} if stored is not None else set()
    if any(f.name.lower() not in known for f in schema.fields):  # before the data: a reader must know a batch's columns
        _log_schema(df, root, schema, "append")
    df.write.mode("overwrite").parquet(f"{root}/{WRITER}={writer}/{BATCH}={batch_id}")


def start_refresh(spark: SparkSession, path: str) -> None:
    """An empty place for a refresh; what an earlier one left is finished or deleted."""
    root = path.rstrip("/")
    finish_switch(spark, root)
    delete_path(spark, f"{root}/{STAGE}")
    fs, staged = _fs(spark, f"{root}/{STAGE}")
    fs.mkdirs(staged)


def switch(spark: SparkSession, path: str, writer: str) -> None:
    """Put the staged rows of ``writer`` in the place of all others.  Safe to repeat after a loss at any point."""
    root = path.rstrip("/")
    if not path_exists(spark, f"{root}/{SWITCH}"):
        if not path_exists(spark, f"{root}/{STAGE}"):
            return  # done before
        older = [w.rsplit("/", 1)[1] for w in _children(spark, root, f"{WRITER}=")]
        write_text(spark, f"{root}/{SWITCH}", json.dumps({"writer": writer, "replaces": [w for w in older if w != f"{WRITER}={writer}"]}))
    finish_switch(spark, root)


def finish_switch(spark: SparkSession, path: str) -> None:
    """Do what is left of a switch that was begun."""
    root = path.rstrip("/")
    text = read_text(spark, f"{root}/{SWITCH}")
    if text is None:
        return
    plan = json.loads(text)
    name = f"{WRITER}={plan['writer']}"
    if not path_exists(spark, f"{root}/{name}"):
        fs, staged = _fs(spark, f"{root}/{STAGE}/{name}")
        if not fs.exists(staged):
            fs.mkdirs(staged)  # a refresh without rows
        rename(spark, f"{root}/{STAGE}/{name}", f"{root}/{name}")
    for older in plan["replaces"]:
        delete_path(spark, f"{root}/{older}")
    if path_exists(spark, f"{root}/{STAGE}/_schema"):
        delete_path(spark, f"{root}/_schema")
        rename(spark, f"{root}/{STAGE}/_schema", f"{root}/_schema")
    delete_path(spark, f"{root}/{STAGE}")
    delete_path(spark, f"{root}/{SWITCH}")


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of a path destination without the bookkeeping columns (``None`` before the first write)."""
    root = path.rstrip("/")
    begun, log, folders = read_text(spark, f"{root}/{SWITCH}"), root, [root]
    if begun is not None:
        plan = json.loads(begun)
        writers = _children(spark, root, f"{WRITER}=")
        if f"{root}/{WRITER}={plan['writer']}" in writers:  # renamed: what it replaces is no longer seen
            folders = [w for w in writers if w.rsplit("/", 1)[1] not in plan["replaces"]]
            log = f"{root}/{STAGE}" if path_exists(spark, f"{root}/{STAGE}/_schema") else root
    schema = _stored_schema(spark, log)
    if schema is None or not batch_folders(spark, root):
        return None
    return spark.read.schema(schema).option("basePath", root).parquet(*folders).select(
        *[f"`{f.name}`" for f in schema.fields])


def clear(spark: SparkSession, path: str) -> None:
    """Delete all batches, the schema list and a refresh under way."""
    root = path.rstrip("/")
    for folder in [f"{root}/{SWITCH}", *_children(spark, root, f"{WRITER}="), *_children(spark, root, "_")]:
        delete_path(spark, folder)
