"""Table sinks: database creation, overwrite, append, and the destination writer.

An append destination without a path is a view over a partitioned table ``<target>__rows_<n>``: each batch of a writer owns one
partition (``__writer``, ``__batch``), which a replayed micro-batch overwrites, and the view leaves the two columns out.  A refresh
fills a table of its own and then replaces the view, so readers see the old rows or the new ones.
"""

from __future__ import annotations

import hashlib
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sinks import batches
from sluice.sinks.upsert_store import UpsertStore


def table_name(catalog: str | None, schema: str | None, name: str) -> str:
    """Map a three-level name onto the session catalog (``<catalog>__<schema>.<name>``).

    The built-in catalog takes single-part namespaces only; a registered
    catalog of that name is used directly.
    """
    if not schema:
        return name
    if catalog:
        return f"`{catalog}__{schema}`.`{name}`"
    return f"`{schema}`.`{name}`"


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def overwrite_table(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> None:
    """Replace a table's rows and schema."""
    w = df.write.mode("overwrite").format(fmt)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def append(df: DataFrame, name: str | None = None, path: str | None = None) -> None:
    """Append rows to a named table (created on first write), or to a path as a batch of its own."""
    if name:
        df.write.mode("append").format("parquet").saveAsTable(name)
    elif path:
        batches.write_batch(df, path, batches.run_writer())
    else:
        raise ValueError("append needs a table name or a path")


def _field(dest: Mapping, key: str):
    try:
        return dest[key]
    except (KeyError, ValueError):
        return None


def destination_tag(dest: Mapping) -> str:
    """A short folder-safe digest of a destination's name."""
    names = [_field(dest, k) for k in ("target_catalog_name", "target_schema_name", "target", "origin")]
    return hashlib.sha1("\0".join(n or "" for n in names).encode()).hexdigest()[:12]


def destination_table(spark: SparkSession, dest: Mapping) -> str:
    """Catalog name of a destination without a path: ``<catalog>__<schema>.<target>``
    (the database is created on first use); just ``target`` without an identity."""
    catalog, schema = _field(dest, "target_catalog_name"), _field(dest, "target_schema_name")
    if schema:
        create_database(spark, f"{catalog}__{schema}" if catalog else schema)
    return table_name(catalog, schema, dest["target"])


# ---------------------------------------------------------------- append destinations in the catalog

_ROWS = "sluice.rows"  # view property: the table that holds the rows


def _kind_of(spark: SparkSession, name: str) -> str | None:
    if not spark.catalog.tableExists(name):
        return None
    return "view" if spark.catalog.getTable(name).tableType == "VIEW" else "table"


def _rows_of(spark: SparkSession, view: str) -> str | None:
    """The table under a destination's view (``None`` for a view of someone else's)."""
    row = spark.sql(f"SHOW TBLPROPERTIES {view}").filter(F.col("key") == _ROWS).first()
    return row["value"] if row else None


def _rows_name(view: str, tag: str) -> str:
    """``db.target`` -> ``db.target__rows_<tag>``."""
    head, _, last = view.rpartition(".")
    last = f"`{last.strip('`')}__rows_{tag}`"
    return f"{head}.{last}" if head else last


def _show(spark: SparkSession, view: str, rows: str) -> None:
    names = ", ".join(f"`{c}`" for c in spark.table(rows).columns if c not in (batches.WRITER, batches.BATCH))
    spark.sql(f"CREATE OR REPLACE VIEW {view} TBLPROPERTIES ('{_ROWS}' = '{rows}') AS SELECT {names} FROM {rows}")


def _tag(writer: str) -> str:
    return hashlib.sha1(writer.encode()).hexdigest()[:12]


def check_table_destination(spark: SparkSession, name: str) -> None:
    """Refuse, before anything runs, a table that micro-batches cannot be appended to once and only once."""
    kind = _kind_of(spark, name)
    if kind == "table" or kind == "view" and _rows_of(spark, name) is None:
        raise ValueError(f"{name} was made elsewhere: a stream cannot replay micro-batches into it; give the destination a path or another name")


def append_batch(df: DataFrame, name: str, writer: str, batch_id: int = 0, staged: bool = False) -> None:
    """Write one batch into its own partition of a table destination, replacing an earlier attempt at it.

    ``staged`` writes beside the rows in use, for :func:`switch_table`.
    """
    spark = df.sparkSession
    check_table_destination(spark, name)
    taken = {batches.WRITER, batches.BATCH} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"reserved column names: {', '.join(sorted(taken))}")
    shown = _rows_of(spark, name) if _kind_of(spark, name) else None
    rows = _rows_name(name, _tag(writer)) if staged or shown is None else shown
    given = batches._nullable(df.schema)
    if not spark.catalog.tableExists(rows):
        (spark.createDataFrame([], given).withColumn(batches.WRITER, F.lit("")).withColumn(batches.BATCH, F.lit(0).cast("long"))
         .write.mode("ignore").format("parquet").partitionBy(batches.WRITER, batches.BATCH).saveAsTable(rows))
    stored = batches._nullable(spark.table(rows).drop(batches.WRITER, batches.BATCH).schema)
    batches.check_schema(stored, given)
    known = {f.name.lower() for f in stored.fields}
    more = [f for f in given.fields if f.name.lower() not in known]
    if more:
        spark.sql(f"ALTER TABLE {rows} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in more)})")
    have = {c.lower(): c for c in df.columns}
    columns = [F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name)
               for f in [*stored.fields, *more]]
    spark.sql(f"INSERT OVERWRITE TABLE {rows} PARTITION ({batches.WRITER} = '{writer}', {batches.BATCH} = {int(batch_id)}) SELECT * FROM {{batch}}",
              batch=df.select(*columns))
    if not staged and (shown is None or more):
        _show(spark, name, rows)


def switch_table(spark: SparkSession, name: str, writer: str) -> None:
    """Show the staged rows of ``writer`` instead of those in use.  Safe to repeat after a loss at any point."""
    rows = _rows_name(name, _tag(writer))
    shown = _rows_of(spark, name) if _kind_of(spark, name) else None
    if not spark.catalog.tableExists(rows):
        if shown is None:
            return
        # a refresh without rows: an empty table in place of the old one
        spark.table(shown).limit(0).write.format("parquet").partitionBy(batches.WRITER, batches.BATCH).saveAsTable(rows)
    if shown != rows:
        _show(spark, name, rows)
        if shown:
            spark.sql(f"DROP TABLE IF EXISTS {shown}")


def upsert_store_for(spark: SparkSession, dest: Mapping) -> UpsertStore:
    path = _field(dest, "path")
    if not path:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        catalog, schema = _field(dest, "target_catalog_name"), _field(dest, "target_schema_name")
        folder = "__".join(x for x in (catalog, schema) if x)
        path = f"{warehouse}/upsert/{folder + '/' if folder else ''}{dest['target']}"
    return UpsertStore(spark, path, list(dest["keys"]), dest["sequence_by"])


def read_destination(spark: SparkSession, dest: Mapping) -> DataFrame | None:
    """Current rows of a declared destination (``None`` before its first write to a path)."""
    if dest["mode"] == "upsert":
        return upsert_store_for(spark, dest).read()
    path = _field(dest, "path")
    return batches.read_batches(spark, path) if path else spark.table(destination_table(spark, dest))


def _staged(path: str) -> str:
    return f"{path.rstrip('/')}/{batches.STAGE}"


def write_destination(df: DataFrame, dest: Mapping, full_refresh: bool = False, writer: str | None = None,
                      batch_id: int = 0, arrived: int | None = None, running: bool = False, staged: bool = False) -> None:
    """Write one destination stage: ``append`` or ``upsert`` (keys + sequence_by).

    ``full_refresh`` replaces the target's rows instead of adding to them; ``writer`` and ``batch_id`` name a
    streaming micro-batch, which replaces an earlier attempt at itself (``arrived`` and ``running``: see
    :meth:`UpsertStore.merge`).  ``staged`` writes a micro-batch of a refresh beside the rows in use.
    """
    mode, spark = dest["mode"], df.sparkSession
    path = _field(dest, "path")
    if mode == "append" and path:
        batches.write_batch(df, _staged(path) if staged else path, writer or batches.run_writer(), batch_id, replace_all=full_refresh)
    elif mode == "append":
        name = destination_table(spark, dest)
        if writer is None and _kind_of(spark, name) == "table":  # a plain table of before: rows are added to it
            if full_refresh:
                overwrite_table(df, name)
            else:
                append(df, name=name)
            return
        writer = writer or batches.run_writer()
        append_batch(df, name, writer, batch_id, staged or full_refresh)
        if full_refresh:
            switch_table(spark, name, writer)
    elif mode == "upsert":
        store = upsert_store_for(spark, dest)
        if staged:
            store.path = _staged(store.path)
        store.merge(df, writer, batch_id, full_refresh, arrived, running)
    else:
        raise ValueError(f"unknown destination mode {mode!r}")


def start_destination_refresh(spark: SparkSession, dest: Mapping) -> None:
    """An empty place for the refreshed rows of a path or upsert destination (a table's rows have a table of their own)."""
    if dest["mode"] == "upsert":
        batches.start_refresh(spark, upsert_store_for(spark, dest).path)
    elif _field(dest, "path"):
        batches.start_refresh(spark, dest["path"])


def switch_destination(spark: SparkSession, dest: Mapping, writer: str) -> None:
    """Put the staged rows of a refresh in the place of those in use."""
    if dest["mode"] == "upsert":
        batches.switch(spark, upsert_store_for(spark, dest).path, writer)
    elif _field(dest, "path"):
        batches.switch(spark, dest["path"], writer)
    else:
        switch_table(spark, destination_table(spark, dest), writer)
