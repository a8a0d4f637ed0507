"""A persisted upsert destination: appended batches, reduced to the latest row per key when read.

* ``merge`` only appends (see :mod:`sluice.sinks.batches`), so its cost is that of the batch, whatever the table holds;
  batches of several streams and runs lie side by side and a replayed one replaces itself.
* ``read`` is :func:`latest_per_key` over all batches: one shuffle by key, with at most one row per key and
  map task (partial ``WindowGroupLimit``), so a hot key stays small.
* Each batch is reduced by the same operator before it is written, and carries the time of its first arrival: on an
  equal sequence the batch that came later wins, as :func:`upsert` has it for an incoming batch.  A replay keeps the time of the
  first attempt: a stream's comes from Spark's offset log, another caller's from the rows that the replay replaces.
* Rows of a **running** aggregate (update mode) stand for the whole group so far: of one writer's rows of a key only the last
  that arrived counts, whatever its sequence; then the writers' rows are compared as any others.
* ``compact``, run apart from the streams, writes the current rows as one batch and then deletes the
  batches it read.  Between the two steps a reader sees rows twice, which ``latest_per_key`` takes for one; a lost
  job leaves a right table behind.

A column added by a later batch is NULL in earlier rows; a column or key of another type is refused.
"""

from __future__ import annotations

import time
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.upsert import latest_per_key, upsert
from sluice.sinks import batches

ARRIVED = "__arrived"
RUNNING = "__running"


class UpsertStore:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sequence_by: str):
        if not keys or not sequence_by:
            raise ValueError("upsert needs keys and sequence_by")
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.sequence_by = sequence_by

    def _latest(self) -> DataFrame | None:
        stored = batches.read_batches(self.spark, self.path)
        if stored is None:
            return None
        rows = stored.withColumnRenamed(ARRIVED, "__src")  # the operator's own name: outside the tie-break by columns
        if RUNNING in rows.columns:
            last = latest_per_key(rows.filter(F.col(RUNNING).isNotNull()).withColumn("__at", F.col("__src")), [*self.keys, RUNNING], "__at").drop("__at")
            rows = rows.filter(F.col(RUNNING).isNull()).unionByName(last)
        return latest_per_key(rows, self.keys, self.sequence_by, prefer=[F.col("__src").desc()])

    def read(self) -> DataFrame | None:
        """Current rows (``None`` for a store never written to)."""
        latest = self._latest()
        return None if latest is None else latest.drop("__src", RUNNING)

    def _first_arrival(self, writer: str, batch_id: int) -> int | None:
        """Arrival of the attempt that a replay replaces (an attempt without rows has none, and needs none)."""
        folder = f"{self.path}/{batches.WRITER}={writer}/{batches.BATCH}={batch_id}"
        if not batches.path_exists(self.spark, folder):
            return None
        row = self.spark.read.schema(f"{ARRIVED} long").parquet(folder).first()
        return row[ARRIVED] if row else None

    def merge(self, batch: DataFrame, writer: str | None = None, batch_id: int = 0, replace_all: bool = False,
              arrived: int | None = None, running: bool = False) -> None:
        """Add ``batch``.  ``writer`` and ``batch_id`` name a micro-batch, which replaces its earlier attempt and keeps its arrival
        (``arrived``, in microseconds, where the caller knows it); without a writer the call is a run of its own.  ``running`` marks
        rows of a running aggregate."""
        if arrived is None:
            arrived = (self._first_arrival(writer, batch_id) if writer else None) or time.time_ns() // 1000
        rows = upsert(None, batch, self.keys, self.sequence_by).withColumn(ARRIVED, F.lit(arrived).cast("long"))
        if running:
            rows = rows.withColumn(RUNNING, F.lit(writer))
        batches.write_batch(rows, self.path, writer or batches.run_writer(), batch_id, replace_all)

    def compact(self) -> int:
        """Replace all present batches by one with the current rows; returns how many were replaced."""
        older = batches.batch_folders(self.spark, self.path)
        if len(older) < 2:
            return 0
        batches.write_batch(self._latest().withColumnRenamed("__src", ARRIVED), self.path, batches.run_writer("compact"))
        for folder in older:
            batches.delete_path(self.spark, folder)
        return len(older)

    def truncate(self) -> None:
        batches.clear(self.spark, self.path)
