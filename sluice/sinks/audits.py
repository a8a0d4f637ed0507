"""Rule counts of a run or micro-batch as an audit table."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sinks import batches

AUDIT_DDL = ("run_id string, batch_id long, stage string, rule string, action string, "
             "checked long, violations long")


def write_counts(spark: SparkSession, counts: Mapping[str, Sequence[tuple]], path: str, run_id: str | None = None,
                 batch_id: int | None = None) -> None:
    """One row per stage and rule (few: stages x rules); a replayed micro-batch replaces its rows."""
    run_id = run_id or batches.run_writer()
    rows = [(run_id, batch_id, stage, *item) for stage, items in counts.items() for item in items]
    frame = spark.createDataFrame(rows, AUDIT_DDL).withColumn("recorded_at", F.current_timestamp())
    batches.write_batch(frame.coalesce(1), path, run_id, batch_id or 0)


def read_counts(spark: SparkSession, path: str) -> DataFrame | None:
    return batches.read_batches(spark, path)
