"""Declared pipelines on Structured Streaming.

* run mode (``continuous``): false -> ``availableNow`` (process what is there,
  then stop); true -> ``processingTime`` micro-batches;
* append and upsert destinations -> ``foreachBatch``; a micro-batch owns the folder of its (stream, batch id), so
  a replay replaces it and other streams into the same destination are never touched;
* DROP rules filter on the stream; all rules are counted in one pass inside
  ``foreachBatch`` before the batch is written, if one is FAIL or the counts are asked for.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.quality import Rule, count_rules, drop_violations, raise_failures
from sluice.sinks import batches
from sluice.sinks.audits import write_counts
from sluice.sinks.upsert_store import UpsertStore
from sluice.sources.declared import read_source


def trigger_for(continuous: bool | str | None, interval: str = "1 minute") -> dict:
    """``continuous`` flag of the pipeline settings -> ``DataStreamWriter.trigger`` kwargs."""
    flag = str(continuous).strip().lower() in ("true", "1", "yes") if continuous is not None else False
    return {"processingTime": interval} if flag else {"availableNow": True}


def stream_source(spark: SparkSession, origin: str, datatype: str, params: str | Mapping | None = None,
                  schema=None) -> DataFrame:
    """Streaming read of a declared source (file sources need a schema)."""
    return read_source(spark, origin, datatype, params, stream=True, schema=schema)


def _audited(batch: DataFrame, batch_id: int, rules: Sequence[Rule], stage: str, writer: str,
             audit_path: str | None) -> DataFrame:
    """Count all rules of a micro-batch in one pass, record the counts, raise for FAIL; the rows that DROP keeps."""
    if any(r.action == "FAIL" for r in rules) or (rules and audit_path):
        counts = count_rules(batch, rules)
        if audit_path:
            write_counts(batch.sparkSession, {stage: counts}, audit_path, writer, batch_id)
        raise_failures(counts, stage)
    return drop_violations(batch, rules)


def append_stream(df: DataFrame, path: str, checkpoint: str, rules: Sequence[Rule] = (),
                  continuous: bool | str | None = False, interval: str = "1 minute",
                  audit_path: str | None = None) -> StreamingQuery:
    """Append a stream to a path destination; DROP rules filter rows, FAIL rules stop the batch.

    Rule counts (LOG too) go to ``audit_path``, once per micro-batch.
    """
    rules = list(rules)

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batches.stream_writer(batch.sparkSession, checkpoint, path)
        batches.write_batch(_audited(batch, batch_id, rules, path, writer, audit_path), path, writer, batch_id)

    return (df.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**trigger_for(continuous, interval)).foreachBatch(write).start())


def upsert_stream(df: DataFrame, store: UpsertStore, checkpoint: str, rules: Sequence[Rule] = (),
                  continuous: bool | str | None = False, interval: str = "1 minute",
                  audit_path: str | None = None) -> StreamingQuery:
    """Merge every micro-batch into an upsert store; a replayed one replaces itself."""
    rules = list(rules)

    def merge(batch: DataFrame, batch_id: int) -> None:
        writer = batches.stream_writer(batch.sparkSession, checkpoint, store.path)
        store.merge(_audited(batch, batch_id, rules, store.path, writer, audit_path), writer, batch_id,
                    arrived=batches.batch_time(batch.sparkSession, checkpoint, batch_id))

    return (df.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**trigger_for(continuous, interval)).foreachBatch(merge).start())
