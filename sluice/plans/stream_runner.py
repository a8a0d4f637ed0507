"""Declared pipelines on Structured Streaming.

Two ways, chosen by what the stages need:

* **Per micro-batch.**  One streamed source and stages that look at rows one by one (column maps, filters, SQL without
  aggregates, joins with static relations): every micro-batch goes through the stages as a batch run, one checkpoint for
  all destinations.  Rules are counted for each micro-batch and FAIL raises before anything of it is written.
* **Streaming plan.**  Several streamed sources, or a stage that needs all rows (aggregates, DISTINCT, joins of streams): the stages are built
  once over streaming frames, and Spark keeps the state.  Each destination is one query with a checkpoint of its own
  below the pipeline's; FAIL raises inside the query.  A running aggregate goes in update mode to an upsert destination whose keys are its group columns;
  everything else goes in append mode.  What Spark or a destination cannot do is refused before a query starts.

State of aggregates and stream joins grows with their keys; a ``watermark`` in a source's params (``ts 10 minutes``) bounds it
where Spark can.  Both ways a restart on the checkpoint goes on where the stream stopped, and a replayed micro-batch
replaces itself.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.quality import Rule, drop_violations
from sluice.plans.plan_tree import group_columns, refuse_unsupported, stateful_nodes
from sluice.plans.runner import PipelineRun, PipelineSpec, _get, _rules
from sluice.sinks import batches
from sluice.sinks.tables import (check_table_destination, destination_table, destination_tag, start_destination_refresh, switch_destination,
                                 write_destination)
from sluice.sources.declared import read_source
from sluice.streaming.stream import trigger_for


class UnsupportedStream(ValueError):
    """A pipeline that cannot run on a stream as it is declared; nothing was started."""


class StreamRun:
    """The queries of one pipeline on a stream."""

    def __init__(self, queries: Sequence[StreamingQuery]):
        self.queries = list(queries)

    @property
    def isActive(self) -> bool:
        return any(q.isActive for q in self.queries)

    def exception(self):
        return next((q.exception() for q in self.queries if q.exception() is not None), None)

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        """Wait for all queries.  If one fails, the others are stopped and its error is raised."""
        try:
            done = [q.awaitTermination(timeout) if timeout is not None else q.awaitTermination() for q in self.queries]
        except Exception:
            self.stop()
            raise
        return all(done) if timeout is not None else None

    def processAllAvailable(self) -> None:
        for q in self.queries:
            q.processAllAvailable()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


class _StreamPlan(PipelineRun):
    """The stages of a pipeline over streaming frames: rules are part of the plan, nothing is run while it is built."""

    def _validate(self, name: str, df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        for r in rules:
            if r.action == "FAIL":
                message = f"validation failed in stage {name!r}: {r.rule}"
                holds = F.coalesce(F.expr(r.rule), F.lit(False))
                # the partition id makes the filter one that others are not pushed through, a scan's least of all
                df = df.filter(F.when(holds, F.spark_partition_id() >= 0).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
        return drop_violations(df, rules)


def _streamed(spec: PipelineSpec, stream_target: str | Sequence[str] | None) -> list[Mapping]:
    if not spec.sources:
        raise UnsupportedStream("a streaming run needs a source")
    if stream_target is None:
        return [spec.sources[0]]
    if stream_target == "*":
        return list(spec.sources)
    wanted = [stream_target] if isinstance(stream_target, str) else list(stream_target)
    unknown = set(wanted) - {s["target"] for s in spec.sources}
    if unknown:
        raise UnsupportedStream(f"no such source: {', '.join(sorted(unknown))}")
    return [s for s in spec.sources if s["target"] in wanted]


def _stream_frame(spark: SparkSession, src: Mapping) -> DataFrame:
    static = read_source(spark, src["origin"], src["datatype"], _get(src, "params"))
    return read_source(spark, src["origin"], src["datatype"], _get(src, "params"), stream=True, schema=static.schema)


def _mode_of(df: DataFrame, dest: Mapping, state: Sequence[str]) -> str:
    """Output mode of a destination's query; raises for what would not give the batch's rows."""
    name = dest["target"]
    if not df.isStreaming:
        raise UnsupportedStream(f"destination {name!r} reads no streamed source")
    mode = "append"
    if dest["mode"] == "upsert" and {"Aggregate", "Distinct", "Deduplicate"} & set(state):
        mode = "update"
        groups = [{c} for c in df.columns] if "Aggregate" not in state else group_columns(df)
        keys = set(dest["keys"])
        if groups is None:
            raise UnsupportedStream(f"destination {name!r}: an aggregate below a join or union has no group columns to upsert by")
        if not groups or any(not g & keys for g in groups) or keys - set().union(*groups):
            raise UnsupportedStream(f"destination {name!r}: its keys {sorted(keys)} must be the group columns of its running aggregate "
                                    f"({', '.join('/'.join(sorted(g)) or 'not shown' for g in groups) or 'none'})")
    try:
        refuse_unsupported(df, mode)
    except AnalysisException as exc:
        raise UnsupportedStream(f"destination {name!r} cannot run in {mode} mode: {str(exc).splitlines()[0]}") from exc
    return mode


def _stream_plan(spark: SparkSession, spec: PipelineSpec, sources: Sequence[Mapping]) -> tuple[_StreamPlan, list[tuple[Mapping, DataFrame]]]:
    plan = _StreamPlan(spark, spec, persist_shared=False, count_logged=False)
    plan.preloaded = {s["target"]: _stream_frame(plan.spark, s) for s in sources}
    try:
        plan.run_sources()
        plan.run_transformations()
        return plan, plan.destination_frames()
    except AnalysisException as exc:
        raise UnsupportedStream(f"the stages cannot run on a stream: {str(exc).splitlines()[0]}") from exc


def run_stream(spark: SparkSession, spec: PipelineSpec, checkpoint: str, stream_target: str | Sequence[str] | None = None,
               continuous: bool | str | None = False, interval: str = "1 minute",
               full_refresh: bool = False, audit_path: str | None = None) -> StreamRun:
    """Run a declared pipeline on a stream (see the module's two ways).

    * ``stream_target`` names the streamed source or sources (``"*"``: all; by default the first); others are static relations;
    * a micro-batch owns the folder or partition of its (stream, batch id) in every destination, so a retried one is applied
      once and other streams into the same destination are not touched;
    * ``audit_path`` takes the rule counts of every micro-batch, LOG too, of one that fails as well; a streaming plan has none;
    * ``full_refresh`` first runs over all that is there with a new checkpoint, beside the rows in use, waits for it, and then puts
      rows and checkpoint in the place of the old ones; if it ends earlier, the old ones stay as they are.
    """
    sources = _streamed(spec, stream_target)
    plan, frames = _stream_plan(spark, spec, sources)
    state = {d["target"]: stateful_nodes(df) for d, df in frames}
    whole = len(sources) > 1 or any(state.values())
    for d in spec.destinations:
        if d["mode"] == "append" and not _get(d, "path"):
            check_table_destination(spark, destination_table(spark, d))
    modes = {d["target"]: _mode_of(df, d, state[d["target"]]) for d, df in frames} if whole else {}
    if whole and audit_path:
        raise UnsupportedStream("rule counts are taken per micro-batch; a pipeline with running aggregates or several streams has none")

    def start(checkpoint: str, trigger: dict, staged: bool) -> StreamRun:
        if not whole:
            process = _per_batch(spec, sources[0]["target"], checkpoint, audit_path, staged)
            return StreamRun([_started(_stream_frame(spark, sources[0]), "append", checkpoint, trigger, process)])
        queries = []
        try:
            for d, df in frames:
                own = _own_checkpoint(checkpoint, d)
                queries.append(_started(df, modes[d["target"]], own, trigger, _into(d, own, modes[d["target"]] == "update", staged)))
        except Exception:
            StreamRun(queries).stop()
            raise
        return StreamRun(queries)

    checkpoint = checkpoint.rstrip("/")
    _finish_refresh(spark, spec, checkpoint, whole)
    if full_refresh:
        staged = f"{checkpoint}__refresh"
        batches.delete_path(spark, staged)
        for d in spec.destinations:
            start_destination_refresh(spark, d)
        start(staged, {"availableNow": True}, True).awaitTermination()
        batches.rename(spark, staged, f"{checkpoint}__ready")  # from here on the refresh counts as done
        _finish_refresh(spark, spec, checkpoint, whole)
    return start(checkpoint, trigger_for(continuous, interval), False)


def _started(df: DataFrame, mode: str, checkpoint: str, trigger: dict, process: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(process).start()


def _own_checkpoint(checkpoint: str, dest: Mapping) -> str:
    return f"{checkpoint}/{destination_tag(dest)}"


def _writer(spark: SparkSession, checkpoint: str, dest: Mapping) -> str:
    return f"{batches.stream_writer(spark, checkpoint)}-{destination_tag(dest)}"


def _per_batch(spec: PipelineSpec, target: str, checkpoint: str, audit_path: str | None, staged: bool) -> Callable[[DataFrame, int], None]:
    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        writer = batches.stream_writer(session, checkpoint)
        run = PipelineRun(session, spec, isolate=False, preloaded={target: batch}, count_logged=audit_path is not None)
        try:
            run.run(write=True, writer=writer, batch_id=batch_id, arrived=batches.batch_time(session, checkpoint, batch_id), staged=staged)
        finally:
            if audit_path and run.counts:
                run.write_audit(audit_path, writer, batch_id)
    return process


def _into(dest: Mapping, checkpoint: str, running: bool, staged: bool) -> Callable[[DataFrame, int], None]:
    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        write_destination(batch, dest, writer=_writer(session, checkpoint, dest), batch_id=batch_id,
                          arrived=batches.batch_time(session, checkpoint, batch_id), running=running, staged=staged)
    return process


def _finish_refresh(spark: SparkSession, spec: PipelineSpec, checkpoint: str, whole: bool) -> None:
    """Put a refresh that ran to its end in the place of the old rows and checkpoint; repeats what a loss left undone."""
    ready = f"{checkpoint}__ready"
    if not batches.path_exists(spark, ready):
        return
    for d in spec.destinations:
        own = _own_checkpoint(ready, d) if whole else ready
        switch_destination(spark, d, _writer(spark, own, d))
    batches.delete_path(spark, checkpoint)
    batches.rename(spark, ready, checkpoint)
