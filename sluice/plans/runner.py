"""Run a declared pipeline: sources -> transformations -> destinations.

The driver only orders stages and builds plans; all data work is lazy Spark
plans that run when a sink writes (or the caller acts on a result).

Stage order is found as a fixpoint: a column-map stage is ready once its
``origin`` relation exists; a SQL stage is deferred while a name it reads is the
target of a stage not published yet, or is not to be found.  This follows the
relations a query really reads rather than the declared ``origin``, and a
catalog table never stands in for a declared stage of its name.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sluice.operators.mapping import ColumnSpec, apply_column_map
from sluice.operators.quality import Rule, audit, count_rules, drop_violations, enforce_fail, raise_failures
from sluice.plans.plan_tree import relations_read
from sluice.sources.declared import read_source


def _get(row: Mapping, key: str, default=None):
    try:
        v = row[key]
    except (KeyError, ValueError):
        return default
    return default if v is None else v


def _rules(row: Mapping) -> list[Rule]:
    return [Rule(v["validation_rule"], v["validation_action"]) for v in (_get(row, "validations") or [])]


@dataclass
class PipelineSpec:
    """The stage rows of one pipeline (plain dicts / Rows with the metadata-table fields)."""

    sources: list = field(default_factory=list)
    transformations: list = field(default_factory=list)
    destinations: list = field(default_factory=list)

    @classmethod
    def from_tables(cls, sources: DataFrame | None, transformations: DataFrame | None,
                    destinations: DataFrame | None, pipeline_name: str,
                    target_schema_name: str | None = None, target_catalog_name: str | None = None) -> "PipelineSpec":
        """Load one pipeline's stage rows from the metadata tables.

        Stage rows are configuration (a handful per pipeline), so fetching them
        to the driver is bounded by the size of the pipeline definition.
        """
        def rows(t):
            if t is None:
                return []
            cond = t["pipeline_name"] == pipeline_name
            if target_schema_name is not None:
                cond = cond & (t["target_schema_name"] == target_schema_name)
            if target_catalog_name is not None:
                cond = cond & (t["target_catalog_name"] == target_catalog_name)
            return [r.asDict(recursive=True) for r in t.filter(cond).collect()]
        return cls(rows(sources), rows(transformations), rows(destinations))


@dataclass
class RunResult:
    relations: "OrderedDict[str, DataFrame]"
    audits: dict[str, DataFrame]
    written: list[str]


class StageOrderError(RuntimeError):
    pass


def _child_session(spark: SparkSession) -> SparkSession:
    """A session sharing the SparkContext but with its own temp views and SQL conf copy."""
    child = spark.newSession()
    try:
        for k, v in spark.conf.getAll.items():
            if k.startswith("spark.sql.") or k == "spark.checkpoint.dir":
                try:
                    child.conf.set(k, v)
                except Exception:  # static confs cannot be set per session
                    pass
    except AttributeError:
        pass
    return child


def _transformation_groups(rows: Sequence[Mapping]) -> list[dict]:
    """Column-map rows of one (origin, target) form one stage; each SQL row is a stage."""
    groups: "OrderedDict[tuple, dict]" = OrderedDict()
    stages = []
    for r in rows:
        if _get(r, "sql_query"):
            stages.append({"kind": "sql", "origin": _get(r, "origin"), "target": r["target"],
                           "sql": r["sql_query"], "rules": _rules(r)})
            continue
        key = (_get(r, "origin"), r["target"])
        g = groups.get(key)
        if g is None:
            g = {"kind": "map", "origin": key[0], "target": key[1], "specs": [], "rules": []}
            groups[key] = g
            stages.append(g)
        g["specs"].append(ColumnSpec.from_row(r))
        for rule in _rules(r):
            if rule not in g["rules"]:
                g["rules"].append(rule)
    return stages


class PipelineRun:
    """One execution of a pipeline spec in an isolated child session."""

    def __init__(self, spark: SparkSession, spec: PipelineSpec, isolate: bool = True,
                 eager_fail: bool = True, checkpoint_failable: bool = False,
                 preloaded: Mapping[str, DataFrame] | None = None, persist_shared: bool = True,
                 count_logged: bool | None = None):
        """``checkpoint_failable`` checkpoints (to ``spark.checkpoint.dir``) every stage
        that has FAIL rules, instead of persisting it for the run; either way the audit and the later write
        compute the stage once.  ``preloaded`` supplies source
        relations by target name (used for streaming micro-batches).
        ``persist_shared`` keeps a stage that two or more later stages or
        destinations read persisted for the run, so the
        writes do not recompute it (lost blocks are recomputed from lineage).
        ``count_logged`` also counts stages with LOG and DROP rules only, each in one column-pruned pass of its
        own before the writes; by default only when :meth:`run` writes.  The write itself carries no
        counters, so its filters reach the scan."""
        self.spark = _child_session(spark) if isolate else spark
        self.spec = spec
        self.eager_fail = eager_fail
        self.checkpoint_failable = checkpoint_failable
        self.preloaded = dict(preloaded or {})
        consumers: dict[str, set] = {}
        for st in _transformation_groups(spec.transformations):
            reads = relations_read(self.spark, st["sql"]) if st["kind"] == "sql" else {str(st["origin"]).lower()}
            for name in reads:
                consumers.setdefault(name, set()).add(("t", st["target"]))
        for d in spec.destinations:
            consumers.setdefault(d["origin"].lower(), set()).add(("d", d["target"]))
        self.shared = {k for k, v in consumers.items() if len(v) > 1} if persist_shared else set()
        self.count_logged = count_logged
        self.writes = False
        self.persisted: list[DataFrame] = []
        self.relations: "OrderedDict[str, DataFrame]" = OrderedDict()
        self.audits: dict[str, DataFrame] = {}
        self.counts: dict[str, list[tuple[str, str, int, int]]] = {}

    def _persist(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.persisted.append(df)
        return df

    def _validate(self, name: str, df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """All rules of a stage are counted by one action over its whole output (FAIL raises
        here, before any write), plus a lazy one-pass audit relation.  DROP: one filter."""
        if not rules:
            return df
        fails = self.eager_fail and any(r.action == "FAIL" for r in rules)
        if fails and self.checkpoint_failable:
            df = df.checkpoint(eager=True)
        elif fails and self.writes and not any(df is kept for kept in self.persisted):
            df = self._persist(df)
        if self.count_logged:
            self.counts[name] = count_rules(df, rules)
            if self.eager_fail:
                raise_failures(self.counts[name], name)
        elif fails:
            enforce_fail(df, rules, stage=name)
        self.audits[name] = audit(df, rules)
        return drop_violations(df, rules)

    # -- helpers
    def _publish(self, name: str, df: DataFrame, rules: Sequence[Rule], is_source: bool = False) -> DataFrame:
        # a source is read again rather than kept whole: each reader prunes and filters its own scan
        if self.writes and not is_source and name.lower() in self.shared:
            df = self._persist(df)
        df = self._validate(name, df, rules)
        self.relations[name] = df
        df.createOrReplaceTempView(name)
        return df

    def _relation(self, name: str) -> DataFrame | None:
        if name in self.relations:
            return self.relations[name]
        return None

    # -- stages
    def run_sources(self, stream: bool = False) -> None:
        for s in self.spec.sources:
            df = self.preloaded.get(s["target"])
            if df is None:
                df = read_source(self.spark, s["origin"], s["datatype"], _get(s, "params"), stream=stream)
            self._publish(s["target"], df, _rules(s), is_source=True)

    def run_transformations(self) -> None:
        pending = _transformation_groups(self.spec.transformations)
        while pending:
            progressed, waiting, last_error = False, [], None
            for i, st in enumerate(pending):
                unmade = {s["target"].lower() for s in [*waiting, *pending[i + 1:]]} - {st["target"].lower()}
                reads = relations_read(self.spark, st["sql"]) if st["kind"] == "sql" else {str(st["origin"]).lower()}
                if reads & unmade:
                    waiting.append(st)
                    continue
                if st["kind"] == "map":
                    src = self._relation(st["origin"])
                    if src is None:
                        try:
                            src = self.spark.table(st["origin"])
                        except AnalysisException:
                            waiting.append(st)
                            continue
                    df = apply_column_map(src, st["specs"])
                else:
                    try:
                        df = self.spark.sql(st["sql"])
                    except AnalysisException as exc:
                        if exc.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                            waiting.append(st)
                            last_error = exc
                            continue
                        raise
                self._publish(st["target"], df, st["rules"])
                progressed = True
            if not progressed:
                names = ", ".join(f"{s['target']} (from {s['origin']})" for s in waiting)
                raise StageOrderError(f"stages cannot be ordered, inputs missing: {names}") from last_error
            pending = waiting

    def destination_frames(self) -> list[tuple[Mapping, DataFrame]]:
        out = []
        for d in self.spec.destinations:
            src = self._relation(d["origin"])
            if src is None:
                src = self.spark.table(d["origin"])
            out.append((d, self._validate(d["target"], src, _rules(d))))
        return out

    def run(self, write: bool = True, full_refresh: bool = False, writer: str | None = None,
            batch_id: int = 0, arrived: int | None = None, staged: bool = False) -> RunResult:
        """Build every stage and, with ``write``, write the destinations.

        FAIL audits are actions run while the stages are built, i.e. all of
        them before the first write, so a failing pipeline writes nothing.
        ``writer``, ``batch_id``, ``arrived`` and ``staged`` are those of :func:`sluice.sinks.tables.write_destination`.
        """
        from sluice.sinks.tables import destination_tag, write_destination

        self.writes = write
        if self.count_logged is None:
            self.count_logged = write
        written = []
        try:
            self.run_sources()
            self.run_transformations()
            frames = self.destination_frames()
            for d, df in frames:
                self.relations[d["target"]] = df
            if write:
                for d, df in frames:
                    write_destination(df, d, full_refresh=full_refresh, batch_id=batch_id, arrived=arrived, staged=staged,
                                      writer=f"{writer}-{destination_tag(d)}" if writer else None)
                    written.append(d["target"])
        finally:
            self.release()
        return RunResult(self.relations, self.audits, written)

    def release(self) -> None:
        """Drop the run's persisted shared stages."""
        for df in self.persisted:
            df.unpersist()
        self.persisted = []

    def write_audit(self, path: str, run_id: str | None = None, batch_id: int | None = None) -> None:
        """Append the rule counts of this run to an audit table: one row per stage and rule."""
        from sluice.sinks.audits import write_counts
        write_counts(self.spark, self.counts, path, run_id, batch_id)


def run_stream(spark: SparkSession, spec: PipelineSpec, checkpoint: str, **options):
    """Run a declared pipeline on a stream: :func:`sluice.plans.stream_runner.run_stream`."""
    from sluice.plans import stream_runner
    return stream_runner.run_stream(spark, spec, checkpoint, **options)
