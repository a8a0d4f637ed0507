"""Config folder -> checked stage relations -> the three metadata tables.

discover -> parse -> stamp identity (from the folder names) -> one row per
stage element -> expand column-map CSVs / attach SQL files -> clean empty
values -> audit -> overwrite ``<db>.sources / transformations / destinations`` (and ``<db>.pipeline_settings``
with the run modes).

Problems of every kind are gathered in one relation (``kind, path, detail``)
instead of stopping at the first; :func:`write_metadata` refuses to write
while any exist.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.sanitize import sanitize_frame
from sluice.functions.text import digit_parse, parent_dir, path_identity, py_strip, resolve_against
from sluice.model import IDENTITY_FIELDS, STAGE_SCHEMAS, STAGES
from sluice.operators.quality import audit_constraints
from sluice.operators.stages import STAGE_CHECKS, duplicate_targets, fold_validation, stage_targets
from sluice.session import scratch_root
from sluice.sinks.tables import create_database, overwrite_table
from sluice.sources.configs import (ambiguous_files, list_config_files, name_parts, parse_documents, read_column_maps,
                                    read_sql_files, referenced_files)
from sluice.sources.settings import load_settings

PROBLEMS_DDL = "kind string, path string, detail string"


@dataclass
class IngestResult:
    sources: DataFrame
    transformations: DataFrame
    destinations: DataFrame
    problems: DataFrame
    settings: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {"sources": self.sources, "transformations": self.transformations,
                "destinations": self.destinations}


def _conform(df: DataFrame, stage: str) -> DataFrame:
    """Select the fixed schema of a metadata table (missing columns as NULL)."""
    schema = STAGE_SCHEMAS[stage]
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _with_file(df: DataFrame, stage: str) -> DataFrame:
    """Fixed stage schema plus ``__file`` (the definition file the row came from)."""
    return df.select("__file", *[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in STAGE_SCHEMAS[stage].fields])


def load_configs(spark: SparkSession, root: str, strict_xor: bool = False) -> IngestResult:
    listing = list_config_files(spark, root, with_content=True)
    parsed = scratch_root(spark, "documents")  # parsed once: the branches below read the result
    parse_documents(listing).withColumnRenamed("path", "__file").write.parquet(parsed)
    docs = spark.read.parquet(parsed)
    ok = docs.filter(F.col("parse_error").isNull())
    problems = [docs.filter(F.col("parse_error").isNotNull()).select(
        F.lit("parse_error").alias("kind"), F.col("__file").alias("path"), F.col("parse_error").alias("detail"))]

    problems.append(docs.select(F.lit("invalid_shape").alias("kind"), F.col("__file").alias("path"),
                                F.explode("shape_errors").alias("detail")))

    amb = ambiguous_files(docs.select(*name_parts(F.col("__file"))))
    problems.append(amb.select(F.lit("ambiguous_file").alias("kind"),
                               F.concat_ws("/", "dir", "stem").alias("path"),
                               F.array_join("suffixes", ",").alias("detail")))

    has_stage = F.lit(False)
    for s in STAGES:
        has_stage = has_stage | F.coalesce(F.map_contains_key("__top", F.lit(s)), F.lit(False))
    problems.append(ok.filter(~has_stage).select(
        F.lit("no_stage").alias("kind"), F.col("__file").alias("path"),
        F.lit("the file declares no stage (sources, transformations or destinations)").alias("detail")))

    # identity names are stored stripped (Python whitespace rules)
    stamped = ok.select("__file", *path_identity("__file"), parent_dir("__file").alias("__dir"), "doc.*")
    stamped = stamped.select(*[py_strip(n).alias(n) if n in IDENTITY_FIELDS else F.col(n) for n in stamped.columns])
    keep = ["__file", "__dir", *IDENTITY_FIELDS]

    def explode(stage):
        return stamped.select(*keep, F.explode(F.col(stage)).alias("e")).select(*keep, "e.*")

    sources = explode("sources")
    # a relative destination path is taken relative to its definition file's folder
    destinations = explode("destinations").withColumn("path", resolve_against(F.col("path"), "__dir"))

    tr = explode("transformations").withColumn("config", resolve_against(F.col("config"), "__dir"))
    tr = tr.withColumn("config_kind", F.lower(F.regexp_extract("config", r"(\.[^./]*)$", 1)))
    # column_order defaults to 1 outside CSV maps (where a non-digit cell stays NULL)
    inline = tr.filter(F.col("config").isNull()).withColumn(
        "column_order", F.coalesce(digit_parse("column_order"), F.lit(1)))
    by_file = tr.filter(F.col("config").isNotNull())
    problems.append(by_file.filter(~F.col("config_kind").isin(".csv", ".sql")).select(
        F.lit("bad_config_file").alias("kind"), F.col("__file").alias("path"),
        F.concat(F.lit("transformation configs must be .csv or .sql: "), F.col("config")).alias("detail")))

    # there may be as many referenced files as pipelines: each is looked up and read by a task, once
    known = by_file.filter(F.col("config_kind").isin(".csv", ".sql"))
    refs = referenced_files(spark, known)
    kind = F.lower(F.regexp_extract("config_path", r"(\.[^./]*)$", 1))
    maps = read_column_maps(spark, refs.filter(kind == ".csv"))
    sqls = read_sql_files(spark, refs.filter(kind == ".sql"))
    colmaps = maps.filter(F.col("map_error").isNull()).drop("map_error")

    parents = by_file.select("__file", *IDENTITY_FIELDS, "origin", "target", "config", "config_kind")
    csv_rows = (parents.filter(F.col("config_kind") == ".csv")
                .join(colmaps, F.col("config") == F.col("config_path"), "inner")
                .select("__file", *IDENTITY_FIELDS, "origin", "target",
                        digit_parse("column_order").alias("column_order"),
                        "source_column_name", "source_column_type", "dest_column_name", "dest_column_type",
                        "transform_function", "default_value",
                        fold_validation("validation_rule", "validation_action").alias("validations")))
    sql_rows = (by_file.filter(F.col("config_kind") == ".sql")
                .join(sqls.withColumnRenamed("sql_query", "__sql"), F.col("config") == F.col("config_path"), "inner")
                .withColumn("sql_query", F.col("__sql")).withColumn("column_order", F.lit(1)))
    missing = known.join(refs.filter("there"), F.col("config") == F.col("config_path"), "left_anti")
    problems.append(missing.select(F.lit("missing_config_file").alias("kind"), F.col("__file").alias("path"),
                                   F.col("config").alias("detail")))
    unreadable = known.join(maps.filter(F.col("map_error").isNotNull()), F.col("config") == F.col("config_path"))
    problems.append(unreadable.select(F.lit("bad_config_file").alias("kind"), F.col("__file").alias("path"),
                                      F.concat_ws(": ", "config", "map_error").alias("detail")))

    rel = {
        "sources": _with_file(sources, "sources"),
        "transformations": _with_file(inline, "transformations")
        .unionByName(_with_file(csv_rows, "transformations"))
        .unionByName(_with_file(sql_rows, "transformations")),
        "destinations": _with_file(destinations, "destinations"),
    }

    # clean empty values, then audit the cleaned rows
    cleaned = {}
    for stage in STAGES:
        df = rel[stage]
        cleaned[stage] = sanitize_frame(df, drop_empty=True, columns=[c for c in df.columns if c != "__file"])
        checks = STAGE_CHECKS[stage](strict_xor) if stage == "transformations" else STAGE_CHECKS[stage]()
        bad = audit_constraints(cleaned[stage], checks).filter(F.size("violations") > 0)
        problems.append(bad.select(F.lit(f"invalid_{stage[:-1]}").alias("kind"), F.col("__file").alias("path"),
                                   F.concat_ws(": ", F.col("target"), F.array_join("violations", ","))
                                   .alias("detail")))

    # rows of one column map make one stage: a rule may not have two actions among them
    rules = cleaned["transformations"].filter(F.col("sql_query").isNull()).select(
        "__file", "target", F.explode("validations").alias("v"))
    clash = (rules.groupBy("__file", "target", py_strip(F.col("v.validation_rule")).alias("rule"))
             .agg(F.array_sort(F.collect_set("v.validation_action")).alias("actions")).filter(F.size("actions") > 1))
    problems.append(clash.select(F.lit("conflicting_rules").alias("kind"), F.col("__file").alias("path"),
                                 F.concat_ws(": ", "target", "rule", F.array_join("actions", ",")).alias("detail")))

    targets = stage_targets(cleaned["sources"], cleaned["transformations"], cleaned["destinations"], ["__file"])
    problems.append(duplicate_targets(targets, ["__file"]).select(
        F.lit("duplicate_target").alias("kind"), F.col("__file").alias("path"), F.col("target").alias("detail")))

    settings, bad_settings = load_settings(spark, root)
    problems.append(bad_settings)

    all_problems = problems[0]
    for p in problems[1:]:
        all_problems = all_problems.unionByName(p)
    return IngestResult(*(_conform(cleaned[s], s) for s in STAGES), all_problems, settings)


class ConfigProblems(RuntimeError):
    """``rows`` may be a first part of the problems; ``total`` counts them all."""

    def __init__(self, rows, total: int | None = None):
        self.rows = rows
        self.total = len(rows) if total is None else total
        text = "\n".join(f"  {r['kind']}: {r['path']}: {r['detail']}" for r in rows)
        shown = "" if len(rows) == self.total else f", {len(rows)} shown"
        super().__init__(f"configuration has {self.total} problem(s){shown}:\n{text}")


def write_metadata(spark: SparkSession, result: IngestResult, database: str = "sluice",
                   max_reported: int = 50) -> None:
    """Overwrite the three metadata tables; refuses while ``result.problems`` is non-empty."""
    found = result.problems.limit(max_reported).collect()
    if found:
        raise ConfigProblems(found, result.problems.count())
    create_database(spark, database)
    for stage, df in result.tables().items():
        overwrite_table(df, f"{database}.{stage}")
    if result.settings is not None:
        overwrite_table(result.settings, f"{database}.pipeline_settings")


def create_backend_objects(spark: SparkSession, root: str, database: str = "sluice") -> IngestResult:
    result = load_configs(spark, root)
    write_metadata(spark, result, database)
    return result
