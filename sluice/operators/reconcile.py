"""Compare what the metadata declares with what is deployed, as joins.

All operators are relational: anti joins, equi joins on de-duplicated keys and
an outer join for the plan.  Nothing is collected; Catalyst chooses broadcast
or sort-merge from size statistics and AQE re-plans with runtime sizes (and
splits skewed join partitions).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.model import IDENTITY_FIELDS

INVENTORY_DDL = "target_catalog_name string, target_schema_name string, pipeline_name string"


def _cols(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [df[n] for n in names]


def obsolete(deployed: DataFrame, declared: DataFrame, key: str = "name") -> DataFrame:
    """Deployed rows whose key the metadata no longer declares."""
    return deployed.join(declared.select(key), key, "left_anti")


def new(declared: DataFrame, deployed: DataFrame, key: str = "name") -> DataFrame:
    """Declared rows with no deployed counterpart."""
    return declared.join(deployed.select(key), key, "left_anti")


def last_by(df: DataFrame, key: str, value: str, order: str | Column, out: str | None = None) -> DataFrame:
    """One row per key: the value of the last row by ``order`` (later duplicates win)."""
    order_c = F.col(order) if isinstance(order, str) else order
    return df.groupBy(key).agg(F.max_by(F.col(value), order_c).alias(out or value))


def first_by(df: DataFrame, key: str, value: str, order: str | Column, out: str | None = None) -> DataFrame:
    """One row per key: the value of the first row by ``order``."""
    order_c = F.col(order) if isinstance(order, str) else order
    return df.groupBy(key).agg(F.min_by(F.col(value), order_c).alias(out or value))


def lookup(left: DataFrame, table: DataFrame, key: str, value: str, order: str | Column,
           first: bool = True, out: str | None = None, left_key: str | None = None) -> DataFrame:
    """Left lookup of ``value`` by ``key``; first (or last) match by ``order``, NULL when missing.

    The lookup side is reduced to one row per key with a partial aggregation
    before any shuffle, so repeated keys never fan out the join.
    """
    reduced = (first_by if first else last_by)(table, key, value, order, out)
    if left_key and left_key != key:
        reduced = reduced.withColumnRenamed(key, left_key)
    return left.join(reduced, left_key or key, "left")


def matching(declared: DataFrame, deployed: DataFrame, key: str = "name", id_col: str = "pipeline_id",
             order: str | Column | None = None, keep: Sequence[str] = ("target_catalog_name", "target_schema_name")) -> DataFrame:
    """Declared rows that are deployed, carrying the deployed id: of repeated names the last by ``order`` (by id if none is given)."""
    dep = last_by(deployed, key, id_col, id_col if order is None else order)
    return (declared.drop(id_col).join(dep.select(key, id_col), key, "inner")
            .select(*keep, key, id_col))


def or_semi_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` matching ``right`` on ANY of the column pairs; each left row once.

    An OR join condition only plans as a nested-loop join.  Instead every pair
    gets its own equi join against the *distinct* right-side keys (so a left
    row can match at most once per pair), and a row is kept when any of the
    joins hit.
    """
    out = left
    flags = []
    for i, (lcol, rcol) in enumerate(pairs):
        flag = f"__hit{i}"
        keys = (right.select(F.col(rcol).alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull())
                .distinct().withColumn(flag, F.lit(True)))
        out = out.join(keys, out[lcol] == keys[f"__k{i}"], "left").drop(f"__k{i}")
        flags.append(F.coalesce(F.col(flag), F.lit(False)))
    hit = flags[0]
    for f in flags[1:]:
        hit = hit | f
    return out.filter(hit).drop(*[f"__hit{i}" for i in range(len(pairs))])


def inventory(spark: SparkSession, *stage_tables: DataFrame) -> DataFrame:
    """Distinct pipelines named by any metadata table: catalog, schema, name, NULL id."""
    seed = spark.createDataFrame([], INVENTORY_DDL)
    rel = seed
    for t in stage_tables:
        rel = rel.unionByName(t.select(*IDENTITY_FIELDS))
    return (rel.distinct().withColumnRenamed("pipeline_name", "name")
            .withColumn("pipeline_id", F.lit(None).cast("string")))


def deploy_targets(declared: DataFrame, deployed: DataFrame, key: str = "name", id_col: str = "pipeline_id",
                   order: str | Column | None = None,
                   keep: Sequence[str] = ("target_catalog_name", "target_schema_name")) -> DataFrame:
    """Declared rows with the id to update, or NULL for those to create: :func:`new` and :func:`matching` in one left join.

    A known declared id stays, else the deployed one is taken: of repeated names the last by ``order``, or, rows having no order of
    their own, by id if none is given.
    """
    dep = last_by(deployed, key, id_col, id_col if order is None else order)
    joined = declared.join(dep.select(key, F.col(id_col).alias("__deployed_id")), key, "left")
    return joined.select(*keep, key, F.coalesce(id_col, "__deployed_id").alias(id_col))


def deploy_plan(declared: DataFrame, deployed: DataFrame, key: str = "name", id_col: str = "pipeline_id",
                order: str | Column | None = None, destructive: bool = True,
                keep: Sequence[str] = ("target_catalog_name", "target_schema_name")) -> DataFrame:
    """create / update / delete per name, with where the pipeline belongs (NULL for a deletion).

    No id -> ``create``, an id -> ``update``; all deployed rows whose name is no longer declared, repeats
    too -> ``delete`` unless ``destructive`` is off.
    """
    wanted = deploy_targets(declared, deployed, key, id_col, order, keep)
    plan = wanted.withColumn("action", F.when(F.col(id_col).isNull(), F.lit("create")).otherwise(F.lit("update")))
    if not destructive:
        return plan
    gone = obsolete(deployed, declared, key).select(
        *[F.lit(None).cast("string").alias(c) for c in keep], key, id_col, F.lit("delete").alias("action"))
    return plan.unionByName(gone)


def top1(df: DataFrame, predicate: Column | None, order: Sequence[str | Column]) -> DataFrame:
    """First row under a predicate by a total order (``TakeOrderedAndProject``, no full sort)."""
    rel = df if predicate is None else df.filter(predicate)
    return rel.orderBy(*order).limit(1)


def require_one(df: DataFrame, message: str):
    """Eagerly fetch the single row of a top-1 relation, raising when there is none."""
    row = df.first()
    if row is None:
        raise RuntimeError(message)
    return row


def deployed_jobs(listing: DataFrame, task_field: str = "pipeline_task", settings_col: str = "settings",
                  id_col: str = "job_id") -> DataFrame:
    """Job listing records -> ``job_name, job_id, pipeline_id``.

    ``pipeline_id`` comes from the first task's ``<task_field>.pipeline_id`` and
    is NULL when that task has no such field; jobs without tasks are dropped.
    The task field name is a parameter because listings and job settings
    spell it differently.
    """
    tasks = F.col(f"{settings_col}.tasks")
    first = F.get(tasks, 0)
    task_type = None
    for f in listing.schema[settings_col].dataType["tasks"].dataType.elementType.fields:
        if f.name == task_field:
            task_type = f
    pid = first.getField(task_field).getField("pipeline_id") if task_type is not None else F.lit(None)
    return (listing.filter(F.coalesce(F.size(tasks), F.lit(0)) > 0)
            .select(F.col(f"{settings_col}.name").alias("job_name"), F.col(id_col).alias("job_id"),
                    pid.cast("string").alias("pipeline_id")))


def jobs_of_obsolete_pipelines(jobs: DataFrame, obsolete_pipelines: DataFrame) -> DataFrame:
    """Jobs whose name or pipeline id belongs to an obsolete pipeline (each job once)."""
    obs = obsolete_pipelines.select(F.col("name").alias("__name"), F.col("pipeline_id").alias("__pid"))
    return or_semi_join(jobs, obs, [("job_name", "__name"), ("pipeline_id", "__pid")])
