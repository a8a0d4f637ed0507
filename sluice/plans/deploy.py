"""The whole deploy reconciliation as relations (no API calls are made here).

metadata tables -> inventory -> pipeline actions (create / update / delete)
                             -> job actions (create / update for kept pipelines,
                                delete for jobs of obsolete pipelines)

Applying the actions to a workspace API is the caller's business.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import reconcile as R


@dataclass
class DeployPlan:
    pipelines: DataFrame   # target_catalog_name, target_schema_name, name, pipeline_id, action
    jobs: DataFrame        # name, job_id, pipeline_id, action


def job_actions(pipelines: DataFrame, jobs: DataFrame, order: str | Column = "job_id") -> DataFrame:
    """Per kept pipeline: its job (first job with that name by ``order``) -> ``update``, else ``create``."""
    looked = R.lookup(pipelines.select("name", "pipeline_id"), jobs.withColumnRenamed("job_name", "name"),
                      "name", "job_id", order, first=True)
    return looked.select("name", "job_id", "pipeline_id",
                         F.when(F.col("job_id").isNull(), F.lit("create")).otherwise(F.lit("update")).alias("action"))


def _listed(df: DataFrame, order: str | None) -> tuple[DataFrame, str]:
    """A listing with a column of its order: the one named, else the position in which Spark reads the rows."""
    return (df, order) if order else (df.withColumn("__listed", F.monotonically_increasing_id()), "__listed")


def build_deploy_plan(spark: SparkSession, sources: DataFrame, transformations: DataFrame,
                      destinations: DataFrame, deployed_pipelines: DataFrame, deployed_jobs: DataFrame,
                      destructive: bool = True, pipeline_order: str | None = None,
                      job_order: str | None = None) -> DeployPlan:
    """``deployed_pipelines``: (name, pipeline_id); ``deployed_jobs``: (job_name, job_id, pipeline_id).

    Of repeated pipeline names the last of the listing is updated, of repeated job names the first; ``*_order`` name
    columns that hold the listing's order.
    """
    declared = R.inventory(spark, sources, transformations, destinations)
    listed, order = _listed(deployed_pipelines, pipeline_order)
    pipelines = R.deploy_plan(declared, listed, order=order, destructive=destructive)
    kept = pipelines.filter(F.col("action") != "delete")
    jobs = job_actions(kept, *_listed(deployed_jobs, job_order))
    if destructive:
        obsolete = pipelines.filter(F.col("action") == "delete").select("name", "pipeline_id")
        doomed = R.jobs_of_obsolete_pipelines(deployed_jobs, obsolete).select(
            F.col("job_name").alias("name"), "job_id", "pipeline_id", F.lit("delete").alias("action"))
        jobs = jobs.unionByName(doomed)
    return DeployPlan(pipelines, jobs)
