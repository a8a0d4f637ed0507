"""Settings files beside the definitions: ``_pipeline_settings.{json,toml,yml,yaml}`` in a pipeline's folder.

Spark's file readers hide names that start with ``_``, so these are listed and read by tasks (:mod:`sluice.sources.files`; with the
driver's own calls where tasks cannot open the store) and then parsed like any definition, once.  Of their content only
the run mode (``continuous``) is used here; the rest is kept as JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import path_identity
from sluice.session import scratch_root
from sluice.sinks.batches import _fs, read_bytes
from sluice.sources.configs import CONFIG_GLOB, CONFIG_NAME, ambiguous_files, name_parts, parse_texts
from sluice.sources.files import list_files, qualified, reachable, read_files

# --- fixed value: stem of the settings files
SETTINGS_STEM = "_pipeline_settings"
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def list_settings_files(spark: SparkSession, root: str, subdir: str = "pipelines") -> DataFrame:
    """``path, dir, stem, suffix, content`` of the settings files of all pipeline folders."""
    top = qualified(spark, f"{root.rstrip('/')}/{subdir}")
    if reachable(top):
        found = list_files(spark, top, with_hidden=True, depth=3)
        own = found.filter((F.col("depth") == 3) & F.col("path").rlike(f"/{SETTINGS_STEM}{CONFIG_NAME}"))
        return read_files(own).select(*name_parts(F.col("path")), "content")
    fs, glob = _fs(spark, f"{root.rstrip('/')}/{subdir}/*/*/*/{SETTINGS_STEM}{CONFIG_GLOB[1:]}")
    found = [s.getPath().toString() for s in (fs.globStatus(glob) or []) if s.isFile()]
    files = spark.createDataFrame([(p, read_bytes(spark, p)) for p in found], "raw string, content binary")
    return files.select(*name_parts(F.col("raw")), "content")


def load_settings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(``path``, identity columns, ``continuous``, ``settings``) of every readable file, and the problems (``kind, path, detail``)."""
    kept = scratch_root(spark, "settings")  # read and parsed once: the branches below read the result
    parse_texts(list_settings_files(spark, root)).write.parquet(kept)
    parsed = spark.read.parquet(kept)
    mode = F.lower(F.trim(F.get_json_object("json_text", "$.continuous")))
    read = parsed.withColumn("mode", F.when(mode != "", mode))
    good = read.filter(F.col("parse_error").isNull())
    settings = good.select("path", *path_identity("path"), F.coalesce(F.col("mode").isin(*TRUE), F.lit(False)).alias("continuous"),
                           F.col("json_text").alias("settings"))
    bad = good.filter(~F.col("mode").isin(*TRUE, *FALSE))
    problems = (read.filter(F.col("parse_error").isNotNull()).select(F.lit("parse_error").alias("kind"), "path", F.col("parse_error").alias("detail"))
                .unionByName(bad.select(F.lit("invalid_settings").alias("kind"), "path",
                                        F.concat(F.lit("continuous must be true or false: "), "mode").alias("detail")))
                .unionByName(ambiguous_files(parsed.select(*name_parts(F.col("path")))).select(F.lit("ambiguous_file").alias("kind"), F.concat_ws("/", "dir", "stem").alias("path"),
                                                           F.array_join("suffixes", ",").alias("detail"))))
    return settings, problems


def run_mode(settings: DataFrame, pipeline_name: str, target_schema_name: str | None = None, target_catalog_name: str | None = None) -> bool:
    """Whether a pipeline's settings ask for a continuous run (no settings: no)."""
    own = settings.filter(F.col("pipeline_name") == pipeline_name)
    if target_schema_name is not None:
        own = own.filter(F.col("target_schema_name") == target_schema_name)
    if target_catalog_name is not None:
        own = own.filter(F.col("target_catalog_name") == target_catalog_name)
    modes = {r.continuous for r in own.select("continuous").distinct().collect()}
    if len(modes) > 1:
        raise ValueError(f"several pipelines are named {pipeline_name!r} and their run modes differ; name the schema and catalog")
    return modes == {True}
