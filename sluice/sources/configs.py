"""Configuration files as data: discovery, parsing, column-map CSV and SQL files.

A pipeline folder looks like ``<root>/pipelines/<catalog>/<schema>/<pipeline>/``
with ``.json``/``.toml``/``.yaml``/``.yml`` definitions; names starting with
``_`` (settings) or ``.`` are skipped, and so are empty files, as Spark's file
listing does.  Parsing is a per-file helper run inside ``mapInPandas`` (the files are
spread over tasks); bad files become rows with a ``parse_error`` instead of
being silently dropped.  Folders are listed and files read by tasks (:mod:`sluice.sources.files`), or by Spark's reader where tasks cannot
open the store.
"""

from __future__ import annotations

import csv
import io
import json
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import file_stem, file_suffix, normalize_path, parent_dir
from sluice.model import COLUMN_MAP_CSV, DOCUMENT
from sluice.session import scratch_root
from sluice.sinks.batches import path_exists
from sluice.sources.files import list_files, look_up, qualified, reachable, read_files

# --- fixed values: configuration file suffixes, in the order they are tried
CONFIG_SUFFIXES = (".json", ".toml", ".yml", ".yaml")
CONFIG_GLOB = "*.{json,toml,yaml,yml}"
CONFIG_NAME = r"\.(json|toml|yaml|yml)\z"

# Fields that need not be text: an object of options, and a number or digits.
_LOOSE = {"params": (str, dict), "column_order": (str, int)}


def list_config_files(spark: SparkSession, root: str, subdir: str = "pipelines",
                      with_content: bool = False) -> DataFrame:
    """``path, dir, stem, suffix`` (and ``content``) of every definition file below ``root/subdir``."""
    top = qualified(spark, f"{root.rstrip('/')}/{subdir}")
    if reachable(top):
        files = list_files(spark, top).filter((F.col("size") > 0) & F.col("path").rlike(CONFIG_NAME))
        files = read_files(files) if with_content else files
    else:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", CONFIG_GLOB).load(f"{root.rstrip('/')}/{subdir}"))
    return files.select(*name_parts(F.col("path")), *(["content"] if with_content else []))


def name_parts(raw: Column) -> list[Column]:
    """``path, dir, stem, suffix`` of a listed path."""
    path = normalize_path(raw)
    return [path.alias("path"), parent_dir(path).alias("dir"), file_stem(path).alias("stem"), file_suffix(path).alias("suffix")]


def ambiguous_files(listing: DataFrame) -> DataFrame:
    """Stems with more than one definition file (e.g. ``a.json`` and ``a.yaml``)."""
    return (listing.groupBy("dir", "stem")
            .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("suffix")).alias("suffixes"))
            .filter(F.col("n") > 1))


def shape_errors(value, dtype: T.DataType = DOCUMENT, where: str = "") -> list[str]:
    """Where a parsed document differs from its schema: lists, objects and strict text.  Empty values count as absent."""
    if value is None or value == "" or value == [] or value == {}:
        return []
    name = where.rsplit(".", 1)[-1]
    if isinstance(dtype, T.StructType):
        if not isinstance(value, dict):
            return [f"{where}: expected an object, got {type(value).__name__}"]
        return [e for f in dtype.fields if f.name in value
                for e in shape_errors(value[f.name], f.dataType, f"{where}.{f.name}" if where else f.name)]
    if isinstance(dtype, T.ArrayType):
        if not isinstance(value, list):
            return [f"{where}: expected a list, got {type(value).__name__}"]
        return [e for i, v in enumerate(value) for e in shape_errors(v, dtype.elementType, f"{where}[{i}]")]
    if isinstance(value, bool) or not isinstance(value, _LOOSE.get(name, str)):
        return [f"{where}: expected text, got {type(value).__name__}"]
    return []


def _to_json_text(text: str, suffix: str) -> tuple[str | None, str | None, list[str]]:
    try:
        if suffix == ".json":
            doc = json.loads(text)
        elif suffix == ".toml":
            import tomllib
            doc = tomllib.loads(text)
        elif suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError:  # pragma: no cover - depends on the image
                return None, "YAML support (pyyaml) is not installed", []
            doc = yaml.safe_load(text)
        else:
            return None, f"unsupported file type {suffix!r}", []
    except Exception as exc:  # noqa: BLE001 - any parser error is reported as data
        return None, f"not a valid {suffix[1:]} document: {type(exc).__name__}: {exc}", []
    if not isinstance(doc, dict):
        return None, "document is not a mapping", []
    return json.dumps(doc, default=str), None, shape_errors(doc)


def _decoded(content: bytes, suffix: str) -> tuple[str | None, str | None, list[str]]:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as exc:
        return None, f"not valid UTF-8: {exc}", []
    return _to_json_text(text, suffix)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [_decoded(bytes(c), s) for c, s in zip(pdf["content"], pdf["suffix"])]
        yield pd.DataFrame({"path": pdf["path"], "json_text": [o[0] for o in out],
                            "parse_error": [o[1] for o in out], "shape_errors": [o[2] for o in out]})


def parse_texts(files: DataFrame) -> DataFrame:
    """``path, json_text, parse_error, shape_errors`` of files in any of the formats."""
    return files.select("path", "suffix", "content").mapInPandas(
        _parse_batches, "path string, json_text string, parse_error string, shape_errors array<string>")


def parse_documents(files: DataFrame) -> DataFrame:
    """``path, doc, parse_error, shape_errors`` with ``doc`` typed as :data:`sluice.model.DOCUMENT`."""
    parsed = parse_texts(files)
    return parsed.select("path", F.from_json("json_text", DOCUMENT).alias("doc"), "parse_error", "shape_errors",
                         F.from_json("json_text", "map<string,string>").alias("__top"))


def referenced_files(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """``config_path, there, content`` of the distinct paths in ``config``, each looked up and read once; ``content`` is NULL where there is no whole file."""
    kept = scratch_root(spark, "referenced")
    look_up(refs.select(F.col("config").alias("path")).distinct()).withColumnRenamed("path", "config_path").write.parquet(kept)
    seen = spark.read.parquet(kept)
    files = seen.filter("kind <> 'other'").select("config_path", (F.col("kind") != "missing").alias("there"), F.when(F.length("content") > 0, F.col("content")).alias("content"))
    other = [r["config_path"] for r in seen.filter("kind = 'other'").select("config_path").collect()]  # none, unless a store needs Spark's reader
    if other:
        there = [p for p in other if path_exists(spark, p)]
        rest = spark.createDataFrame([(p, p in there) for p in other], "config_path string, there boolean")
        files = files.unionByName(rest.join(_read_files(spark, there), "config_path", "left"))
    return files


def _read_files(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """``config_path, content`` of whole files; the listing's plain path, so blanks and ``%`` compare as written.  Files may be given as read."""
    if isinstance(paths, DataFrame):
        return paths.filter(F.col("content").isNotNull()).select("config_path", "content")
    if not paths:
        return spark.createDataFrame([], "config_path string, content binary")
    files = spark.read.format("binaryFile").load(paths)
    return files.select(normalize_path(F.col("path")).alias("config_path"), "content")


def _map_rows(content: bytes) -> list[dict]:
    """Rows of one column-map file by header name: doubled quotes, line breaks in cells and absent columns are fine."""
    names = COLUMN_MAP_CSV.fieldNames()
    try:
        rows = []
        for row in csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline=""), strict=True):
            if row.get(None):
                raise ValueError(f"a row has {len(row[None])} cell(s) more than the header")
            rows.append({n: row.get(n) or None for n in names} | {"map_error": None})
        return rows or [{n: None for n in names} | {"map_error": "the column map has no rows"}]
    except (UnicodeDecodeError, csv.Error, ValueError) as exc:
        return [{n: None for n in names} | {"map_error": f"not a valid column map: {exc}"}]


def _map_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["config_path", *COLUMN_MAP_CSV.fieldNames(), "map_error"]
    for pdf in batches:
        rows = [{"config_path": p, **r} for p, c in zip(pdf["config_path"], pdf["content"]) for r in _map_rows(bytes(c))]
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def read_column_maps(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """Column-map CSV files (header row, all cells as text) with their path; ``map_error`` for an unreadable file."""
    text = T.StringType()
    schema = T.StructType([T.StructField("config_path", text), *COLUMN_MAP_CSV.fields, T.StructField("map_error", text)])
    return _read_files(spark, paths).mapInPandas(_map_batches, schema)


def read_sql_files(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """Whole-file text of SQL stage files with their path; an empty file has empty text, one that is not UTF-8 NULL."""
    return _read_files(spark, paths).select(F.try_validate_utf8(F.col("content").cast("string")).alias("sql_query"), "config_path")
