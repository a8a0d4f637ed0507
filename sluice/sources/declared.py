"""Read a declared source: ``origin`` in format ``datatype`` with ``params`` as options."""

from __future__ import annotations

import json
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: ``datatype`` spellings that name a catalog table/view
TABLE_DATATYPES = ("table", "view", "catalog", "delta_table")


def decode_params(params: str | Mapping | None) -> dict[str, str]:
    """Options as strings; ``params`` may be a mapping or JSON text of one."""
    if params is None or params == "":
        return {}
    if isinstance(params, str):
        params = json.loads(params)
    if not isinstance(params, Mapping):
        raise ValueError(f"source params must be a JSON object, got {params!r}")
    out = {}
    for k, v in params.items():
        out[str(k)] = json.dumps(v) if isinstance(v, (dict, list)) else (
            str(v).lower() if isinstance(v, bool) else str(v))
    return out


def read_source(spark: SparkSession, origin: str, datatype: str, params: str | Mapping | None = None,
                stream: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """Batch or streaming read of a declared source.

    File formats go through the DataFrame reader, so filters and projections
    written later are pushed into the scan by Catalyst.  A ``schema`` option in
    ``params`` (DDL text) is applied as the reader schema.  A ``watermark`` option
    (``<time column> <delay>``, e.g. ``ts 10 minutes``) bounds the state of streams; batch reads ignore it.
    """
    opts = decode_params(params)
    watermark = opts.pop("watermark", None)
    if stream and watermark:
        column, _, delay = watermark.strip().partition(" ")
        return read_source(spark, origin, datatype, opts, stream, schema).withWatermark(column, delay or "0 seconds")
    ddl = opts.pop("schema", None)
    schema = schema or ddl
    reader = spark.readStream if stream else spark.read
    if datatype.lower() in TABLE_DATATYPES:
        return reader.options(**opts).table(origin)
    reader = reader.format(datatype).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(origin)


def read_metadata_table(spark: SparkSession, stage: str, database: str = "sluice") -> DataFrame:
    """Scan one of the three metadata tables."""
    return spark.table(f"{database}.{stage}")
