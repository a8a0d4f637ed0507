"""Fixed schemas of configuration documents and the three metadata tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I = T.StringType(), T.IntegerType()

VALIDATION = T.StructType([
    T.StructField("validation_rule", S),
    T.StructField("validation_action", S),
])
VALIDATIONS = T.ArrayType(VALIDATION)

IDENTITY_FIELDS = ("target_catalog_name", "target_schema_name", "pipeline_name")
_IDENTITY = [T.StructField(n, S) for n in IDENTITY_FIELDS]

SOURCES = T.StructType(_IDENTITY + [
    T.StructField("origin", S), T.StructField("datatype", S), T.StructField("target", S),
    T.StructField("params", S), T.StructField("validations", VALIDATIONS),
])

TRANSFORMATIONS = T.StructType(_IDENTITY + [
    T.StructField("origin", S), T.StructField("target", S), T.StructField("column_order", I),
    T.StructField("source_column_name", S), T.StructField("source_column_type", S),
    T.StructField("dest_column_name", S), T.StructField("dest_column_type", S),
    T.StructField("transform_function", S), T.StructField("sql_query", S),
    T.StructField("default_value", S), T.StructField("validations", VALIDATIONS),
])

DESTINATIONS = T.StructType(_IDENTITY + [
    T.StructField("origin", S), T.StructField("target", S), T.StructField("mode", S),
    T.StructField("path", S), T.StructField("keys", T.ArrayType(S)), T.StructField("sequence_by", S),
    T.StructField("validations", VALIDATIONS),
])

STAGE_SCHEMAS = {"sources": SOURCES, "transformations": TRANSFORMATIONS, "destinations": DESTINATIONS}
STAGES = ("sources", "transformations", "destinations")

# What a configuration document may hold.  ``params`` is a string: an object
# value is kept as its JSON text by the JSON reader.  Column order is read as
# text and parsed afterwards; ``config`` names a .csv/.sql file next to the document.
_DOC_TRANSFORMATION = T.StructType([
    T.StructField("origin", S), T.StructField("target", S), T.StructField("config", S),
    T.StructField("column_order", S), T.StructField("source_column_name", S),
    T.StructField("source_column_type", S), T.StructField("dest_column_name", S),
    T.StructField("dest_column_type", S), T.StructField("transform_function", S),
    T.StructField("sql_query", S), T.StructField("default_value", S),
    T.StructField("validations", VALIDATIONS),
])
DOCUMENT = T.StructType([
    T.StructField("sources", T.ArrayType(T.StructType([
        T.StructField("origin", S), T.StructField("datatype", S), T.StructField("target", S),
        T.StructField("params", S), T.StructField("validations", VALIDATIONS),
    ]))),
    T.StructField("transformations", T.ArrayType(_DOC_TRANSFORMATION)),
    T.StructField("destinations", T.ArrayType(T.StructType([
        T.StructField("origin", S), T.StructField("target", S), T.StructField("mode", S),
        T.StructField("path", S), T.StructField("keys", T.ArrayType(S)),
        T.StructField("sequence_by", S), T.StructField("validations", VALIDATIONS),
    ]))),
])

# Column-map CSV: every column read as text; column_order is digit-parsed later.
COLUMN_MAP_CSV = T.StructType([
    T.StructField(n, S) for n in (
        "column_order", "source_column_name", "source_column_type", "dest_column_name",
        "dest_column_type", "transform_function", "default_value", "validation_rule",
        "validation_action",
    )
])

# --- fixed values: allowed enumerations of the configuration contract
VALIDATION_ACTIONS = ("LOG", "DROP", "FAIL")
DESTINATION_MODES = ("append", "upsert")


def stage_frame(spark, stage: str, rows: list):
    """Typed relation of stage rows (dicts or tuples); an empty list gives an empty typed table."""
    return spark.createDataFrame(rows, STAGE_SCHEMAS[stage])
