"""JSON encode/decode of ``params`` style option maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAMS_TYPE = T.MapType(T.StringType(), T.StringType())


def decode_params(col: Column | str) -> Column:
    """JSON object text -> ``map<string,string>`` (nested values kept as JSON text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, PARAMS_TYPE)


def encode_params(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """Maps/structs -> compact JSON text; strings are already encoded and pass through."""
    c = F.col(col) if isinstance(col, str) else col
    if dtype is None or isinstance(dtype, (T.MapType, T.StructType, T.ArrayType)):
        return F.to_json(c) if dtype is not None else c
    return c.cast("string")
