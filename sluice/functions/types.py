"""The closed list of column-map type names and casts between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the nine type names a column map may use, in the order the
# --- configuration contract lists them.  Complex names carry no element type.
TYPE_NAMES = ("string", "int", "double", "date", "timestamp", "boolean", "struct", "array", "map")

SCALAR_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
}

COMPLEX_TYPES: dict[str, type] = {
    "struct": T.StructType,
    "array": T.ArrayType,
    "map": T.MapType,
}


# A failed string -> number/boolean cast costs an exception per row inside
# Spark.  These patterns accept a superset of what the cast can parse (ASCII
# control (DEL too) and space trimming, sign, digits; for doubles also exponents, d/f
# suffixes, NaN/Infinity and hex floats), so values they reject are NULL either
# way and skip the cast.  Whatever they accept still goes through ``try_cast``.
_PARSABLE = {
    "int": r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$",
    "double": (r"(?i)^[\x00-\x20\x7f]*[+-]?(nan|inf|infinity|[0-9]*\.?[0-9]*(e[+-]?[0-9]+)?[df]?"
               r"|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[df]?)[\x00-\x20\x7f]*$"),
    "boolean": r"(?i)^[\x00-\x20\x7f]*(t|true|y|yes|1|f|false|n|no|0)[\x00-\x20\x7f]*$",
}


def is_type_name(name: str | None) -> bool:
    return name in TYPE_NAMES


def matches_type(name: str, dtype: T.DataType) -> bool:
    """Does ``dtype`` already satisfy the type name (class check for complex names)?"""
    if name in COMPLEX_TYPES:
        return isinstance(dtype, COMPLEX_TYPES[name])
    return dtype == SCALAR_TYPES[name]


def cast_to(col: Column, name: str | None, current: T.DataType | None = None) -> Column:
    """Cast ``col`` to a type name, never raising on bad values.

    Scalar names use ``try_cast`` (an unparsable value becomes NULL, so a
    default can take over).  ``struct``/``array``/``map`` cannot be cast to
    without an element type: the column passes through when its type class
    matches and is rejected otherwise.
    """
    if not name:
        return col
    if name not in TYPE_NAMES:
        raise ValueError(f"unknown column type {name!r}; allowed: {', '.join(TYPE_NAMES)}")
    if name in COMPLEX_TYPES:
        if current is not None and not isinstance(current, COMPLEX_TYPES[name]):
            raise TypeError(f"column of type {current.simpleString()} is not a {name}")
        return col
    if current is not None and matches_type(name, current):
        return col
    if isinstance(current, T.StringType) and name in _PARSABLE:
        return F.when(col.rlike(_PARSABLE[name]), col.try_cast(SCALAR_TYPES[name]))
    return col.try_cast(SCALAR_TYPES[name])


def literal_of(value: str, name: str | None) -> Column:
    """A typed literal from the text of a default value."""
    lit = F.lit(value)
    if not name or name == "string" or name in COMPLEX_TYPES:
        return lit
    return cast_to(lit, name, T.StringType())
