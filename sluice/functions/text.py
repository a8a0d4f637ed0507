"""String, path and number-parsing column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the characters Python's ``str.isspace`` accepts (what
# --- ``str.strip()`` removes), written as a regex class usable by Java and RE2.
WHITESPACE_CLASS = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """Strip leading/trailing whitespace exactly like Python's ``str.strip()``.

    Spark ``trim`` removes spaces only, so two anchored replacements are used.
    """
    c = _c(col)
    # only rows that start or end with whitespace pay for the regex pass
    edge = F.substring(c, 1, 1).rlike(WHITESPACE_CLASS) | F.substring(c, -1, 1).rlike(WHITESPACE_CLASS)
    stripped = F.regexp_replace(
        F.regexp_replace(c, f"^{WHITESPACE_CLASS}+", ""), f"{WHITESPACE_CLASS}+$", ""
    )
    return F.when(edge, stripped).otherwise(c)


def is_blank(col: Column | str) -> Column:
    """True when the string is empty or whitespace only; NULL stays NULL."""
    return _c(col).rlike(f"^{WHITESPACE_CLASS}*$")


def non_empty(col: Column | str) -> Column:
    """NULL-safe 'set and not empty' for a string column."""
    c = _c(col)
    return c.isNotNull() & (F.length(c) > 0)


def digit_parse(col: Column | str) -> Column:
    """Text made of ASCII digits only -> int; anything else -> NULL."""
    c = _c(col).cast("string")
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def path_parts(path: Column | str, *from_end: int) -> list[Column]:
    """Path segments counted from the end (-1 = file name), NULL when absent."""
    parts = F.split(_c(path), "/")
    return [F.try_element_at(parts, F.lit(i)) for i in from_end]


def path_identity(path: Column | str) -> list[Column]:
    """(catalog, schema, pipeline) = the three parent folders of a config file."""
    catalog, schema, pipeline = path_parts(path, -4, -3, -2)
    return [catalog.alias("target_catalog_name"), schema.alias("target_schema_name"),
            pipeline.alias("pipeline_name")]


def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def file_stem(path: Column | str) -> Column:
    """File name without its last suffix."""
    return F.regexp_extract(_c(path), r"([^/]*?)(\.[^./]*)?$", 1)


def file_suffix(path: Column | str) -> Column:
    """Last suffix including the dot, lower-cased ('' when there is none)."""
    return F.lower(F.regexp_extract(_c(path), r"[^/](\.[^./]*)$", 1))


def normalize_path(path: Column | str) -> Column:
    """Drop a ``file:`` scheme and collapse ``/./`` so listing URIs and plain paths compare equal."""
    p = F.regexp_replace(_c(path), r"^file:/+", "/")
    return F.regexp_replace(p, r"/(\./)+", "/")


def resolve_against(path: Column | str, base_dir: Column | str) -> Column:
    """Absolute paths stay; relative ones are joined to ``base_dir`` (no file-system probe)."""
    p = _c(path)
    return F.when(p.isNull() | (p == ""), F.lit(None).cast("string")).when(
        p.startswith("/") | p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), normalize_path(p)  # a URI is absolute
    ).otherwise(normalize_path(F.concat_ws("/", _c(base_dir), p)))
