"""Nested 'empty value' cleaning, built as column expressions from the schema.

Semantics (matching how the configuration loader treats parsed documents):

* a string is empty when it is blank (Python ``str.strip()`` whitespace);
* a container (struct, map, array) is empty when none of its *direct*
  children is truthy and none is an integer/boolean.  A child is falsy when it
  is NULL, ``''``, a zero float/decimal, or a zero-length container; a
  non-NULL integer or boolean child always protects its parent.  A struct child
  whose fields are all NULL is treated as an empty object (a fixed schema
  cannot tell a missing key from a NULL one);
* the test runs top-down once per level, before the children are cleaned:
  ``{"a": {"b": {"c": ""}}}`` with dropping gives ``{"a": {}}``;
* numbers, booleans, dates, timestamps are never empty themselves;
* empty values become NULL; with ``drop_empty`` array elements and map
  entries that are NULL after cleaning are removed (struct fields stay, as
  NULL, because a DataFrame schema is fixed);
* names are cleaned too: ``.`` becomes ``_`` in struct field names, column
  names and map keys.  Map-key collisions keep the last entry; struct or column
  name collisions are an error.

Everything is a Catalyst expression (``transform``/``filter``/``forall``), so the
work stays in whole-stage code generation with no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import is_blank

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def clean_name(name: str) -> str:
    return str(name).replace(".", "_")


def _falsy_child(x: Column, dtype: T.DataType) -> Column:
    """Child does not keep its parent alive (Python-falsy and not int/bool)."""
    if isinstance(dtype, T.StringType):
        return x.isNull() | (x == "")
    if isinstance(dtype, _FRACTIONAL):
        return x.isNull() | (x == 0)
    if isinstance(dtype, _INTEGRAL):
        return x.isNull()
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return x.isNull() | (F.size(x) == 0)
    if isinstance(dtype, T.BinaryType):
        return x.isNull() | (F.length(x) == 0)
    if isinstance(dtype, T.StructType):
        every_null = F.lit(True)  # a struct without fields is an empty object, hence falsy
        for f in dtype.fields:
            every_null = every_null & x.getField(f.name).isNull()
        return x.isNull() | every_null
    return x.isNull()


def is_empty(x: Column, dtype: T.DataType) -> Column:
    """Boolean column: is this value empty?  NULL input gives ``False``."""
    if isinstance(dtype, T.StringType):
        res = is_blank(x)
    elif isinstance(dtype, T.ArrayType):
        res = F.forall(x, lambda e: _falsy_child(e, dtype.elementType))
    elif isinstance(dtype, T.MapType):
        res = F.forall(F.map_values(x), lambda v: _falsy_child(v, dtype.valueType))
    elif isinstance(dtype, T.StructType):
        res = F.lit(True)
        for f in dtype.fields:
            res = res & _falsy_child(x.getField(f.name), f.dataType)
    else:
        return F.lit(False)
    return F.coalesce(res, F.lit(False))


def _needs_work(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType))


def _clean_children(x: Column, dtype: T.DataType, drop: bool) -> Column:
    if isinstance(dtype, T.ArrayType):
        out = x
        if _needs_work(dtype.elementType):
            out = F.transform(x, lambda e: sanitize(e, dtype.elementType, drop))
        if drop:
            out = F.filter(out, lambda e: e.isNotNull())
        return out
    if isinstance(dtype, T.MapType):
        vt = dtype.valueType

        def clean_value(v):
            return sanitize(v, vt, drop) if _needs_work(vt) else v

        def slow():
            entries = F.transform(
                F.map_entries(x),
                lambda e: F.struct(
                    F.translate(e.getField("key").cast("string"), ".", "_").alias("key"),
                    clean_value(e.getField("value")).alias("value"),
                ),
            )
            # The last entry wins where renamed keys meet: positions sorted by key, the last of each run stays.
            def last_of_each(es):
                ranked = F.array_sort(F.transform(es, lambda e, i: F.struct(e.getField("key").alias("key"), i.alias("i"))))
                ends = F.transform(F.array(ranked), lambda r: F.filter(
                    r, lambda x, j: ~F.coalesce(F.get(r, j + 1).getField("key") == x.getField("key"), F.lit(False))))
                return F.transform(F.get(ends, 0), lambda x: F.get(es, x.getField("i")))

            last = F.get(F.transform(F.array(entries), last_of_each), 0)
            if drop:
                last = F.filter(last, lambda e: e.getField("value").isNotNull())
            return F.map_from_entries(last)

        if not isinstance(dtype.keyType, T.StringType):
            return slow()
        # fast path: no key contains a dot, so no key changes and none can collide
        fast = F.transform_values(x, lambda k, v: clean_value(v)) if _needs_work(vt) else x
        if drop:
            fast = F.map_filter(fast, lambda k, v: v.isNotNull())
        has_dot = F.exists(F.map_keys(x), lambda k: F.instr(k, ".") > 0)
        return F.when(has_dot, slow()).otherwise(fast)
    if isinstance(dtype, T.StructType):
        names = [clean_name(f.name) for f in dtype.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"field names collide after renaming: {[f.name for f in dtype.fields]}")
        return F.struct(*[
            (sanitize(x.getField(f.name), f.dataType, drop) if _needs_work(f.dataType)
             else x.getField(f.name)).alias(n)
            for f, n in zip(dtype.fields, names)
        ])
    return x


def sanitize(x: Column, dtype: T.DataType, drop: bool = False) -> Column:
    """Clean one value: NULL when empty, else its children cleaned recursively."""
    if isinstance(dtype, T.StringType):
        return F.when(~is_empty(x, dtype), x)
    if not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return x
    return F.when(~is_empty(x, dtype), _clean_children(x, dtype, drop))


def sanitize_frame(df: DataFrame, drop_empty: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Clean every (or the named) top-level column; the row itself is never nulled."""
    chosen = set(columns) if columns is not None else None
    out, seen = [], set()
    for f in df.schema.fields:
        name = clean_name(f.name)
        if name in seen:
            raise ValueError(f"column names collide after renaming: {f.name!r}")
        seen.add(name)
        c = F.col(f"`{f.name}`")
        if chosen is None or f.name in chosen:
            c = sanitize(c, f.dataType, drop_empty)
        out.append(c.alias(name))
    return df.select(*out)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Remove columns that are NULL in every row (one aggregation pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [f"`{c}`" for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0]
    return df.select(*keep)
