"""Operators over configuration stage rows: constraints, folding, expansion, flattening.

These are what the config-ingestion job runs on parsed documents before the
metadata tables are written; they are ordinary DataFrame operators, so they
also apply to any relation with the same shape.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import is_blank
from sluice.functions.types import TYPE_NAMES
from sluice.model import DESTINATION_MODES, IDENTITY_FIELDS, VALIDATION_ACTIONS
from sluice.operators.quality import row_rule_conflicts


def _blank_or_null(c: Column) -> Column:
    return c.isNull() | (F.length(c) == 0)


def _empty_after_strip(c: Column) -> Column:
    return c.isNull() | is_blank(c)


def identity_checks() -> dict[str, Column]:
    """Catalog/schema/pipeline names must be non-empty after stripping."""
    return {f"empty_{n}": _empty_after_strip(F.col(n)) for n in IDENTITY_FIELDS}


def validation_checks(col: str = "validations") -> dict[str, Column]:
    v = F.col(col)
    return {
        "empty_validation_rule": F.coalesce(
            F.exists(v, lambda x: _blank_or_null(x.getField("validation_rule"))), F.lit(False)),
        "bad_validation_action": F.coalesce(
            F.exists(v, lambda x: ~F.coalesce(
                x.getField("validation_action").isin(*VALIDATION_ACTIONS), F.lit(False))), F.lit(False)),
        "conflicting_validations": F.coalesce(F.size(row_rule_conflicts(v)) > 0, F.lit(False)),
    }


def source_checks() -> dict[str, Column]:
    checks = identity_checks()
    for n in ("origin", "datatype", "target"):
        checks[f"empty_{n}"] = _blank_or_null(F.col(n))
    checks.update(validation_checks())
    return checks


def xor_checks(strict: bool = False) -> dict[str, Column]:
    """A transformation is a column-map row or a SQL query, not neither, not both.

    Default: 'neither' = none of the three fields is set; 'both' = all three are
    set and non-empty.  ``strict`` also rejects a query together with either
    column name.
    """
    src, dst, sql = F.col("source_column_name"), F.col("dest_column_name"), F.col("sql_query")
    set_ = lambda c: c.isNotNull() & (F.length(c) > 0)
    neither = src.isNull() & dst.isNull() & sql.isNull()
    both = set_(sql) & (set_(src) | set_(dst)) if strict else set_(src) & set_(dst) & set_(sql)
    return {"no_transformation": neither, "mapping_and_sql": both}


def transformation_checks(strict: bool = False) -> dict[str, Column]:
    checks = identity_checks()
    for n in ("origin", "target"):
        checks[f"empty_{n}"] = _blank_or_null(F.col(n))
    checks["column_order_below_1"] = F.col("column_order") < 1
    for n in ("source_column_type", "dest_column_type"):
        checks[f"bad_{n}"] = F.col(n).isNotNull() & ~F.col(n).isin(*TYPE_NAMES)
    checks["empty_sql_query"] = F.col("sql_query").isNotNull() & (F.length("sql_query") == 0)
    checks.update(xor_checks(strict))
    checks.update(validation_checks())
    return checks


def upsert_incomplete(mode: Column, keys: Column, sequence_by: Column) -> Column:
    """``mode = 'upsert'`` needs at least one key and a sequence column."""
    return (mode == "upsert") & ((F.coalesce(F.size(keys), F.lit(0)) <= 0) | _blank_or_null(sequence_by))


def destination_checks() -> dict[str, Column]:
    checks = identity_checks()
    for n in ("origin", "target"):
        checks[f"empty_{n}"] = _blank_or_null(F.col(n))
    checks["bad_mode"] = ~F.coalesce(F.col("mode").isin(*DESTINATION_MODES), F.lit(False))
    checks["empty_key"] = F.coalesce(F.exists("keys", lambda k: _blank_or_null(k)), F.lit(False))
    checks["empty_sequence_by"] = F.col("sequence_by").isNotNull() & (F.length("sequence_by") == 0)
    checks["upsert_without_keys_or_sequence"] = upsert_incomplete(F.col("mode"), F.col("keys"), F.col("sequence_by"))
    checks.update(validation_checks())
    return checks


STAGE_CHECKS = {"sources": source_checks, "transformations": transformation_checks,
                "destinations": destination_checks}


def fold_validation(rule: Column | str, action: Column | str) -> Column:
    """A one-element ``validations`` array when both rule and action are non-empty, else NULL."""
    r = F.col(rule) if isinstance(rule, str) else rule
    a = F.col(action) if isinstance(action, str) else action
    ok = r.isNotNull() & a.isNotNull() & (F.length(r) > 0) & (F.length(a) > 0)
    return F.when(ok, F.array(F.struct(r.alias("validation_rule"), a.alias("validation_action"))))


def expand_column_maps(parents: DataFrame, rows: DataFrame, parent_key: str, row_key: str,
                       stamp: Sequence[str]) -> DataFrame:
    """One output row per column-map row, stamped with its parent stage's columns.

    An equi join on the config reference; the optimizer broadcasts whichever
    side its statistics show small, otherwise it shuffles both sides.
    """
    p = parents.select(F.col(parent_key).alias("__ref"), *[F.col(c) for c in stamp])
    r = rows.withColumnRenamed(row_key, "__ref")
    return r.join(p, "__ref", "inner").drop("__ref")


def explode_elements(df: DataFrame, array_col: str | Column, pos_col: str = "pos",
                     value_col: str = "element", keep: Sequence[str] = ()) -> DataFrame:
    """Per row, per array element -> one row with its position (a narrow ``posexplode``)."""
    arr = F.col(array_col) if isinstance(array_col, str) else array_col
    return df.select(*keep, F.posexplode(arr).alias(pos_col, value_col))


def flatten_stages(docs: DataFrame, keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Parsed documents -> one relation per stage, one row per stage element."""
    out = {}
    for stage in ("sources", "transformations", "destinations"):
        if stage in docs.columns:
            out[stage] = docs.select(*keep, F.explode(F.col(stage)).alias("__e")).select(*keep, "__e.*")
    return out


def first_element_field(arr: Column | str, *path: str) -> Column:
    """``arr[0].a.b`` or NULL when the array is empty or a field is missing."""
    c = F.col(arr) if isinstance(arr, str) else arr
    out = F.get(c, 0)
    for p in path:
        out = out.getField(p)
    return out


def has_elements(arr: Column | str) -> Column:
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.coalesce(F.size(c) > 0, F.lit(False))


def stage_targets(sources: DataFrame | None, transformations: DataFrame | None,
                  destinations: DataFrame | None, group_cols: Sequence[str]) -> DataFrame:
    """Targets declared per group: sources, SQL transformations and destinations (column-map rows exempt)."""
    parts = []
    if sources is not None:
        parts.append(sources.select(*group_cols, "target"))
    if transformations is not None:
        parts.append(transformations.filter(F.col("sql_query").isNotNull() & (F.length("sql_query") > 0))
                     .select(*group_cols, "target"))
    if destinations is not None:
        parts.append(destinations.select(*group_cols, "target"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_targets(targets: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return (targets.groupBy(*group_cols, "target").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def stage_violations(df: DataFrame, stage: str, strict: bool = False) -> DataFrame:
    """Rows of a stage relation with the names of the constraints they break."""
    from sluice.operators.quality import audit_constraints
    checks = STAGE_CHECKS[stage](strict) if stage == "transformations" else STAGE_CHECKS[stage]()
    return audit_constraints(df, checks)

