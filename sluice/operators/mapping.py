"""Column-map projections (one ``select`` per stage) and SQL stages."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.expr import transform_to_column
from sluice.functions.types import cast_to, literal_of, matches_type, COMPLEX_TYPES


@dataclass(frozen=True)
class ColumnSpec:
    """One row of a column map: how one output column is produced."""

    source_column_name: str | None = None
    dest_column_name: str | None = None
    source_column_type: str | None = None
    dest_column_type: str | None = None
    transform_function: str | None = None
    default_value: str | None = None
    column_order: int | None = None

    @property
    def output_name(self) -> str:
        name = self.dest_column_name or self.source_column_name
        if not name:
            raise ValueError(f"column map row names no column: {self}")
        return name

    @classmethod
    def from_row(cls, row: Mapping) -> "ColumnSpec":
        get = (lambda k: row[k] if k in row else None) if hasattr(row, "__getitem__") else row.get
        vals = {k: get(k) for k in cls.__dataclass_fields__}
        vals = {k: (None if isinstance(v, str) and v == "" else v) for k, v in vals.items()}
        return cls(**vals)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def column_expr(df: DataFrame, spec: ColumnSpec) -> Column:
    """read (or transform) -> cast to dest type -> default when NULL."""
    if spec.transform_function:
        value = transform_to_column(spec.transform_function)
        # the result type comes from analysis only (no job runs); it lets an
        # expression that already has the target type skip the cast
        current = df.select(value).schema.fields[0].dataType
    else:
        if not spec.source_column_name:
            raise ValueError(f"column map row has neither a source column nor a function: {spec}")
        value = _quoted(spec.source_column_name)
        current = df.schema[spec.source_column_name].dataType
        if spec.source_column_type and not matches_type(spec.source_column_type, current):
            value = cast_to(value, spec.source_column_type, current)
            current = None if spec.source_column_type in COMPLEX_TYPES else \
                df.select(value).schema.fields[0].dataType
    if spec.dest_column_type:
        value = cast_to(value, spec.dest_column_type, current)
    if spec.default_value is not None:
        value = F.coalesce(value, literal_of(spec.default_value, spec.dest_column_type))
    return value.alias(spec.output_name)


def ordered_specs(specs: Iterable[ColumnSpec]) -> list[ColumnSpec]:
    """Order by ``column_order`` (missing order last), ties by output name.

    Rows read back from a metadata table come in no particular order, so the
    tie-break is by name rather than by position.
    """
    return sorted(specs, key=lambda s: (s.column_order is None, s.column_order or 0, s.output_name))


def apply_column_map(df: DataFrame, specs: Iterable[ColumnSpec]) -> DataFrame:
    """Project ``df`` through a column map in a single ``select``.

    All expressions are built-in Catalyst expressions, so the projection fuses
    with the scan (column pruning reaches the parquet reader).
    """
    specs = ordered_specs(specs)
    if not specs:
        raise ValueError("empty column map")
    return df.select(*[column_expr(df, s) for s in specs])


def run_sql(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run a SQL stage after publishing its inputs as temporary views.

    Views live in ``spark``'s own session; the pipeline runner gives every run
    a fresh child session so names of concurrent runs never clash.
    """
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(query)
