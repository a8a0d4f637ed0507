"""Upsert (keep the latest row per key) as a relational operator.

``upsert(target, batch, keys, sequence_by)`` = latest row per key of
``target UNION ALL batch``:

* greatest ``sequence_by`` wins; a NULL sequence loses to any value;
* on an equal sequence the incoming batch beats the stored row;
* still tied (duplicates inside one batch) -> greatest by the remaining
  columns in schema order (maps compared through ``to_json``), so the result
  is deterministic;
* NULL keys form one group; rows are never deleted.

Plan shape: ``row_number() = 1`` over ``PARTITION BY keys``.  Catalyst inserts
a partial ``WindowGroupLimit`` *before* the shuffle, so each map task forwards at
most one row per key - a hot key costs one row per task, not its full size.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SRC = "__src"
_RN = "__rn"


def _orderable(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType

    def has_map(t):
        if isinstance(t, T.MapType):
            return True
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        if isinstance(t, T.StructType):
            return any(has_map(f.dataType) for f in t.fields)
        return False

    return F.to_json(c) if has_map(dt) else c


def latest_per_key(df: DataFrame, keys: Sequence[str], sequence_by: str,
                   prefer: Sequence[Column] = ()) -> DataFrame:
    """One row per key: greatest ``sequence_by``, then ``prefer``, then the other columns."""
    if not keys:
        raise ValueError("upsert needs at least one key column")
    rest = [c for c in df.columns if c not in set(keys) | {sequence_by, _SRC}]
    order = [F.col(f"`{sequence_by}`").desc_nulls_last(), *prefer]
    order += [_orderable(df, c).desc_nulls_last() for c in rest]
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN)


def upsert(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], sequence_by: str) -> DataFrame:
    """Merge ``batch`` into ``target`` by ``keys``, latest ``sequence_by`` wins."""
    for k in [*keys, sequence_by]:
        if k not in batch.columns:
            raise ValueError(f"column {k!r} missing from the batch")
    incoming = batch.withColumn(_SRC, F.lit(1))
    if target is not None:
        incoming = target.withColumn(_SRC, F.lit(0)).unionByName(incoming, allowMissingColumns=True)
    out = latest_per_key(incoming, keys, sequence_by, prefer=[F.col(_SRC).desc()])
    return out.drop(_SRC)
