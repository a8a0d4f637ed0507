"""Data-quality rules (LOG / DROP / FAIL) and audits of configuration rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import py_strip

ACTIONS = ("LOG", "DROP", "FAIL")


@dataclass(frozen=True)
class Rule:
    """A Spark SQL boolean condition every row should meet, and what to do if not."""

    rule: str
    action: str = "LOG"

    def __post_init__(self):
        if not self.rule or not str(self.rule).strip():
            raise ValueError("empty validation rule")
        if self.action not in ACTIONS:
            raise ValueError(f"validation action must be one of {ACTIONS}, got {self.action!r}")

    @classmethod
    def from_row(cls, row: Mapping) -> "Rule":
        return cls(row["validation_rule"], row["validation_action"])


class ValidationFailed(RuntimeError):
    """A FAIL rule found violating rows; nothing was written."""

    def __init__(self, failures: list[tuple[str, int]], stage: str | None = None):
        self.failures = failures
        where = f" in {stage}" if stage else ""
        lines = ", ".join(f"{r!r}: {n} row(s)" for r, n in failures)
        super().__init__(f"validation failed{where}: {lines}")


def holds(rule: str) -> Column:
    """The rule as a predicate; a NULL result counts as a violation."""
    return F.coalesce(F.expr(rule).cast("boolean"), F.lit(False))


def audit(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rule, action, rows checked, rows violating.

    All rules are counted in a single aggregation pass over ``df`` (partial
    aggregation on every partition, a one-row final merge).
    """
    if not rules:
        raise ValueError("no rules to audit")
    aggs = [F.count(F.lit(1)).alias("checked")]
    aggs += [F.count_if(~holds(r.rule)).alias(f"v{i}") for i, r in enumerate(rules)]
    counts = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(r.rule).alias("rule"), F.lit(r.action).alias("action"),
                 F.col("checked").alias("checked"), F.col(f"v{i}").alias("violations"))
        for i, r in enumerate(rules)
    ])
    return counts.select(F.inline(rows))


def drop_violations(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Keep rows meeting every DROP rule, as one conjunctive filter.

    The bare predicates are used (a filter already drops rows where the
    condition is NULL, exactly like ``coalesce(rule, false)``), so Catalyst can
    push simple comparisons into the Parquet scan.
    """
    cond = None
    for r in rules:
        if r.action == "DROP":
            c = F.expr(r.rule).cast("boolean")
            cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def count_rules(df: DataFrame, rules: Sequence[Rule]) -> list[tuple[str, str, int, int]]:
    """(rule, action, rows checked, rows violating) of every rule: :func:`audit` as one action.

    It counts all rows of the stage, whatever a consumer reads of it.
    """
    return [(r["rule"], r["action"], r["checked"], r["violations"]) for r in audit(df, rules).collect()]


def raise_failures(counts: Sequence[tuple], stage: str | None = None) -> None:
    found = [(rule, violations) for rule, action, _, violations in counts if action == "FAIL" and violations > 0]
    if found:
        raise ValidationFailed(found, stage)


def enforce_fail(df: DataFrame, rules: Sequence[Rule], stage: str | None = None) -> None:
    """Eager check of the FAIL rules; raises :class:`ValidationFailed`.

    This is an action on purpose: a lazy ``raise_error`` column can be pruned
    away or skipped by later filters/limits, so FAIL must be counted before the
    sink commits.
    """
    fail_rules = [r for r in rules if r.action == "FAIL"]
    if fail_rules:
        raise_failures(count_rules(df, fail_rules), stage)


def apply_rules(df: DataFrame, rules: Sequence[Rule], stage: str | None = None,
                eager_fail: bool = True) -> tuple[DataFrame, DataFrame]:
    """Validate a stage's output: returns (rows to keep, audit relation).

    All rules see the same input rows.  FAIL rules are checked eagerly (see
    :func:`enforce_fail`), DROP rules filter, LOG rules only count.
    """
    rules = list(rules)
    if not rules:
        return df, None
    if eager_fail:
        enforce_fail(df, rules, stage)
    return drop_violations(df, rules), audit(df, rules)


# ---------------------------------------------------------------- rule grouping

def _rule_digest(rule: Column) -> Column:
    return F.sha2(rule, 256)


def conflicting_rule_groups(df: DataFrame, rule_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Digests of rules (compared after Python-style strip) listed more than once per group.

    Grouping is on the SHA-256 digest of the stripped rule, so long rule texts
    never travel through the shuffle; the count is a partial/final aggregation,
    so a hot rule value does not land in one task.
    """
    keyed = df.select(*group_cols, _rule_digest(py_strip(F.col(rule_col).cast("string"))).alias("__digest"))
    return (keyed.groupBy(*group_cols, "__digest").agg(F.count(F.lit(1)).alias("n_actions"))
            .filter(F.col("n_actions") > 1))


def conflicting_rules(df: DataFrame, rule_col: str, action_col: str, order_col: str,
                      group_cols: Sequence[str] = (), key: str = "text") -> DataFrame:
    """Every member of a conflicting group, flat: group..., rule_key, n_actions, order, action.

    ``key`` chooses what ``rule_key`` holds: the stripped ``text``, or its
    ``sha256`` / ``md5`` hex digest (for long texts).  Members are found by
    joining the aggregated group list back on the digest; that list is usually
    small, and AQE turns the join into a broadcast once its real size is known
    (or splits a skewed partition when it is not small).  No group is ever
    collected into one array.
    """
    stripped = py_strip(F.col(rule_col).cast("string"))
    out_key = {"text": stripped, "sha256": _rule_digest(stripped), "md5": F.md5(stripped)}[key]
    keyed = df.select(*group_cols, _rule_digest(stripped).alias("__digest"), out_key.alias("rule_key"),
                      F.col(order_col), F.col(action_col))
    groups = conflicting_rule_groups(df, rule_col, group_cols)
    return (keyed.join(groups, [*group_cols, "__digest"], "inner")
            .select(*group_cols, "rule_key", "n_actions", F.col(order_col), F.col(action_col)))


def row_rule_conflicts(validations: Column) -> Column:
    """Per row: rule keys repeated inside one ``validations`` array (bounded config arrays)."""
    keys = F.transform(validations, lambda v: py_strip(v.getField("validation_rule")))
    return F.array_distinct(F.filter(keys, lambda k: F.size(F.filter(keys, lambda o: o == k)) > 1))


# ---------------------------------------------------------------- row constraint audit

def audit_constraints(df: DataFrame, checks: Mapping[str, Column], out_col: str = "violations") -> DataFrame:
    """Add an ``array<string>`` of the names of the failed checks (empty when clean).

    ``checks`` maps a name to a *violation* predicate; everything is evaluated
    in one projection.
    """
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]
    return df.withColumn(out_col, F.array_compact(F.array(*flags)))


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_col: str = "n") -> DataFrame:
    """Key values present more than once (``groupBy().count()`` with HAVING)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col)).filter(F.col(count_col) > 1)


def without_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no row in ``right`` on ``keys`` (left anti join)."""
    return left.join(right.select(*keys), list(keys), "left_anti")
