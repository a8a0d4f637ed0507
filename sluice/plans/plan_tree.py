"""Reading Spark's own plan trees: which relations a statement reads, and what a streaming frame keeps state for.

The trees come from the session's parser and analyzer (a classic session: Spark Connect gives no access to
them); nothing is parsed or planned here.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, SparkSession


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _subqueries(expression) -> Iterator:
    """Plans inside an expression: scalar, IN, EXISTS and LATERAL subqueries."""
    classes, kind = _PLAN_EXPRESSIONS, _kind(expression)
    if kind in classes:
        yield expression.plan()
    for child in _seq(expression.children()):
        yield from _subqueries(child)


_PLAN_EXPRESSIONS = frozenset({"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"})


def _reads(node, scope: frozenset[str]) -> Iterator[str]:
    kind = _kind(node)
    if kind == "UnresolvedWith":
        # a definition sees the ones before it (itself only if the list is RECURSIVE), the body sees all;
        # an inner list hides outer names
        inner, recursive = scope, node.allowRecursion()
        for entry in _seq(node.cteRelations()):
            name = entry._1().lower()
            yield from _reads(entry._2(), inner | {name} if recursive else inner)
            inner = inner | {name}
        yield from _reads(node.child(), inner)
        return
    if kind == "UnresolvedRelation":
        parts = _seq(node.multipartIdentifier())
        name = ".".join(p.lower() for p in parts)
        if len(parts) > 1 or name not in scope:
            yield name
        return
    for expression in _seq(node.expressions()):
        for plan in _subqueries(expression):
            yield from _reads(plan, scope)
    for child in _seq(node.children()):
        yield from _reads(child, scope)


def relations_read(spark: SparkSession, sql: str) -> set[str]:
    """Names (lower case, parts joined by dots) of the relations that a statement reads, its own ``WITH`` names left out.

    A ``WITH`` name counts from its definition on: in ``WITH a AS (SELECT * FROM a) SELECT * FROM a`` the relation ``a`` is read.
    """
    if not hasattr(spark, "_jsparkSession"):
        raise RuntimeError("SQL stages are ordered by Spark's parser, which only a classic session (not Spark Connect) gives access to")
    return set(_reads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset()))


# ---------------------------------------------------------------- state of streaming frames

def _nodes(node) -> Iterator:
    yield node
    for child in _seq(node.children()):
        yield from _nodes(child)


#: nodes that keep state over micro-batches when their input is a stream
_STATEFUL = frozenset({"Aggregate", "Deduplicate", "DeduplicateWithinWatermark", "Distinct"})


def stateful_nodes(df: DataFrame) -> list[str]:
    """Kinds of the operators of a streaming frame that need all of its rows, not one micro-batch: aggregates, duplicates, joins of streams,
    windows and limits (a sort alone changes no row)."""
    found = []
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        kind = _kind(node)
        if not node.isStreaming():
            continue
        if kind == "Join":
            if node.left().isStreaming() and node.right().isStreaming():
                found.append("Join")
        elif kind in _STATEFUL or kind in ("Window", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Except", "Intersect"):
            found.append(kind)
    return found


def group_columns(df: DataFrame) -> list[set[str]] | None:
    """For each grouping expression of a frame's one aggregate the output columns that carry it; ``None`` without such an aggregate."""
    path, node = [], df._jdf.queryExecution().analyzed()
    while _kind(node) != "Aggregate":
        children = _seq(node.children())
        if len(children) != 1:
            return None
        path.append(node)
        node = children[0]
    groups = _seq(node.groupingExpressions())

    def group_of(expression):
        inner = expression.child() if _kind(expression) == "Alias" else expression
        if _kind(inner) == "GetStructField" and _kind(inner.child()) == "AttributeReference" and inner.child().name() == "window":
            inner = inner.child()  # the start or end of a fixed time window names the window
        return next((i for i, g in enumerate(groups) if g.semanticEquals(inner)), None)

    carried = {e.exprId().id(): group_of(e) for e in _seq(node.aggregateExpressions())}
    for step in reversed(path):
        if _kind(step) == "Project":
            after = {}
            for e in _seq(step.projectList()):
                inner = e.child() if _kind(e) == "Alias" else e
                after[e.exprId().id()] = carried.get(inner.exprId().id()) if _kind(inner) == "AttributeReference" else None
            carried = after
    out: list[set[str]] = [set() for _ in groups]
    for attribute in _seq(df._jdf.queryExecution().analyzed().output()):
        i = carried.get(attribute.exprId().id())
        if i is not None:
            out[i].add(attribute.name())
    return out


def refuse_unsupported(df: DataFrame, mode: str) -> None:
    """Spark's own check of a streaming frame in an output mode, before the query is started (raises ``AnalysisException``)."""
    jvm = df.sparkSession._jvm
    modes = jvm.org.apache.spark.sql.streaming.OutputMode
    output = {"append": modes.Append, "update": modes.Update, "complete": modes.Complete}[mode]()
    jvm.org.apache.spark.sql.catalyst.analysis.UnsupportedOperationChecker.checkForStreaming(df._jdf.queryExecution().analyzed(), output)
