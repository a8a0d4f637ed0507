"""Turn a column-map ``transform_function`` text into a Column without ``eval``.

Two spellings are accepted:

* Spark SQL expression text, e.g. ``to_timestamp(src, 'dd-MM-yyyy')`` -> ``F.expr``.
* PySpark call text, e.g. ``F.to_timestamp(F.col('src'), 'dd-MM-yyyy')``.  This is
  parsed with :mod:`ast` and rebuilt from an allow-list: calls to public
  ``pyspark.sql.functions`` names, a small set of Column methods, literals,
  arithmetic/comparison/boolean operators, and ``lambda`` arguments of the higher-order functions
  (``F.transform(F.col('a'), lambda x: x + 1)``), whose names become Spark lambda variables.
  Anything else is rejected.
"""

from __future__ import annotations

import ast
import inspect
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FUNCTION_NAMES = frozenset(
    n for n, v in vars(F).items()
    if not n.startswith("_") and inspect.isfunction(v) and v.__module__.startswith("pyspark.sql")
    and n not in {"udf", "pandas_udf", "udtf", "call_udf", "call_function", "broadcast"}
)

_COLUMN_METHODS = frozenset({
    "alias", "cast", "try_cast", "isNull", "isNotNull", "substr", "startswith", "endswith",
    "contains", "like", "ilike", "rlike", "between", "isin", "when", "otherwise", "eqNullSafe",
    "getField", "getItem", "asc", "desc", "bitwiseAND", "bitwiseOR", "bitwiseXOR",
})

_BINOPS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul,
    ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.BitAnd: operator.and_, ast.BitOr: operator.or_,
}
_CMPOPS = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt,
    ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}

# functions that take a lambda, which is called with Spark lambda variables and must give a column of them
_HIGHER_ORDER = frozenset({"transform", "filter", "exists", "forall", "aggregate", "reduce", "zip_with", "transform_keys",
                           "transform_values", "map_filter", "map_zip_with", "array_sort"})

_MODULE_ALIASES = frozenset({"F", "functions"})


class UnsafeExpression(ValueError):
    """The text uses something outside the allow-list."""


_PY_CALL = re.compile(r"(?<![\w.`])(?:F|functions)\.[A-Za-z_]\w*\s*\(")


def looks_like_python(text: str) -> bool:
    """PySpark spelling when the text calls ``F.<name>(...)`` anywhere."""
    return bool(_PY_CALL.search(text))


def _function(node: ast.Lambda, scope: dict):
    """A Python function of as many positional arguments as the lambda has names; its body is built by the allow-list."""
    a = node.args
    names = [x.arg for x in a.args]
    if a.vararg or a.kwarg or a.kwonlyargs or a.posonlyargs or a.defaults or not 1 <= len(names) <= 3:
        raise UnsafeExpression("a lambda has one to three plain arguments")
    if set(names) & _MODULE_ALIASES:
        raise UnsafeExpression("a lambda argument may not hide the functions' name")

    def body(values) -> Column:
        out = _build(node.body, {**scope, **dict(zip(names, values))})
        return out if isinstance(out, Column) else F.lit(out)

    return [lambda x: body([x]), lambda x, y: body([x, y]), lambda x, y, z: body([x, y, z])][len(names) - 1]


def _build(node: ast.AST, scope: dict | None = None, functions: bool = False):
    """``scope`` holds the lambda variables in sight; ``functions`` allows a lambda here."""
    scope = scope or {}
    if isinstance(node, ast.Lambda) and functions:
        return _function(node, scope)
    if isinstance(node, ast.Name) and node.id in scope:
        return scope[node.id]
    if isinstance(node, ast.Constant):
        if isinstance(node.value, (str, int, float, bool)) or node.value is None:
            return node.value
        raise UnsafeExpression(f"literal {node.value!r} not allowed")
    if isinstance(node, (ast.List, ast.Tuple)):
        items = [_build(e, scope) for e in node.elts]
        return items if isinstance(node, ast.List) else tuple(items)
    if isinstance(node, ast.UnaryOp):
        val = _build(node.operand, scope)
        if isinstance(node.op, ast.USub):
            return -val
        if isinstance(node.op, ast.Invert) and isinstance(val, Column):
            return ~val
        raise UnsafeExpression("unary operator not allowed")
    if isinstance(node, ast.BinOp) and type(node.op) in _BINOPS:
        return _BINOPS[type(node.op)](_build(node.left, scope), _build(node.right, scope))
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _CMPOPS:
        return _CMPOPS[type(node.ops[0])](_build(node.left, scope), _build(node.comparators[0], scope))
    if isinstance(node, ast.Call):
        named = node.func.attr if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) else None
        higher = named in _HIGHER_ORDER and node.func.value.id in _MODULE_ALIASES
        args = [_build(a, scope, higher) for a in node.args]
        kwargs = {k.arg: _build(k.value, scope, higher) for k in node.keywords if k.arg}
        if len(kwargs) != len(node.keywords):
            raise UnsafeExpression("**kwargs not allowed")
        fn = node.func
        if isinstance(fn, ast.Attribute) and isinstance(fn.value, ast.Name) and fn.value.id not in scope:
            if fn.value.id in _MODULE_ALIASES:
                if fn.attr not in _FUNCTION_NAMES:
                    raise UnsafeExpression(f"function {fn.attr!r} not allowed")
                return getattr(F, fn.attr)(*args, **kwargs)
            raise UnsafeExpression(f"name {fn.value.id!r} not allowed")
        if isinstance(fn, ast.Attribute):
            target = _build(fn.value, scope)
            if not isinstance(target, Column) or fn.attr not in _COLUMN_METHODS:
                raise UnsafeExpression(f"method {fn.attr!r} not allowed")
            return getattr(target, fn.attr)(*args, **kwargs)
        raise UnsafeExpression("only F.<function>(...) and Column method calls are allowed")
    raise UnsafeExpression(f"syntax {type(node).__name__} not allowed")


def python_text_to_column(text: str) -> Column:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as exc:
        raise UnsafeExpression(f"not a Python expression: {text!r}") from exc
    out = _build(tree.body)
    if not isinstance(out, Column):
        raise UnsafeExpression(f"expression does not produce a column: {text!r}")
    return out


def transform_to_column(text: str) -> Column:
    """Column for a transform text in either spelling."""
    if looks_like_python(text):
        return python_text_to_column(text)
    return F.expr(text)
