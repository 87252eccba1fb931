"""Calculated columns: a closed arithmetic language, compiled to Catalyst columns.

Python's own ``ast`` reads the text; only the nodes and functions named here
are compiled, everything else is refused.  Division by zero and all results
that are not finite are missing.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import dtype, finite, to_number


class ExpressionError(ValueError):
    """The expression uses something outside the language."""


def _both(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Missing if either side is: least and greatest alone would skip it."""
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def _modulo(a: Column, b: Column) -> Column:
    """Sign of the divisor, as in Python."""
    return a - b * F.floor(F.try_divide(a, b))


BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"), ast.Mod: _modulo, ast.Pow: F.pow}
COMPARE = {
    ast.Eq: lambda a, b: F.coalesce(a == b, F.lit(False)),
    ast.NotEq: lambda a, b: F.coalesce(a != b, F.lit(True)),
    ast.Lt: lambda a, b: F.coalesce(a < b, F.lit(False)),
    ast.LtE: lambda a, b: F.coalesce(a <= b, F.lit(False)),
    ast.Gt: lambda a, b: F.coalesce(a > b, F.lit(False)),
    ast.GtE: lambda a, b: F.coalesce(a >= b, F.lit(False)),
}
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "ceil": (1, lambda a: F.ceil(a).cast("double")),
    "floor": (1, lambda a: F.floor(a).cast("double")),
    "exp": (1, F.exp),
    "sign": (1, F.signum),
    "sqrt": (1, lambda a: F.when(a >= 0, F.sqrt(a))),
    "log": (1, F.ln),
    "log10": (1, F.log10),
    "round": (1, lambda a: F.bround(a, 0)),
    "max": (2, _both(F.greatest)),
    "min": (2, _both(F.least)),
    "clip": (3, lambda x, lo, hi: F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.greatest(lo, F.least(x, hi)))),
    "power": (2, F.pow),
    "where": (3, lambda c, a, b: F.when(c, a).otherwise(b)),
}


def compile_expression(text: str, df: DataFrame) -> Column:
    """A double (or boolean) column for ``text`` over the columns of ``df``."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e

    def number(node: ast.AST) -> Column:
        c, kind = build(node)
        return c.cast("double") if kind == "bool" else c

    def truth(node: ast.AST) -> Column:
        c, kind = build(node)
        return c if kind == "bool" else F.coalesce(c != 0, F.lit(False))

    def build(node: ast.AST) -> tuple[Column, str]:
        match node:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return F.lit(float(v)), "number"
            case ast.Name(id=name):
                if name not in df.columns:
                    raise ExpressionError(f"no column {name!r}")
                return to_number(F.col(f"`{name}`"), dtype(df, name)), "number"
            case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
                return BINARY[type(op)](number(a), number(b)), "number"
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -number(a), "number"
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return number(a), "number"
            case ast.Compare(left=left, ops=ops, comparators=rest) if all(type(op) in COMPARE for op in ops):
                sides = [number(n) for n in (left, *rest)]
                out = F.lit(True)
                for op, a, b in zip(ops, sides, sides[1:], strict=False):
                    out = out & COMPARE[type(op)](a, b)
                return out, "bool"
            case ast.BoolOp(op=ast.And(), values=values):
                out = truth(values[0])
                for v in values[1:]:
                    out = out & truth(v)
                return out, "bool"
            case ast.BoolOp(op=ast.Or(), values=values):
                out = truth(values[0])
                for v in values[1:]:
                    out = out | truth(v)
                return out, "bool"
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
                arity, f = FUNCTIONS[name]
                if len(args) != arity:
                    raise ExpressionError(f"{name} takes {arity} arguments")
                if name == "where":
                    return f(truth(args[0]), number(args[1]), number(args[2])), "number"
                return f(*[number(a) for a in args]), "number"
        raise ExpressionError(f"not allowed in an expression: {ast.unparse(node)}")

    column, kind = build(tree)
    return column if kind == "bool" else finite(column)
