"""Rule formulas: a whitelisted arithmetic language compiled to Spark columns."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow, ast.Mod: F.try_mod}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def _positive(function):
    return lambda x: F.when(x > 0, function(x))


_CALLS = {
    "abs": F.abs, "min": F.least, "max": F.greatest, "round": F.round, "pow": F.pow, "exp": F.exp, "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"), "log": _positive(F.log), "log2": _positive(F.log2), "log10": _positive(F.log10), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
}


def names(text: str) -> set[str]:
    """The variables a formula reads."""
    return {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)} - set(_CALLS)


def unknown_names(text: str, allowed: set[str]) -> list[str]:
    """Lint: variables outside the allowed set, sorted."""
    return sorted(names(text) - allowed)


def compile_formula(text: str, variables: Mapping[str, Column]) -> Column:
    """A column that is NULL where the formula has no value (a missing variable, a division by zero, a logarithm of nothing)."""

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=bool() | int() | float() as value):
                return F.lit(float(value))
            case ast.Name(id=name):
                if name not in variables:
                    raise ValueError(f"unknown name {name!r}")
                return variables[name].cast("double")
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](build(left), build(right))
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -build(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return build(operand)
            case ast.IfExp(test=test, body=body, orelse=orelse):
                return F.when(build(test), build(body)).otherwise(build(orelse))
            case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](build(left), build(right))
            case ast.BoolOp(op=op, values=values):
                out = build(values[0])
                for value in values[1:]:
                    out = out & build(value) if isinstance(op, ast.And) else out | build(value)
                return out
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                return _CALLS[name](*[build(a) for a in args])
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")

    return build(ast.parse(text, mode="eval"))
