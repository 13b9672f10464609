"""Formula columns: spreadsheet-style expressions turned into Column trees.

Python's own `ast` reads the text; every node becomes one DataFrame
expression, so evaluation is ordinary generated code over the table.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .columns import col, round_half_even

FUNCTIONS = ("IF", "ROUND", "ABS", "AVG", "SUM", "COUNT", "ISNULL")


class FormulaError(ValueError):
    """The formula is not allowed or does not fit the table."""


def _double(c: Column) -> Column:
    return c.cast("double")


def _compare(op: ast.cmpop, a: Column, b: Column) -> Column:
    """Comparisons with a missing side are false, inequality is true."""
    plain: dict[type, Callable[[], Column]] = {
        ast.Eq: lambda: a == b,
        ast.NotEq: lambda: a != b,
        ast.Lt: lambda: a < b,
        ast.LtE: lambda: a <= b,
        ast.Gt: lambda: a > b,
        ast.GtE: lambda: a >= b,
    }
    if type(op) not in plain:
        raise FormulaError(f"comparison {type(op).__name__} is not allowed")
    return F.coalesce(plain[type(op)](), F.lit(isinstance(op, ast.NotEq)))


def _arithmetic(op: ast.operator, a: Column, b: Column) -> Column:
    """Numbers are doubles; division by zero gives null; floor and modulo follow the divisor's sign."""
    a, b = _double(a), _double(b)
    quotient = F.floor(F.try_divide(a, b)).cast("double")
    plain: dict[type, Callable[[], Column]] = {
        ast.Add: lambda: a + b,
        ast.Sub: lambda: a - b,
        ast.Mult: lambda: a * b,
        ast.Div: lambda: F.try_divide(a, b),
        ast.FloorDiv: lambda: quotient,
        ast.Mod: lambda: a - b * quotient,
        ast.Pow: lambda: F.pow(a, b),
    }
    if type(op) not in plain:
        raise FormulaError(f"operator {type(op).__name__} is not allowed")
    return plain[type(op)]()


class _Builder:
    """Builds the Column and notes the whole-table aggregates it needs."""

    def __init__(self, df: DataFrame, names: dict[str, str]):
        self.df = df
        self.names = names
        self.totals: dict[str, Column] = {}

    def build(self, node: ast.AST) -> Column:
        maker = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if maker is None:
            raise FormulaError(f"{type(node).__name__} is not allowed")
        return maker(node)

    def on_constant(self, node):
        if node.value is None or isinstance(node.value, (bool, int, float, str)):
            return F.lit(float(node.value)) if type(node.value) is int else F.lit(node.value)
        raise FormulaError("only numbers, text, True, False and None are allowed")

    def on_name(self, node):
        name = self.names.get(node.id, node.id)
        if name not in self.df.columns:
            raise FormulaError(f"unknown column {name!r}")
        return col(name)

    def on_binop(self, node):
        return _arithmetic(node.op, self.build(node.left), self.build(node.right))

    def on_unaryop(self, node):
        value = self.build(node.operand)
        if isinstance(node.op, ast.USub):
            return -_double(value)
        if isinstance(node.op, ast.UAdd):
            return _double(value)
        if isinstance(node.op, ast.Not):
            return ~F.coalesce(value.cast("boolean"), F.lit(False))
        raise FormulaError("bitwise operators are not allowed")

    def on_compare(self, node):
        sides = [self.build(n) for n in [node.left, *node.comparators]]
        steps = [_compare(op, a, b) for op, a, b in zip(node.ops, sides, sides[1:])]
        out = steps[0]
        for s in steps[1:]:
            out = out & s
        return out

    def on_boolop(self, node):
        values = [F.coalesce(self.build(v).cast("boolean"), F.lit(False)) for v in node.values]
        out = values[0]
        for v in values[1:]:
            out = (out & v) if isinstance(node.op, ast.And) else (out | v)
        return out

    def _choose(self, test, yes, no):
        return F.when(F.coalesce(self.build(test).cast("boolean"), F.lit(False)), self.build(yes)).otherwise(self.build(no))

    def on_ifexp(self, node):
        return self._choose(node.test, node.body, node.orelse)

    def on_call(self, node):
        name = node.func.id.upper() if isinstance(node.func, ast.Name) else None
        if name not in FUNCTIONS or node.keywords:
            raise FormulaError("only " + ", ".join(FUNCTIONS) + " can be called")
        args = node.args
        wanted = {"IF": (3,), "ROUND": (1, 2)}.get(name, (1,))
        if len(args) not in wanted:
            raise FormulaError(f"{name} takes {' or '.join(map(str, wanted))} arguments")
        if name == "IF":
            return self._choose(*args)
        if name == "ISNULL":
            return self.build(args[0]).isNull()
        if name == "ABS":
            return F.abs(_double(self.build(args[0])))
        if name == "ROUND":
            digits = 0
            if len(args) == 2:
                if not (isinstance(args[1], ast.Constant) and type(args[1].value) is int):
                    raise FormulaError("ROUND needs a whole number of digits")
                digits = args[1].value
            return round_half_even(_double(self.build(args[0])), digits)
        return self._total(name, args[0])

    def _total(self, name, arg):
        if not any(isinstance(n, ast.Name) and self.names.get(n.id, n.id) in self.df.columns for n in ast.walk(arg)):
            raise FormulaError(f"{name} needs a column")
        if any(isinstance(n, ast.Call) and getattr(n.func, "id", "").upper() in ("AVG", "SUM", "COUNT") for n in ast.walk(arg)):
            raise FormulaError("totals cannot be nested")
        value = self.build(arg)
        key = f"t{len(self.totals)}"
        self.totals[key] = F.count(value) if name == "COUNT" else (F.avg if name == "AVG" else F.sum)(_double(value))
        return F.col("__totals").getField(key)


def formula_column(df: DataFrame, formula: str) -> tuple[Column, dict[str, Column]]:
    """(expression, whole-table aggregates it refers to)."""
    names: dict[str, str] = {}

    def stand_in(match: re.Match) -> str:
        key = f"__c{len(names)}"
        names[key] = match.group(1)
        return key

    text = re.sub(r"`([^`]+)`", stand_in, formula.strip())
    text = re.sub(r"\bif\s*\(", "IF(", text, flags=re.I)  # `if(` is a call here, not a keyword
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"cannot read the formula: {e.msg}") from None
    builder = _Builder(df, names)
    return builder.build(tree.body), builder.totals


def add_calculated_column(df: DataFrame, name: str, formula: str) -> DataFrame:
    """The table with one more column, computed by the formula.

    AVG, SUM and COUNT over the whole table are one aggregate row, read as a
    scalar subquery: no join, no window over all rows.
    """
    name = name.strip()
    if not name:
        raise FormulaError("the new column needs a name")
    if name in df.columns:
        raise FormulaError(f"column {name!r} exists already")
    value, totals = formula_column(df, formula)
    if not totals:
        return df.withColumn(name, value)
    row = df.agg(F.struct(*[c.alias(k) for k, c in totals.items()]).alias("t"))
    return df.withColumn("__totals", row.scalar()).withColumn(name, value).drop("__totals")

