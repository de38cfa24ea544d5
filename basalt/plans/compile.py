"""Predicates to Spark columns.

Literals are cast, not columns, so comparisons of a column with a literal reach the Parquet scan.
Integers compute in 64 bits, wider ones in Decimal(38, 0); whole-number division truncates and gives
NULL for a zero divisor; floats divide and compare as IEEE says (NaN equals nothing).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.errors import BAD_TYPE, NO_COLUMN, SqlError
from basalt.functions.types import TYPES, coerce
from basalt.plans import ast

FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}
_INTS = {T.ByteType(): 8, T.ShortType(): 16, T.IntegerType(): 32, T.LongType(): 64}


@dataclass
class Typed:
    column: Column
    kind: str  # int, wide, float, double, string, bool, time
    type: T.DataType | None = None
    literal: object = None
    plain: bool = False  # a bare column
    epoch: bool = False  # seconds since 1970 of a DATETIME column


def predicate(expr: ast.Expr, schema: T.StructType) -> Column:
    out = _compile(expr, {f.name: f for f in schema.fields})
    if out.kind != "bool":
        raise SqlError(BAD_TYPE, "WHERE needs a condition")
    return out.column


def _kind(t: T.DataType) -> str:
    if t in _INTS:
        return "int"
    if isinstance(t, T.DecimalType):
        return "wide"
    names = {T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BooleanType: "bool", T.TimestampType: "time", T.TimestampNTZType: "time", T.DateType: "time"}
    for cls, kind in names.items():
        if isinstance(t, cls):
            return kind
    raise SqlError(BAD_TYPE, f"cannot compare values of type {t.simpleString()}")


def _compile(e: ast.Expr, types: dict[str, T.StructField]) -> Typed:
    if isinstance(e, ast.Name):
        if e.name not in types:
            raise SqlError(NO_COLUMN, f"no column {e.name}")
        f = types[e.name]
        return Typed(F.col(f"`{e.name}`"), _kind(f.dataType), f.dataType, plain=True, epoch=(f.metadata or {}).get("sql_type") == "DATETIME")
    if isinstance(e, ast.Literal):
        v = e.value
        if isinstance(v, bool):
            return Typed(F.lit(v), "bool", T.BooleanType(), v)
        if isinstance(v, str):
            return Typed(F.lit(v), "string", T.StringType(), v)
        if v == v.to_integral_value() and abs(v) < 10**38:
            small = -(1 << 63) <= v < 1 << 63
            return Typed(F.lit(int(v)).cast("long") if small else F.lit(Decimal(int(v))).cast("decimal(38,0)"), "int" if small else "wide", T.LongType(), v)
        return Typed(F.lit(float(v)), "double", T.DoubleType(), v)
    a, b = _compile(e.left, types), _compile(e.right, types)
    if e.op in ("AND", "OR"):
        if a.kind != "bool" or b.kind != "bool":
            raise SqlError(BAD_TYPE, f"{e.op} needs conditions")
        return Typed(a.column & b.column if e.op == "AND" else a.column | b.column, "bool")
    if e.op in ("CONTAINS", "STARTSWITH", "ENDSWITH"):
        return Typed(_text(e.op, a, b), "bool")
    if e.op in FLIP:
        return Typed(_compare(e.op, a, b), "bool")
    return _arithmetic(e.op, a, b)


def _text(op: str, a: Typed, b: Typed) -> Column:
    if a.kind != "string" or b.kind != "string":
        raise SqlError(BAD_TYPE, f"{op} needs text on both sides")
    if op == "STARTSWITH":
        return F.startswith(a.column, b.column)
    if op == "ENDSWITH":
        return F.endswith(a.column, b.column)
    found = F.contains(a.column, b.column)
    # Nothing contains the empty text.
    return found if b.literal else found & (F.length(b.column) > 0)


_NUMERIC = ("int", "wide", "float", "double")


def _common(a: Typed, b: Typed) -> tuple[Column, Column, str]:
    """Both sides in one numeric type; a literal takes the type of the other side."""
    kinds = {a.kind, b.kind}
    if "float" in kinds and (a.literal is not None or b.literal is not None) or kinds == {"float"}:
        return a.column.cast("float"), b.column.cast("float"), "float"
    if kinds & {"float", "double"}:
        return a.column.cast("double"), b.column.cast("double"), "double"
    if "wide" in kinds:
        return a.column.cast("decimal(38,0)"), b.column.cast("decimal(38,0)"), "wide"
    return a.column, b.column, "int"


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if a.kind not in _NUMERIC or b.kind not in _NUMERIC:
        raise SqlError(BAD_TYPE, f"{op} needs numbers")
    x, y, kind = _common(a, b)
    if kind == "int":
        x, y = x.cast("long"), y.cast("long")
    if op == "/":
        if kind in ("int", "wide"):
            return Typed(F.call_function("div", x, F.nullif(y, F.lit(0).cast("long"))), "int", T.LongType())
        inf = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return Typed(F.when(y == 0, inf).otherwise(x / y).cast(kind), kind)
    out = x + y if op == "+" else x - y if op == "-" else x * y
    if kind == "wide":
        out = out.cast("decimal(38,0)")
    return Typed(out, kind, T.LongType() if kind == "int" else None)


def _compare(op: str, a: Typed, b: Typed) -> Column:
    if a.literal is not None and b.literal is None:
        return _compare(FLIP[op], b, a)
    if a.epoch and isinstance(b.literal, str):
        # An ISO timestamp against a DATETIME column, read as INSERT reads it.
        b = _compile(ast.Literal(Decimal(coerce(b.literal, TYPES["DATETIME"]))), {})
    if a.kind in _NUMERIC and b.kind in _NUMERIC:
        return _compare_numbers(op, a, b)
    if a.kind == "time" and b.kind in ("string", "time"):
        other = b.column.cast(a.type) if b.kind == "string" or a.type != b.type else b.column
        return _plain(op, a.column, other)
    if a.kind == b.kind and a.kind in ("string", "bool"):
        return _plain(op, a.column, b.column)
    raise SqlError(BAD_TYPE, f"cannot compare {a.kind} with {b.kind}")


def _plain(op: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _compare_numbers(op: str, a: Typed, b: Typed) -> Column:
    v = b.literal
    if v is not None and a.kind in ("int", "wide"):
        if v != v.to_integral_value():
            # A whole number against a fraction: move the bound to the next whole number.
            if op in ("=", "!="):
                return a.column.isNotNull() & F.lit(op == "!=")
            up = op in ("<", ">=")
            b = _compile(ast.Literal(Decimal(math.ceil(v) if up else math.floor(v))), {})
            return _compare_numbers(op, a, b)
        if a.plain and a.type in _INTS:
            bits = _INTS[a.type]
            if -(1 << bits - 1) <= v < 1 << bits - 1:
                return _plain(op, a.column, F.lit(int(v)).cast(a.type))
            holds = op == "!=" or (op in ("<", "<=") if v > 0 else op in (">", ">="))
            return a.column.isNotNull() & F.lit(holds)
        if a.plain and a.kind == "wide":
            return _plain(op, a.column, F.lit(v).cast(a.type) if abs(v) < 10 ** (a.type.precision - a.type.scale) else F.lit(v).cast("decimal(38,0)"))
    x, y, kind = _common(a, b)
    out = _plain(op, x, y)
    if kind not in ("float", "double"):
        return out
    # Spark takes NaN for the largest value and equal to itself; against a literal that shows only in > and >=.
    if v is not None:
        return out & ~F.isnan(x) if op in (">", ">=") else out
    nan = F.isnan(x) | F.isnan(y)
    return out | nan if op == "!=" else out & ~nan
