"""SQL type names, their Spark types and domains, and text-to-value coercion."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

from basalt.errors import BAD_TYPE, BAD_VALUE, OUT_OF_RANGE, SqlError


@dataclass(frozen=True)
class SqlType:
    name: str
    spark: T.DataType
    low: int | None = None
    high: int | None = None


def _signed(name, spark, bits):
    return SqlType(name, spark, -(1 << bits - 1), (1 << bits - 1) - 1)


def _unsigned(name, spark, bits):
    return SqlType(name, spark, 0, (1 << bits) - 1)


_WIDEST = 10**38 - 1
TYPES = {
    t.name: t
    for t in (
        _signed("I8", T.ByteType(), 8), _signed("I16", T.ShortType(), 16), _signed("I32", T.IntegerType(), 32), _signed("I64", T.LongType(), 64),
        SqlType("I128", T.DecimalType(38, 0), -_WIDEST, _WIDEST), _unsigned("U8", T.ShortType(), 8), _unsigned("U16", T.IntegerType(), 16),
        _unsigned("U32", T.LongType(), 32), _unsigned("U64", T.DecimalType(20, 0), 64), SqlType("U128", T.DecimalType(38, 0), 0, _WIDEST),
        SqlType("F32", T.FloatType()), SqlType("F64", T.DoubleType()), SqlType("BOOL", T.BooleanType()), SqlType("CHAR", T.StringType()),
        SqlType("STRING", T.StringType()), SqlType("DATETIME", T.LongType(), -(1 << 63), (1 << 63) - 1),
    )
}

# The names that DDL accepts for each type.
NAMES = {
    "I8": ["TINYINT", "INT1", "INT8S"],
    "I16": ["SMALLINT", "INT2", "INT16"],
    "I32": ["INT", "INTEGER", "INT4", "INT32"],
    "I64": ["BIGINT", "INT8", "INT64"],
    "U8": ["UTINYINT", "UINT1"],
    "U16": ["USMALLINT", "UINT16", "UINT2"],
    "U32": ["UINT", "UINT32", "UINT4"],
    "U64": ["UBIGINT", "UINT64", "UINT8"],
    "F32": ["REAL", "FLOAT4"],
    "F64": ["DOUBLE", "FLOAT8", "FLOAT"],
    "BOOL": ["BOOL", "BOOLEAN"],
    "CHAR": ["CHAR", "CHARACTER"],
    "STRING": ["TEXT", "VARCHAR", "STRING"],
    "DATETIME": ["DATETIME", "TIMESTAMP", "TIMESTAMPTZ"],
}
BY_NAME = {n: TYPES[t] for t, names in NAMES.items() for n in names}
PHRASES = {("DOUBLE", "PRECISION"): "F64", ("CHARACTER", "VARYING"): "STRING", ("TIMESTAMP", "WITH", "TIME", "ZONE"): "DATETIME"}
# The words of truth values.
TRUE = ["true", "t", "yes", "y", "on", "1"]
FALSE = ["false", "f", "no", "n", "off", "0"]


def type_of(words: list[str]) -> SqlType:
    """The type that the leading words of a column definition name."""
    up = tuple(w.upper() for w in words)
    for phrase, name in PHRASES.items():
        if up[: len(phrase)] == phrase:
            return TYPES[name]
    if not up or up[0] not in BY_NAME:
        raise SqlError(BAD_TYPE, f"unknown type {' '.join(words) or '(none)'}")
    return BY_NAME[up[0]]


def coerce(text, kind: SqlType):
    """A literal as a value of ``kind``; None is NULL. Bad or overflowing text raises."""
    if text is None:
        return None
    s, bad = str(text).strip(), SqlError(BAD_VALUE, f"{text!r} is no {kind.name}")
    if kind.name in ("STRING", "CHAR"):
        return str(text)
    if kind.name == "BOOL":
        if s.lower() not in TRUE + FALSE:
            raise bad
        return s.lower() in TRUE
    if kind.name in ("F32", "F64"):
        try:
            return float(s)
        except ValueError:
            raise bad from None
    if kind.name == "DATETIME":
        try:
            return int(s)
        except ValueError:
            pass
        try:
            at = datetime.fromisoformat(s)
        except ValueError:
            raise bad from None
        return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())
    try:
        value = Decimal(s)
    except InvalidOperation:
        raise bad from None
    if not value.is_finite() or value != value.to_integral_value():
        raise bad
    value = int(value)
    if not kind.low <= value <= kind.high:
        raise SqlError(OUT_OF_RANGE, f"{value} is out of range for {kind.name}")
    return Decimal(value) if isinstance(kind.spark, T.DecimalType) else value
