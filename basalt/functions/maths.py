"""Power and root of columns in the engine's types: computed as doubles, whole types rounded and saturated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions.types import TYPES


def _fitted(x: Column, type_name: str) -> Column:
    """A double in a type: whole numbers are rounded half away from zero, held at the type's bounds, NaN is 0."""
    kind = TYPES[type_name]
    if not isinstance(kind.spark, (T.IntegralType, T.DecimalType)):
        return x.cast(kind.spark)
    # A double of 2^53 and more has no fraction, and rounding it could overflow.
    whole = F.when(F.abs(x) < 2.0**53, F.round(x)).otherwise(x)
    low, high = (F.lit(b).cast("decimal(38,0)").cast(kind.spark) for b in (kind.low, kind.high))
    # The bounds as doubles may lie beyond the type, so they take its own bounds too.
    return F.when(F.isnan(x), F.lit(0).cast(kind.spark)).when(whole >= float(kind.high), high).when(whole <= float(kind.low), low).otherwise(whole.cast(kind.spark))


def power(value: Column, exponent: Column, type_name: str = "F64") -> Column:
    return _fitted(F.pow(value.cast("double"), exponent.cast("double")), type_name)


def root(value: Column, degree: Column, type_name: str = "F64") -> Column:
    """The degree-th root; of degree 0 it is null."""
    return _fitted(F.pow(value.cast("double"), F.lit(1.0) / F.nullif(degree.cast("double"), F.lit(0.0))), type_name)
