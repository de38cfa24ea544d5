"""Column names of input tables that operators did not choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def free(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def replaced(df: DataFrame, **new: str) -> DataFrame:
    """``df`` with its columns of the names ``new`` dropped, and those that stand for them renamed."""
    names = {c.lower() for c in new}
    kept = [column(c) for c in df.columns if c.lower() not in names and c not in new.values()]
    return df.select(*kept, *(column(c).alias(n) for n, c in new.items()))
