"""Prefix sums over an integer position, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def before(df: DataFrame, position: str, value: str, out: str, by: tuple[str, ...] = (), block: int = 1024) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows (of ``by``) at smaller positions.

    Positions are distinct non-negative integers. Sums are taken in blocks of ``block`` positions,
    then over the blocks' totals (1 row for 1024), then put together.
    """
    g = df.withColumn("_block", F.floor(F.col(position) / block).cast("long"))
    inner = Window.partitionBy(*by, "_block").orderBy(position)
    outer = Window.partitionBy(*by).orderBy("_block")
    blocks = g.groupBy(*by, "_block").agg(F.sum(value).alias("_sum")).withColumn("_base", F.sum("_sum").over(outer) - F.col("_sum")).drop("_sum")
    inside = g.withColumn("_inside", F.sum(value).over(inner) - F.col(value))
    return inside.join(blocks, [*by, "_block"]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_block", "_base", "_inside")
