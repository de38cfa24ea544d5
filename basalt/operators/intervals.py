"""Algebra of row ranges: DataFrames of (key.., start, cnt), each range start .. start + cnt - 1.

All windows are partitioned by ``by``; a set of ranges without a key is one small list by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _end():
    """First row after the range."""
    return F.col("start") + F.col("cnt")


def coarsen(ranges: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Joins ranges that overlap, touch, or lie at most ``gap`` rows apart. Empty ranges vanish."""
    before = Window.partitionBy(*by).orderBy("start", "cnt").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*by).orderBy("start", "cnt")
    r = ranges.where("cnt > 0").withColumn("_end", _end()).withColumn("_reach", F.max("_end").over(before))
    r = r.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)).cast("long")).withColumn("_group", F.sum("_new").over(running))
    return r.groupBy(*by, "_group").agg(F.min("start").alias("start"), (F.max("_end") - F.min("start")).alias("cnt")).drop("_group")


def merge(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Joins ranges that overlap or touch."""
    return coarsen(ranges, by, 0)


def intersect(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows in both."""
    return intersect_many([a, b], by)


def intersect_many(lists: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows in every one of the lists, however many (at least one), merged.

    A sweep over all starts and ends of a key counts the open ranges of each list. The ends are shuffled
    once, by key; all further steps keep that partitioning.
    """
    ends = None
    for i, x in enumerate(lists):
        sides = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(_end().alias("at"), F.lit(-1).alias("d")))
        e = x.where("cnt > 0").select(*by, F.explode(sides).alias("m")).select(*by, F.col("m.at").alias("at"), *((F.col("m.d") if i == j else F.lit(0)).alias(f"_d{j}") for j in range(len(lists))))
        ends = e if ends is None else ends.unionByName(e)
    if by:
        ends = ends.repartition(*by)
    steps = ends.groupBy(*by, "at").agg(*(F.sum(f"_d{j}").alias(f"_d{j}") for j in range(len(lists))))
    w = Window.partitionBy(*by).orderBy("at")
    open_ = steps.select(*by, "at", F.lead("at").over(w).alias("_next"), *(F.sum(f"_d{j}").over(w).alias(f"_o{j}") for j in range(len(lists))))
    held = open_.where(" and ".join(f"_o{j} > 0" for j in range(len(lists))))
    return merge(held.select(*by, F.col("at").alias("start"), (F.col("_next") - F.col("at")).alias("cnt")), by)


def cheapest_gap(ranges: DataFrame, by: list[str], gaps: list[int], per_range: int = 24, per_row: int = 64) -> int:
    """The gap of ``gaps`` whose coarsened ranges cost least: ``per_range`` each and ``per_row`` a row that no
    range had; ties to the smaller gap. One pass over the merged ranges, whatever the number of gaps."""
    w = Window.partitionBy(*by).orderBy("start")
    holes = merge(ranges, by).withColumn("_hole", F.col("start") - F.lag(_end()).over(w))
    row = holes.agg(F.count("*").alias("all"), *(e for i, g in enumerate(gaps) for e in (F.count_if(F.col("_hole") <= g).alias(f"n{i}"), F.coalesce(F.sum(F.when(F.col("_hole") <= g, F.col("_hole"))), F.lit(0)).alias(f"r{i}")))).first()
    return min(gaps, key=lambda g: ((row["all"] - row[f"n{gaps.index(g)}"]) * per_range + row[f"r{gaps.index(g)}"] * per_row, g))


def _blocked(ranges: DataFrame, by: list[str], tag: str, block: int = 1 << 16) -> DataFrame:
    r = ranges.select(*by, F.col("start").alias(f"start{tag}"), _end().alias(f"end{tag}"))
    return r.withColumn("_block", F.explode(F.sequence(F.floor(F.col(f"start{tag}") / block), F.floor((F.col(f"end{tag}") - 1) / block))))


def complement(ranges: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``bounds`` (one range a key) that no range covers."""
    inside = intersect(ranges, bounds, by)
    edge = bounds.select(*by, F.col("start").alias("start"), F.lit(0).cast("long").alias("cnt"))
    w = Window.partitionBy(*by).orderBy("start", "cnt")
    marks = inside.select(*by, "start", "cnt").union(edge).withColumn("_next", F.lead("start").over(w))
    last = bounds.select(*by, (F.col("start") + F.col("cnt")).alias("_last"))
    gaps = marks.join(last, by) if by else marks.crossJoin(F.broadcast(last))
    return gaps.select(*by, _end().alias("_from"), F.coalesce("_next", "_last").alias("_to")).where("_to > _from").select(*by, F.col("_from").alias("start"), (F.col("_to") - F.col("_from")).alias("cnt"))


def overlapping(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The ranges of ``a`` that share a row with some range of ``b``."""
    x = a.where("cnt > 0").select(*by, "start", "cnt")
    hits = _blocked(x, by, "1").join(_blocked(merge(b, by), by, "2"), [*by, "_block"]).where("start1 < end2 and start2 < end1")
    hits = hits.select(*by, F.col("start1").alias("start"), (F.col("end1") - F.col("start1")).alias("cnt"))
    return x.join(hits, [*by, "start", "cnt"], "left_semi")


def runs(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """Ranges of consecutive positions among ``rows`` (distinct positions): gaps and islands."""
    w = Window.partitionBy(*by).orderBy(position)
    return rows.withColumn("_island", F.col(position) - F.row_number().over(w)).groupBy(*by, "_island").agg(F.min(position).alias("start"), F.count("*").alias("cnt")).drop("_island")


def runs_across(rows: DataFrame, position: str, block: int = 1 << 16) -> DataFrame:
    """As ``runs`` over one unbroken line of positions, however long: islands of each block of positions, then
    those that touch at a bound between blocks put together. Only a block's first and last islands meet."""
    cut = runs(rows.withColumn("_block", F.floor(F.col(position) / block)), ["_block"], position).withColumn("_last", _end())
    # An island that fills its whole block links the ones at both its ends, so chains may be long; they are few rows.
    at_start, at_end = F.col("start") == F.col("_block") * block, F.col("_last") == (F.col("_block") + 1) * block
    inner, edges = cut.where(~at_start & ~at_end).select("start", "cnt"), cut.where(at_start | at_end)
    return inner.unionByName(merge(edges.select("start", "cnt"), []))
