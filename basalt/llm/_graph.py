"""Connected components of an edge table, by alternating large and small stars.

Each round is two grouped minima and two joins; nothing is collected, and nothing is broadcast: many
rounds of small tables would fill the driver, which collects and keeps each one. A node with
very many edges only makes one side of a join skewed, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """edges (src, dst) -> (id, component) for every node that has an edge; component is its smallest id.

    Null ends and self-loops are ignored; repeated and reversed edges count once.
    An empty edge table gives an empty result.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    e = scratch.table(e, f"{label}-0")
    state, turn = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first(), 0
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turn += 1
        e = scratch.table(small.union(low.select("a", "m")).distinct(), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        new = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
