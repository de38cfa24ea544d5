"""Column statistics: extremes, samples, quantiles, text features and per-block summaries."""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefix and suffix lengths, and features kept of each kind.
LENGTHS = (1, 2, 3, 4, 6, 8, 12)
TOP = {"prefix": 12, "suffix": 12, "byte": 8, "bigram": 8, "trigram": 6}
#: Accuracy of the quantile sketch.
SKETCH = 10_000
#: Rows of a block in windowed statistics, and characters looked at for n-grams.
BLOCK_ROWS, NGRAM_CHARS = 1024, 256


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def minmax(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, lo, hi, n) of each numeric column, as doubles; one pass."""
    columns = columns or numeric_columns(df)
    row = df.agg(*(e for c in columns for e in (F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi"), F.count(c).alias(f"{c}_n"))))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi"), F.col(f"{c}_n").alias("n")) for c in columns))))


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """A uniform sample that depends on the rows alone: the n of smallest hash of the key."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def quantiles(df: DataFrame, column: str, at: list[float], exact: bool = True) -> DataFrame:
    """(p, value): discrete quantiles, the smallest value with at least the share p of the rows up to it.

    ``exact`` off takes those of the mergeable sketch, which are off by 1 / SKETCH of the rows at most. Otherwise the
    sketch only brackets them: rows below each bracket are counted, and just its own values are ranked, so no
    task sees all values of the column.
    """
    c = F.col(column)
    if not exact:
        row = df.agg(F.percentile_approx(c, [float(p) for p in at], SKETCH).alias("q"))
        return row.select(F.inline(F.array(*(F.struct(F.lit(p).alias("p"), F.get("q", F.lit(i)).alias("value")) for i, p in enumerate(at)))))
    edges = [x for p in at for x in (max(p - 3 / SKETCH, 0.0), min(p + 3 / SKETCH, 1.0))]
    row = df.agg(F.count(c).alias("n"), F.percentile_approx(c, edges, SKETCH).alias("q")).first()
    asked = df.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(at)], "_i int, p double")
    if not row.n:
        return asked.select("p", F.lit(None).cast(df.schema[column].dataType).alias("value"))
    lows, highs = row.q[::2], row.q[1::2]
    below = df.agg(*(F.count_if(c < F.lit(lo)).alias(f"b{i}") for i, lo in enumerate(lows))).first()
    ranks = F.array(*(F.lit(max(math.ceil(Decimal(repr(float(p))) * row.n), 1) - below[i]) for i, p in enumerate(at)))
    held = df.select(F.explode(F.array_compact(F.array(*(F.when(c.between(F.lit(lo), F.lit(hi)), F.lit(i)) for i, (lo, hi) in enumerate(zip(lows, highs)))))).alias("_i"), c.alias("value"))
    counted = held.groupBy("_i", "value").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_i").orderBy("value"))
    return counted.withColumn("_upto", upto).where(F.col("_upto") >= F.element_at(ranks, F.col("_i") + 1)).groupBy("_i").agg(F.min("value").alias("value")).join(F.broadcast(asked), "_i").select("p", "value")


def affix_frequency(df: DataFrame, column: str, kind: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(feature, n): how many rows start (prefix) or end (suffix) with each feature."""
    cut = F.left if kind == "prefix" else F.right
    keys = F.array(*(F.when(F.length(column) >= k, cut(F.col(column), F.lit(k))) for k in lengths))
    return df.select(F.explode(keys).alias("feature")).where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"))


def ngram_frequency(df: DataFrame, column: str, size: int) -> DataFrame:
    """(feature, n): occurrences of each run of ``size`` printable ASCII characters."""
    text = F.substring(column, 1, NGRAM_CHARS)
    spots = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    grams = df.select(F.explode(F.transform(spots, lambda i: F.substring(text, i, F.lit(size)))).alias("feature"))
    return grams.where(F.col("feature").rlike(f"^[ -~]{{{size}}}$")).groupBy("feature").agg(F.count("*").alias("n"))


def top_features(df: DataFrame, column: str) -> DataFrame:
    """(kind, feature, n, rank): the most frequent features of each kind; ties by feature."""
    kinds = {"prefix": affix_frequency(df, column, "prefix"), "suffix": affix_frequency(df, column, "suffix"), "byte": ngram_frequency(df, column, 1), "bigram": ngram_frequency(df, column, 2), "trigram": ngram_frequency(df, column, 3)}
    each = reduce(DataFrame.union, (t.select(F.lit(k).alias("kind"), "feature", "n") for k, t in kinds.items()))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "feature"))
    limit = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(TOP[k])), TOP, F)
    return each.withColumn("rank", rank).where(F.col("rank") <= limit)


def summaries(df: DataFrame, block: str, columns: list[str]) -> list:
    """Aggregates that summarise the rows of a block: extremes, and for text also lengths and end characters."""
    out = []
    for c in columns:
        out += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"), F.count(c).alias(f"{c}__n")]
        if isinstance(df.schema[c].dataType, T.StringType):
            ends = lambda e: F.array_sort(F.collect_set(F.lower(e)))
            out += [F.min(F.length(c)).alias(f"{c}__short"), F.max(F.length(c)).alias(f"{c}__long"), ends(F.left(F.col(c), F.lit(1))).alias(f"{c}__first"), ends(F.right(F.col(c), F.lit(1))).alias(f"{c}__last")]
    return out


def block_stats(df: DataFrame, position: str, columns: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of ``rows`` positions."""
    return df.groupBy(F.floor(F.col(position) / rows).alias("block")).agg(F.count("*").alias("rows"), *summaries(df, "block", columns))


def fingerprint(df: DataFrame) -> DataFrame:
    """A hash of the table that does not depend on row order."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).alias("hash"))


def threshold_rules(df: DataFrame, column: str, position: str, rows: int = 4096, slots: int = 192, near: int = 5, keep: int = 32) -> DataFrame:
    """(op, threshold, runs, rows, score, rank): the cheapest rules column < t and column > t.

    They are chosen on a sample of at most ``rows`` rows (of smallest hash of the position; smaller tables
    whole), in order of position, as ``threshold_scores`` counts them. Each of ``slots`` quantiles of the
    sample's distinct values and its neighbours up to ``near`` steps of a 96th away offers its cheapest rule, a
    rule that holds for COMMON of the rows and more counting double; what is missing to ``slots`` comes from
    all of them. Rules for no row, or for more than RARE of the rows (16 at least), go; of equal operator and
    number of rows the cheapest stays; ``keep`` are returned. Ties go to the operator, then the threshold.
    """
    value = F.col(column).cast("double")
    taken = sample(df.where(value.isNotNull() & ~F.isnan(value)).select(F.col(position).alias("at"), value.alias("v")), "at", rows)
    x = np.array([r.v for r in sorted(taken.collect(), key=lambda r: r["at"])], float)  # at most ``rows``
    schema = "op string, threshold double, runs long, rows long, score long, rank int"
    if not len(x):
        return df.sparkSession.createDataFrame([], schema)
    distinct = np.unique(x)
    step = max(1, len(distinct) // 96)
    places = [[min(max(round(k / (slots + 1) * len(distinct)) + d * step, 0), len(distinct) - 1) for d in range(-near, near + 1)] for k in range(1, slots + 1)]
    rules = {}
    for i in sorted({i for p in places for i in p}):
        for op, hit in (("<", x < distinct[i]), (">", x > distinct[i])):
            runs, n = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()), int(hit.sum())
            rules[op, i] = (runs, n, runs * RUN_COST + n * ROW_COST)
    cost = lambda r: (rules[r][2] * (2 if rules[r][1] >= COMMON * len(x) else 1), r)
    allowed = max(RARE * len(x), 16)
    offered = list(dict.fromkeys(min(((op, i) for i in p for op in "<>" if rules[op, i][1]), key=cost, default=None) for p in places))
    order = [r for r in offered if r] + sorted((r for r in rules if r not in set(offered)), key=cost)[: max(0, slots - len(offered))]
    best = {}
    for r in sorted(order, key=cost):
        if 0 < rules[r][1] <= allowed:
            best.setdefault((r[0], rules[r][1]), r)
    chosen = sorted(best.values(), key=cost)[:keep]
    return df.sparkSession.createDataFrame([(op, float(distinct[i]), *rules[op, i], n) for n, (op, i) in enumerate(chosen, 1)], schema)


def string_rules(df: DataFrame, column: str, position: str, rows: int = 4096, keep: int = 128) -> DataFrame:
    """(op, value, count, runs, rows, score, rank): rules on a text column, made of its most frequent features.

    The features are those of ``top_features``, over all rows: a prefix and a suffix make one rule each, a
    character one for at least 1, 2, .. 5 occurrences, longer runs one for 1 and 2. Rules are scored on a sample of
    at most ``rows`` rows, as in ``threshold_rules``: those that hold for no row or for more than RARE of the rows (16 at
    least) go; then one after the other is taken whose runs x TEXT_RUN_COST + rows, and OVERLAP_COST for each
    row that a rule already taken has, is least. Ties go to the operator, then the value, then the count.
    """
    schema = "op string, value string, count int, runs long, rows long, score long, rank int"
    texts = [r.t for r in sorted(sample(df.select(F.col(position).alias("at"), F.col(column).alias("t")), "at", rows).collect(), key=lambda r: r["at"])]
    ops = {"prefix": ("STARTSWITH", 1), "suffix": ("ENDSWITH", 1), "byte": ("CONTAINS", 5), "bigram": ("CONTAINS", 2), "trigram": ("CONTAINS", 2)}
    left = {}
    for f in top_features(df, column).collect():  # at most the sum of TOP
        op, most = ops[f.kind]
        for count in range(1, most + 1):
            holds = {"STARTSWITH": lambda t: t.startswith(f.feature), "ENDSWITH": lambda t: t.endswith(f.feature)}.get(op, lambda t: t.count(f.feature) >= count)
            hit = np.array([t is not None and holds(t) for t in texts], bool)
            n = int(hit.sum())
            if 0 < n <= max(RARE * len(texts), 16):
                left[op, f.feature, count] = (hit, int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()), n)
    taken, out = np.zeros(len(texts), bool), []
    while left and len(out) < keep:
        cost = {r: runs * TEXT_RUN_COST + n + OVERLAP_COST * int((hit & taken).sum()) for r, (hit, runs, n) in left.items()}
        best = min(cost, key=lambda r: (cost[r], r))
        hit, runs, n = left.pop(best)
        taken |= hit
        out.append((*best, runs, n, cost[best], len(out) + 1))
    return df.sparkSession.createDataFrame(out, schema)


# What a text rule costs for each run of rows, and for each row that an earlier one has.
TEXT_RUN_COST, OVERLAP_COST = 256, 4
# Shares of rows from which a rule counts double, and beyond which it is dropped.
COMMON, RARE = 0.35, 0.05
# What a rule costs for each run of rows and for each row.
RUN_COST, ROW_COST = 24, 64


def threshold_scores(df: DataFrame, column: str, position: str, by: list[str], thresholds: list[float]) -> DataFrame:
    """(op, threshold, runs, rows, score) of the rules column < t and column > t.

    A rule costs RUN_COST for each run of consecutive matching rows and ROW_COST for each row.
    """
    w = Window.partitionBy(*by).orderBy(position)
    rules = F.array(*(F.struct(F.lit(o).alias("op"), F.lit(float(t)).alias("threshold")) for t in thresholds for o in ("<", ">")))
    hit = lambda c: F.when(F.col("rule.op") == "<", F.col(c) < F.col("rule.threshold")).otherwise(F.col(c) > F.col("rule.threshold"))
    lagged = df.withColumn("_prev", F.lag(column).over(w)).select(F.col(column).alias("_now"), "_prev", F.explode(rules).alias("rule"))
    starts = hit("_now") & ~F.coalesce(hit("_prev"), F.lit(False))
    out = lagged.groupBy("rule.op", "rule.threshold").agg(F.sum(starts.cast("long")).alias("runs"), F.sum(hit("_now").cast("long")).alias("rows"))
    return out.withColumn("score", F.col("runs") * RUN_COST + F.col("rows") * ROW_COST)
