"""Data skipping: which files may hold a matching row, by per-file summaries.

A file is left out only if its summary proves that no row matches; whatever the summaries cannot
judge (arithmetic, !=, columns without summary) keeps every file. So the answer is that of a full scan.
"""

from __future__ import annotations

import uuid
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions.types import TYPES
from basalt.operators.stats import summaries
from basalt.plans import ast
from basalt.plans.compile import FLIP
from basalt.sources.catalog import Catalog, Manifest

#: Tables of fewer files are scanned whole.
LEAST_FILES = 2
#: Characters of a run whose hash is kept, and bits of the map of them (one bitmap of Spark's own size).
GRAM, GRAM_BITS = 3, 32_768


def build(catalog: Catalog, m: Manifest) -> Manifest:
    """Summarises the files that have no summary yet in one aggregation, written with the others' beside the snapshot."""
    if not m.files:
        return m
    columns = [f.stored for f in m.live if f.type != "BOOL"]
    old, names = catalog.summaries(m), {_name(f): f for f in m.files}
    if old is not None and all(f"{c}__lo" in old.columns for c in columns):
        known = {r["file"] for r in old.select("file").collect()}
    else:
        old, known = None, set()
    new = [f for n, f in names.items() if n not in known]
    if not new:
        return m
    df = catalog.spark.read.schema(m.stored_schema()).parquet(*new)
    file = F.col("_metadata.file_name").alias("file")
    table = df.groupBy(file).agg(*summaries(df, "file", columns))
    for c in columns:
        if isinstance(df.schema[c].dataType, T.StringType):
            table = table.join(grams(df.select(file, F.col(f"`{c}`").alias("text")), f"{c}__grams"), "file", "left")
    if old is not None:
        table = old.where(F.col("file").isin(list(names))).unionByName(table, allowMissingColumns=True)
    path = f"{catalog._folder(m.table)}/_stats/v{m.version + 1:010d}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return catalog.commit(m, stats=path)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1]


def grams(texts: DataFrame, out: str) -> DataFrame:
    """(file, out): a bitmap of the hashes of all runs of ``GRAM`` characters in a file's texts."""
    spots = F.when(F.length("text") >= GRAM, F.sequence(F.lit(1), F.length("text") - (GRAM - 1)))
    cut = texts.select("file", F.explode(F.array_distinct(F.transform(spots, lambda i: _place(F.substring(F.col("text"), i, F.lit(GRAM)))))).alias("place"))
    return cut.groupBy("file").agg(F.bitmap_construct_agg("place").alias(out))


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BITS))


def candidates(catalog: Catalog, m: Manifest, where: ast.Expr | None) -> list[str]:
    """The files that may hold a matching row: those whose summary does not rule it out, and those without one."""
    if where is None or m.stats is None or len(m.files) < LEAST_FILES:
        return m.files
    table = catalog.summaries(m)
    may = _may({f.name: f for f in m.live if f"{f.stored}__lo" in table.columns}, where)
    if may is None:
        return m.files
    out = {r["file"] for r in table.where(~F.coalesce(may, F.lit(True))).select("file").collect()}
    return [f for f in m.files if _name(f) not in out]


def _may(fields: dict, e: ast.Expr) -> Column | None:
    """A condition on a summary row without which no row of the file matches; None if there is none."""
    if not isinstance(e, ast.Binary):
        return None
    if e.op in ("AND", "OR"):
        a, b = _may(fields, e.left), _may(fields, e.right)
        if e.op == "OR":
            return None if a is None or b is None else a | b
        return b if a is None else a if b is None else a & b
    name, literal, op = e.left, e.right, e.op
    if isinstance(name, ast.Literal) and isinstance(literal, ast.Name) and op in FLIP:
        name, literal, op = literal, name, FLIP[op]
    if not isinstance(name, ast.Name) or not isinstance(literal, ast.Literal) or name.name not in fields:
        return None
    f, v = fields[name.name], literal.value
    kind = TYPES[f.type].spark
    lo, hi = F.col(f"`{f.stored}__lo`"), F.col(f"`{f.stored}__hi`")
    some = F.col(f"`{f.stored}__n`") > 0
    if isinstance(kind, T.StringType) and isinstance(v, str):
        bounds = {"=": (lo <= v) & (hi >= v), "<": lo < v, "<=": lo <= v, ">": hi > v, ">=": hi >= v}
        if op in bounds:
            return some & bounds[op]
        if not v:
            return None
        enough = some & (F.col(f"`{f.stored}__long`") >= len(v))
        if op == "STARTSWITH":
            return enough & (F.left(lo, F.lit(len(v))) <= v) & (hi >= v) & F.array_contains(F.col(f"`{f.stored}__first`"), F.lower(F.lit(v[0])))
        if op == "ENDSWITH":
            return enough & F.array_contains(F.col(f"`{f.stored}__last`"), F.lower(F.lit(v[-1])))
        if op != "CONTAINS":
            return None
        if len(v) < GRAM:
            return enough
        held = F.col(f"`{f.stored}__grams`")
        places = F.array_distinct(F.array(*(_place(F.lit(v[i : i + GRAM])) for i in range(len(v) - GRAM + 1))))
        # The byte of a place, as two hexadecimal digits.
        byte = lambda at: F.conv(F.hex(F.substring(held, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return enough & F.coalesce(F.forall(places, lambda at: F.pmod(F.floor(byte(at) / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1), F.lit(True))
    if isinstance(v, Decimal) and not isinstance(v, bool) and not isinstance(kind, T.StringType):
        # Spark keeps NaN as the largest value, so ``hi`` stays an upper bound; a float literal rounds as in the predicate.
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            x = F.lit(float(v)).cast(kind)
        else:
            whole = v.to_integral_value(ROUND_CEILING if op in ("<", ">=") else ROUND_FLOOR)
            if op == "=" and whole != v:
                return F.lit(False)
            if abs(whole) >= 10**38:
                return None
            x = F.lit(whole).cast("decimal(38,0)")
            lo, hi = lo.cast("decimal(38,0)"), hi.cast("decimal(38,0)")
        bounds = {"=": (lo <= x) & (hi >= x), "<": lo < x, "<=": lo <= x, ">": hi > x, ">=": hi >= x}
        return some & bounds[op] if op in bounds else None
    return None
