"""INSERT, UPDATE and DELETE as copy-on-write of the files that hold a matching row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.errors import NO_COLUMN, SYNTAX, SqlError
from basalt.functions.types import TYPES, coerce
from basalt.operators.skipping import candidates
from basalt.plans import ast
from basalt.plans.compile import predicate
from basalt.sources.catalog import Catalog, Manifest

#: So many files of INSERT statements are written anew as few, of about so many bytes. Bulk loads keep their files.
COMPACT_FILES, COMPACT_BYTES = 64, 128 << 20


def insert(catalog: Catalog, s: ast.Insert) -> int:
    m = catalog.load(s.table)
    fields = {f.name: f for f in m.live}
    columns = s.columns or tuple(fields)
    for c in columns:
        if c not in fields:
            raise SqlError(NO_COLUMN, f"no column {c} in {s.table}")
    rows = []
    for values in s.rows:
        if len(values) != len(columns):
            raise SqlError(SYNTAX, f"{len(columns)} columns but {len(values)} values")
        given = {c: coerce(v, TYPES[fields[c].type]) for c, v in zip(columns, values)}
        rows.append(tuple(given.get(n) for n in fields))
    append(catalog, m, catalog.spark.createDataFrame(rows, m.schema()).coalesce(1), "insert")
    return len(rows)


def append(catalog: Catalog, m: Manifest, df: DataFrame, kind: str = "data") -> Manifest:
    """Adds rows (by column name; missing columns are NULL) as new files."""
    whole = df.select(*(F.col(f"`{f.name}`").cast(TYPES[f.type].spark).alias(f.name) if f.name in df.columns else F.lit(None).cast(TYPES[f.type].spark).alias(f.name) for f in m.live))
    m = catalog.commit(m, files=m.files + catalog.write(m, whole, kind))
    if kind == "insert" and len(inserted(m)) >= COMPACT_FILES:
        m = compact(catalog, m)
    return m


def inserted(m: Manifest) -> list[str]:
    return [f for f in m.files if f.rsplit("/", 2)[1].startswith("insert-")]


def compact(catalog: Catalog, m: Manifest) -> Manifest:
    """Puts the rows of the INSERT statements' files together; all other files and their summaries stay."""
    small = inserted(m)
    if len(small) < 2:
        return m
    parts = -(-sum(catalog.files.size(f) for f in small) // COMPACT_BYTES)
    new = catalog.write(m, catalog.read(m, small).coalesce(max(1, parts)))
    at, gone = m.files.index(small[0]), set(small)
    return catalog.commit(m, files=[f for f in m.files[:at] if f not in gone] + new + [f for f in m.files[at:] if f not in gone])


def _matching(catalog: Catalog, m: Manifest, expr: ast.Expr | None, where: Column) -> tuple[dict[str, str], int]:
    """Files with a matching row (as the manifest names them), and the number of such rows. Files that
    their summaries rule out are not read."""
    may = candidates(catalog, m, expr)
    if not may:
        return {}, 0
    df = catalog.spark.read.schema(m.stored_schema()).parquet(*may)
    df = df.select(*(F.col(f"`{f.stored}`").alias(f.name) for f in m.live), F.col("_metadata.file_name").alias("_file"))
    hit = {r["_file"]: r["n"] for r in df.where(where).groupBy("_file").agg(F.count("*").alias("n")).collect()}
    return {f: f for f in may if f.rsplit("/", 1)[1] in hit}, sum(hit.values())


def _rewrite(catalog: Catalog, m: Manifest, expr: ast.Expr | None, where: Column, change) -> int:
    hit, n = _matching(catalog, m, expr, where)
    if n:
        new = catalog.write(m, change(catalog.read(m, list(hit))))
        catalog.commit(m, files=[f for f in m.files if f not in hit] + new)
    return n


def update(catalog: Catalog, s: ast.Update) -> int:
    m = catalog.load(s.table)
    fields = {f.name.lower(): f for f in m.live}
    values = {}
    for name, text in s.sets:
        if name.lower() not in fields:
            raise SqlError(NO_COLUMN, f"no column {name} in {s.table}")
        f = fields[name.lower()]
        values[f.name] = F.lit(coerce(text, TYPES[f.type])).cast(TYPES[f.type].spark)
    where = F.lit(True) if s.where is None else F.coalesce(predicate(s.where, m.schema()), F.lit(False))
    return _rewrite(catalog, m, s.where, where, lambda df: df.select(*(F.when(where, values[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns)))


def delete(catalog: Catalog, s: ast.Delete) -> int:
    m = catalog.load(s.table)
    where = F.coalesce(predicate(s.where, m.schema()), F.lit(False))
    return _rewrite(catalog, m, s.where, where, lambda df: df.where(~where))
