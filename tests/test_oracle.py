"""Every query that SQL can express, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from basalt import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLE = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in core.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else str(v) if hasattr(v, "isoformat") else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(names, r.fetchall())


def test_skip_after_changes_with_taken_keys(spark, tmp_path):
    for t in core.TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.unlink(tmp_path / "customer.parquet")
    # The keys that the changes write, larger ones, one twice, one below 0 and none.
    more = " UNION ALL ".join(f"SELECT * REPLACE ({k} AS c_custkey) FROM customer WHERE c_custkey = {of}" for k, of in (("5000", 20), ("5001", 21), ("3", 22), ("-1", 23), ("NULL", 24)))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
        c.execute(f"COPY (SELECT * FROM customer UNION ALL SELECT * REPLACE (c_custkey + 5002 AS c_custkey) FROM customer UNION ALL {more}) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
        c.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
        want = c.execute(ORACLE["skip_after_changes"]).fetchall()
    df = QUERIES["skip_after_changes"](spark, str(tmp_path))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(df.columns, want)
    assert len(df.inputFiles()) < 5  # the others are ruled out


def test_ranges_of_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id").collect()
    for name in ("ranges_merge_all", "ranges_coarsen_all"):
        covered = {(r.user_id, p) for r in QUERIES[name](spark, SF).collect() for p in range(r.start, r.start + r.cnt)}
        assert {(r.user_id, r.event_id) for r in events} <= covered
    left = {(r.user_id, p) for r in QUERIES["ranges_complement_all"](spark, SF).collect() for p in range(r.start, r.start + r.cnt)}
    assert left and not left & {(r.user_id, r.event_id) for r in events}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
