"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Median of 5 after a warm-up."""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pyspark.sql import SparkSession

from basalt import queries as core

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def duckdb_seconds() -> dict[str, float]:
    """The same questions in DuckDB on the same files and threads, results kept in a table; empty without DuckDB."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    con = duckdb.connect(config={"threads": int(CPUS)})
    for t in core.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    oracle, took = core.oracle_sql(), {}
    asked = {
        "full_scan_filter": "SELECT * FROM lineitem WHERE l_extendedprice >= 100 AND l_discount < 0.09",
        "string_filter": "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND starts_with(p_type, 'S')",
        "selective_noskip": "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_orderkey >= 1000 AND l_orderkey < 1200",
        "topk": "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100",
        "stats_minmax": oracle["stats_minmax"], "interval_merge": oracle["ranges_merge"], "interval_intersect": oracle["ranges_intersect"],
    }
    for name, sql in asked.items():
        times = []
        for _ in range(6):
            t = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE out AS {sql}")
            times.append(time.perf_counter() - t)
        took[name] = round(median(times[1:]), 4)
    return took


def main() -> None:
    folder = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"file://{folder}/checkpoints").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = core._engine(spark, SF_DIR)
    cached = core._engine(spark, SF_DIR, cache_size=10)
    engine.sql("CREATE TABLE li (l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_returnflag TEXT)")
    engine.append("li", engine.external["lineitem"].repartitionByRange(16, "l_orderkey").sortWithinPartitions("l_orderkey"))
    selective = "SELECT l_orderkey, l_extendedprice FROM li WHERE l_orderkey >= 1000 AND l_orderkey < 1200"
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    jobs = {
        "full_scan_filter": lambda: run(engine.query("SELECT * FROM lineitem WHERE l_extendedprice >= 100 AND l_discount < 0.09")),
        "string_filter": lambda: run(engine.query("SELECT p_partkey FROM part WHERE p_name CONTAINS 'a' AND p_type STARTSWITH 'S'")),
        "selective_noskip": lambda: run(engine.query(selective)),
        "topk": lambda: engine.query("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100").collect(),
        "stats_minmax": lambda: core.ANALYTICS["stats_minmax"][0](spark, SF_DIR).collect(),
        "interval_merge": lambda: run(core.ANALYTICS["ranges_merge"][0](spark, SF_DIR)),
        "interval_intersect": lambda: run(core.ANALYTICS["ranges_intersect"][0](spark, SF_DIR)),
        "cached_rerun": lambda: cached.query("SELECT l_orderkey FROM lineitem WHERE l_quantity = 50").count(),
        "update": lambda: engine.sql("UPDATE li SET l_discount = 0.01 WHERE l_orderkey >= 2000 AND l_orderkey < 2400"),
        # Each turn deletes rows that are there: the next two orders.
        "delete": lambda: engine.sql(f"DELETE FROM li WHERE l_orderkey >= {next(orders)} AND l_orderkey < {next(orders)}"),
    }
    orders = iter(range(9000, 9400, 2))
    took = {}

    def measure(name, job):
        job()
        took[name] = []
        for _ in range(5):
            t = time.perf_counter()
            job()
            took[name].append(time.perf_counter() - t)

    for name, job in jobs.items():
        measure(name, job)
    engine.analyze("li")
    measure("selective_skip", lambda: run(engine.query(selective)))
    seconds = {k: round(median(v), 4) for k, v in took.items()}
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None, "duckdb": duckdb_seconds()}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
