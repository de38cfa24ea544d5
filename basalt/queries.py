"""One query for each operator of the engine, with the same question as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import maths
from basalt.operators import intervals, stats
from basalt.session import Engine

TABLES = "region nation customer supplier part orders lineitem events".split()

# name: (statement of the engine, DuckDB SQL)
STATEMENTS: dict[str, tuple[str, str]] = {}


def _same(name: str, sql: str, oracle: str | None = None) -> None:
    STATEMENTS[name] = (sql, oracle or sql)


_same("scan_all_region", "SELECT * FROM region")
_same("project_cols", "SELECT o_totalprice, o_orderkey FROM orders")
for _n, _op in {"eq": "=", "ne": "!=", "ne_angle": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    _same(f"filter_int_{_n}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25")
    _same(f"filter_str_{_n}", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment {_op} 'BUILDING'")
    _same(f"filter_double_{_n}", f"SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount {_op} 0.05")
_same("filter_eq_double_sign", "SELECT p_partkey FROM part WHERE p_size == 25", "SELECT p_partkey FROM part WHERE p_size = 25")
_same("filter_double_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07")
_same("filter_fraction_bound", "SELECT p_partkey, p_size FROM part WHERE p_size > 18.5 AND p_size <= 20.5")
_same("filter_negative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500")
_same("filter_contains", "SELECT p_partkey, p_name FROM part WHERE p_name CONTAINS 'a'", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a')")
_same("filter_startswith", "SELECT p_partkey, p_type FROM part WHERE p_type STARTSWITH 'S'", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
_same("filter_endswith", "SELECT p_partkey, p_name FROM part WHERE p_name ENDSWITH '1'", "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, '1')")
_same("filter_endswith_found", "SELECT s_suppkey, s_name FROM supplier WHERE s_name ENDSWITH '7'", "SELECT s_suppkey, s_name FROM supplier WHERE ends_with(s_name, '7')")
_same("filter_contains_empty", "SELECT p_partkey FROM part WHERE p_name CONTAINS ''", "SELECT p_partkey FROM part WHERE contains(p_name, '') AND length('') > 0")
_same("filter_startswith_empty", "SELECT p_partkey FROM part WHERE p_name STARTSWITH ''", "SELECT p_partkey FROM part WHERE starts_with(p_name, '')")
_same("precedence_and_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 OR l_returnflag = 'R' AND l_discount = 0.1")
_same("grouped_bool", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_returnflag = 'R') AND l_discount = 0.1")
_same("grouped_bool_right", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.1 AND (l_quantity > 45 OR l_returnflag = 'R')")
_same("col_vs_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount")
_same("lit_left", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 10 = l_linenumber + 7")
_same("lit_left_order", "SELECT p_partkey FROM part WHERE 10 >= p_size")
_same("const_true", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 1")
_same("const_false", "SELECT n_nationkey FROM nation WHERE 1 = 2")
_same("arith_add", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber + 2 > 6")
_same("arith_sub", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber - 3 = 2")
_same("arith_mul", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber * 2 + 1 = 7")
_same("arith_div_int", "SELECT p_partkey, p_size FROM part WHERE p_size / 7 = 3", "SELECT p_partkey, p_size FROM part WHERE p_size // 7 = 3")
_same("arith_div_zero", "SELECT p_partkey FROM part WHERE p_size / (p_size - p_size) = 1 OR p_size = 3", "SELECT p_partkey FROM part WHERE p_size // nullif(p_size - p_size, 0) = 1 OR p_size = 3")
_same("arith_div_float", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice / l_quantity > 1500")
_same("arith_float_zero", "SELECT c_custkey FROM customer WHERE c_acctbal / (c_acctbal - c_acctbal) > 0", "SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal > 0 THEN true ELSE false END")
_same("arith_nested", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((l_linenumber + 5) * 2 - 10) / 2 = 3", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((l_linenumber + 5) * 2 - 10) // 2 = 3")
_same("arith_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) >= 60000")
_same("filter_time", "SELECT o_orderkey FROM orders WHERE o_orderdate < '1993-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'")
_same("filter_time_found", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1995-03-01' AND o_orderdate < '1995-06-15 00:00:00'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-15 00:00:00'")
_same("type_bounds", "SELECT p_partkey FROM part WHERE p_size < 3000000000 AND p_partkey > -9999999999999999999")
_same("order_by_num", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
_same("order_by_str", "SELECT s_name, s_suppkey FROM supplier ORDER BY s_name, s_suppkey LIMIT 20")
_same("order_by_ts", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 30")
_same("order_desc", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey ASC LIMIT 25")
_same("order_hidden_key", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
_same("topk", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber LIMIT 20")
_same("long_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 40 AND l_discount > 0.01 AND l_discount < 0.09 AND l_tax >= 0.01 AND l_linestatus = 'O' AND l_linenumber != 3 OR l_quantity = 50 AND l_returnflag = 'A' AND l_extendedprice > 1000 AND l_tax <= 0.05 OR l_linenumber = 7 AND l_discount = 0.0 AND l_suppkey > 5 AND l_partkey > 5")


def _engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    root = f"{spark.conf.get('spark.sql.warehouse.dir')}/basalt-{uuid.uuid4().hex}"
    engine = Engine(spark, root, **options)
    for t in TABLES:
        engine.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return engine


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir).query(sql)


CUSTOMER = "CREATE TABLE c (c_custkey BIGINT, c_name VARCHAR(30) NOT NULL, c_nationkey INT, c_acctbal DOUBLE PRECISION, c_mktsegment TEXT)"
_COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _copy(spark: SparkSession, sf_dir: str, *then: str, **options) -> Engine:
    engine = _engine(spark, sf_dir, **options)
    engine.sql(CUSTOMER)
    engine.append("c", engine.external["customer"])
    for s in then:
        engine.sql(s)
    return engine


# name: (statements on a copy c of customer, last query, DuckDB SQL)
CHANGES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "insert_then_scan": (("INSERT INTO c (c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment) VALUES ('It''s new', -1, 3, 12.5, 'X')",), "SELECT * FROM c", f"SELECT {_COLUMNS} FROM customer UNION ALL SELECT -1, 'It''s new', 3, 12.5, 'X'"),
    "insert_multi": (("INSERT INTO c VALUES (-1, 'a', 1, 1.5, 'X'), (-2, 'b, c', 2, -2.5, 'Y')",), "SELECT * FROM c WHERE c_custkey < 5", f"SELECT {_COLUMNS} FROM customer WHERE c_custkey < 5 UNION ALL SELECT -1, 'a', 1, 1.5, 'X' UNION ALL SELECT -2, 'b, c', 2, -2.5, 'Y'"),
    "insert_partial_nulls": (("INSERT INTO c (c_custkey, c_name) VALUES (-7, 'part')",), "SELECT * FROM c WHERE c_custkey < 3", f"SELECT {_COLUMNS} FROM customer WHERE c_custkey < 3 UNION ALL SELECT -7, 'part', NULL, NULL, NULL"),
    "update_one": (("UPDATE c SET c_acctbal = 1.25 WHERE c_custkey = 7",), "SELECT * FROM c", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey = 7 THEN 1.25 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"),
    "update_many": (("UPDATE c SET c_acctbal = 0, C_MKTSEGMENT = 'A, B' WHERE c_nationkey < 5 AND c_acctbal < 0",), "SELECT * FROM c", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey < 5 AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey < 5 AND c_acctbal < 0 THEN 'A, B' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "update_all": (("UPDATE c SET c_nationkey = NULL",), "SELECT * FROM c", "SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "delete_range": (("DELETE FROM c WHERE c_custkey >= 10 AND c_custkey < 600",), "SELECT * FROM c", f"SELECT {_COLUMNS} FROM customer WHERE NOT (c_custkey >= 10 AND c_custkey < 600)"),
    "delete_then_insert": (("DELETE FROM c WHERE c_nationkey != 3", "INSERT INTO c VALUES (-3, 'z', 3, 0.5, 'Q')"), "SELECT * FROM c", f"SELECT {_COLUMNS} FROM customer WHERE c_nationkey = 3 UNION ALL SELECT -3, 'z', 3, 0.5, 'Q'"),
    "ddl_add_column": (("ALTER TABLE c ADD COLUMN extra UINT", "UPDATE c SET extra = 4000000000 WHERE c_custkey = 1"), "SELECT c_custkey, extra FROM c", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 4000000000 END AS extra FROM customer"),
    "ddl_drop_column": (("ALTER TABLE c DROP COLUMN c_acctbal",), "SELECT * FROM c", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"),
    "ddl_rename_column": (("ALTER TABLE c RENAME COLUMN c_acctbal TO balance",), "SELECT c_custkey, balance FROM c WHERE balance > 5000", "SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000"),
    "ddl_drop_then_add": (("ALTER TABLE c DROP COLUMN c_acctbal", "ALTER TABLE c ADD COLUMN c_acctbal TEXT"), "SELECT c_custkey, c_acctbal FROM c", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_acctbal FROM customer"),
}


def _change(name: str) -> Callable[[SparkSession, str], DataFrame]:
    statements, query, _ = CHANGES[name]
    return lambda spark, sf_dir: _copy(spark, sf_dir, *statements).query(query)


def rows_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copy(spark, sf_dir)
    done = [(s, engine.sql(s).rows_affected) for s in ("UPDATE c SET c_acctbal = 0 WHERE c_nationkey = 3", "DELETE FROM c WHERE c_custkey <= 100", "INSERT INTO c (c_custkey) VALUES (1), (2)")]
    return spark.createDataFrame([(s.split()[0], n) for s, n in done], "statement string, n long")


def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copy(spark, sf_dir).tables()


def read_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1")


def session_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.sql("BEGIN; SET search_path TO x; COMMIT")
    one, show = engine.query("SELECT 1::int").first()[0], engine.query("SHOW client_encoding").first()[0]
    return spark.createDataFrame([(one, show)], "one int, encoding string")


def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, keys = _engine(spark, sf_dir), ("server_version", "server_version_num", "client_encoding", "datestyle", "standard_conforming_strings", "timezone", "server_encoding")
    return spark.createDataFrame([(k, engine.query(f"SHOW {k}").first()[0]) for k in keys], "setting string, value string")


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copy(spark, sf_dir)
    engine.sql("INSERT INTO c (c_custkey, c_name, c_acctbal) VALUES ($1, $2, $3)", [-5, "O'Neil; DROP TABLE c", -1000.5])
    return engine.query("SELECT c_custkey, c_name, c_acctbal FROM c WHERE c_acctbal < $2 OR c_name = $1", ["Customer#000000007", -990])


def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copy(spark, sf_dir)
    engine.sql("CREATE TABLE other (a INT); DROP TABLE c; CREATE TABLE c (c_custkey BIGINT); INSERT INTO c VALUES (1)")
    return engine.tables().where("table_name in ('c', 'other')").join(engine.query("SELECT * FROM c"))


def datetime_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date in a DATETIME column (seconds), found by ISO timestamps."""
    engine = _engine(spark, sf_dir)
    engine.sql("CREATE TABLE d (o_orderkey BIGINT, at DATETIME)")
    engine.append("d", engine.external["orders"].select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at")))
    return engine.query("SELECT o_orderkey FROM d WHERE at >= '1995-03-01' AND at < '1995-03-20 12:00:00'")


def _ranged(spark: SparkSession, sf_dir: str, *then: str) -> Engine:
    engine = _engine(spark, sf_dir)
    engine.sql(CUSTOMER)
    engine.append("c", engine.external["customer"].repartitionByRange(8, "c_custkey").sortWithinPartitions("c_custkey"))
    for s in then:
        engine.sql(s)
    engine.analyze("c")
    return engine


FRACTIONS = "SELECT c_custkey FROM c WHERE c_custkey < 5.0000001 OR c_custkey >= 1400.0000001 AND c_custkey <= 1410.9999999 OR c_custkey > 1499.99999999"
PARTS = "SELECT c_custkey, c_name FROM c WHERE c_name CONTAINS '00077' OR c_name STARTSWITH 'Customer#00000001'"


def skip_fraction_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir).query(FRACTIONS)


def skip_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir).query(PARTS)


def skip_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a change leaves alone keep their summaries; new ones are read until the next ``analyze``.

    What the changes wrote is marked in a column of its own: customer may have any key, the new ones too.
    """
    engine = _ranged(spark, sf_dir, "ALTER TABLE c ADD COLUMN changed INT")
    engine.sql("UPDATE c SET c_custkey = 5000, changed = 1 WHERE c_custkey = 3; INSERT INTO c (c_custkey, c_name, changed) VALUES (5001, 'new', 1); DELETE FROM c WHERE c_custkey > 4 AND c_custkey < 9")
    return engine.query("SELECT c_custkey, c_name FROM c WHERE c_custkey < 12 OR changed = 1")


SKIP = "SELECT c_custkey, c_name FROM c WHERE c_custkey > 100 AND c_custkey <= 130 AND c_mktsegment STARTSWITH 'B' OR c_acctbal < -990"


def skip_equals_fullscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.sql(CUSTOMER)
    engine.append("c", engine.external["customer"].repartitionByRange(8, "c_custkey").sortWithinPartitions("c_custkey"))
    engine.analyze("c")
    return engine.query(SKIP)


def cache_equals_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copy(spark, sf_dir, cache_size=10)
    engine.query("SELECT * FROM c WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 5").count()
    engine.query("SELECT * FROM c WHERE c_nationkey = 3").count()
    engine.sql("DELETE FROM c WHERE c_custkey < 20")
    return engine.query("SELECT * FROM c WHERE c_nationkey = 3")


def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, c = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_size")
    return part.select("p_partkey", maths.power(c, F.lit(3), "I16").alias("cube"), maths.power(c, F.lit(20), "I32").alias("held"), maths.root(F.col("p_retailprice"), F.lit(3), "I32").alias("cube_root"), maths.root(c, F.lit(2), "U8").alias("root"), maths.power(c, F.lit(2)).alias("squared"))


def pow_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.round(F.pow("p_size", F.lit(2))).cast("long").alias("squared"), F.round(F.pow("p_size", F.lit(0.5))).cast("long").alias("root"))


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user with their number in the stream as position."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("pos"), "value")


def _ranges(spark: SparkSession, sf_dir: str, low: int | None = None) -> DataFrame:
    """A range of each event: of all, or of those of even (0) or odd (1) number, as two sides."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e if low is None else e.where(F.col("event_id") % 2 == low)
    return e.select("user_id", F.col("event_id").alias("start"), (F.col("event_id") % 40 + 1).alias("cnt"))


def _bounds(spark: SparkSession, sf_dir: str, low: int | None = None) -> DataFrame:
    return _ranges(spark, sf_dir, low).groupBy("user_id").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("cnt")) - F.min("start") + 5).alias("cnt"))


def _thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third list of ranges: of all events, shifted and of other lengths."""
    return _ranges(spark, sf_dir).select("user_id", (F.col("start") + 3).alias("start"), (F.col("start") % 25 + 1).alias("cnt"))


def sample_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any right sample: its size, rows of the table, the same again from the same rows in other order."""
    rows = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    one, two = stats.sample(rows, "key", 4096), stats.sample(rows.repartition(7, "l_linenumber"), "key", 4096)
    same = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("h"), F.count_distinct("l_orderkey").alias("orders"))
    stray = one.join(rows, "key", "left_anti").count()
    return same(one).join(same(two).select(F.col("h").alias("h2"))).select((F.col("orders") >= 1000).alias("varied"), "n", F.lit(stray == 0).alias("of_the_table"), (F.col("h") == F.col("h2")).alias("repeatable"))


def rule_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules chosen for part prices, against the plain scores of their thresholds over the rows of the operator's sample."""
    whole = _part(spark, sf_dir).select("p_partkey", "p_retailprice")
    rules = stats.threshold_rules(whole, "p_retailprice", "p_partkey").collect()
    part = stats.sample(whole, "p_partkey", 4096).withColumn("all", F.lit(0))
    plain = {(r.op, r.threshold): (r.runs, r.rows, r.score) for r in stats.threshold_scores(part, "p_retailprice", "p_partkey", ["all"], sorted({r.threshold for r in rules})).collect()}
    n = part.count()
    row = (len(rules) > 5, len(rules) <= 32, all(0 < r["rows"] <= max(0.05 * n, 16) for r in rules), all(plain[r.op, r.threshold] == (r.runs, r["rows"], r.score) for r in rules))
    return spark.createDataFrame([row], "some boolean, few boolean, rare boolean, scored_alike boolean")


def rule_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text rules of customer names, counted again by the predicates they stand for, over the operator's sample."""
    whole = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    c = stats.sample(whole, "c_custkey", 4096)
    rules, engine, n = stats.string_rules(whole, "c_name", "c_custkey").collect(), Engine(spark), c.count()
    engine.register("c", c)
    again = [engine.query(f"SELECT c_custkey FROM c WHERE c_name {r.op} $1", [r.value]).count() for r in rules if r["count"] == 1][:10]
    row = (len(rules) > 0, again == [r["rows"] for r in rules if r["count"] == 1][:10], all(0 < r["rows"] <= max(0.05 * n, 16) for r in rules), [r["rank"] for r in rules] == list(range(1, len(rules) + 1)))
    return spark.createDataFrame([row], "some boolean, counted_alike boolean, rare boolean, ranked boolean")


def fingerprint_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    first, other = stats.fingerprint(part), stats.fingerprint(part.repartition(5, "p_size"))
    changed = stats.fingerprint(part.withColumn("p_size", F.when(F.col("p_partkey") == 1, F.col("p_size") + 1).otherwise(F.col("p_size"))))
    one = first.join(other.select(F.col("hash").alias("h2"))).join(changed.select(F.col("hash").alias("h3")))
    return one.select("rows", (F.col("hash") == F.col("h2")).alias("order_does_not_matter"), (F.col("hash") != F.col("h3")).alias("a_value_does"))


# Positions that a set of ranges covers, one row each: what the interval oracles count.
_COVER = "SELECT DISTINCT user_id, p FROM (SELECT user_id, unnest(range(event_id, event_id + event_id % 40 + 1)) AS p FROM events WHERE event_id % 2 = {low})"
_ISLANDS = "SELECT user_id, min(p) AS start, count(*) AS cnt FROM (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM ({cover})) GROUP BY user_id, g"
_A, _B = _COVER.format(low=0), _COVER.format(low=1)
_BOUND = "SELECT user_id, min(event_id) AS s, max(event_id + event_id % 40 + 1) + 5 AS e FROM events WHERE event_id % 2 = 0 GROUP BY user_id"
# The same of all events.
_ALL = "SELECT DISTINCT user_id, p FROM (SELECT user_id, unnest(range(event_id, event_id + event_id % 40 + 1)) AS p FROM events)"
_BOUND_ALL = "SELECT user_id, min(event_id) AS s, max(event_id + event_id % 40 + 1) + 5 AS e FROM events GROUP BY user_id"
_THIRDS = "SELECT DISTINCT user_id, p FROM (SELECT user_id, unnest(range(event_id + 3, event_id + 3 + event_id % 25 + 1)) AS p FROM events)"
_GAPS = [0, 5, 20, 100, 300, 400, 1000]
_HOLES = f"SELECT start - lag(start + cnt) OVER (PARTITION BY user_id ORDER BY start) AS hole FROM ({_ISLANDS.format(cover=_ALL)})"
_GAP_SQL = f"SELECT CAST(gap AS INTEGER) AS gap FROM (SELECT gap, sum(CASE WHEN hole <= gap THEN hole * 64 ELSE 24000 END) AS cost FROM ({_HOLES}), (SELECT unnest({_GAPS}) AS gap) GROUP BY gap) ORDER BY cost, gap LIMIT 1"

_AFFIX = {k: f"SELECT feature, count(*) AS n FROM (SELECT {k}(p_type, k) AS feature FROM part, (SELECT unnest([1, 2, 3, 4, 6, 8, 12]) AS k) WHERE length(p_type) >= k) GROUP BY feature" for k in ("left", "right")}
_GRAM = "SELECT feature, count(*) AS n FROM (SELECT unnest([substr(p_name, i, {size}) FOR i IN range(1, length(p_name) - {less})]) AS feature FROM part WHERE length(p_name) >= {size}) GROUP BY feature"


def _gram(size: int, column: str = "p_name") -> str:
    return _GRAM.replace("{less}", str(size - 2)).replace("{size}", str(size)).replace("p_name", column)


_TOP = "SELECT kind, feature, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, feature) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, feature, n FROM ({q})" for k, q in {"prefix": _AFFIX["left"], "suffix": _AFFIX["right"], "byte": _gram(1, "p_type"), "bigram": _gram(2, "p_type"), "trigram": _gram(3, "p_type")}.items()) + ")) WHERE rank <= CASE kind WHEN 'prefix' THEN 12 WHEN 'suffix' THEN 12 WHEN 'byte' THEN 8 WHEN 'bigram' THEN 8 ELSE 6 END"
_SCORE = "SELECT op, threshold, CAST(sum(CASE WHEN now AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) AS BIGINT) AS runs, CAST(sum(CASE WHEN now THEN 1 ELSE 0 END) AS BIGINT) AS rows, CAST(sum(CASE WHEN now AND NOT coalesce(prev, false) THEN 24 ELSE 0 END + CASE WHEN now THEN 64 ELSE 0 END) AS BIGINT) AS score FROM (SELECT op, threshold, CASE WHEN op = '<' THEN value < threshold ELSE value > threshold END AS now, lag(CASE WHEN op = '<' THEN value < threshold ELSE value > threshold END) OVER (PARTITION BY op, threshold, user_id ORDER BY event_id) AS prev FROM events, (SELECT unnest(['<', '>']) AS op), (SELECT unnest([CAST(10 AS DOUBLE), CAST(50 AS DOUBLE)]) AS threshold)) GROUP BY op, threshold"

# name: (query, DuckDB SQL or None)
ANALYTICS: dict[str, tuple[Callable, str | None]] = {
    "rows_affected": (rows_affected, "SELECT 'UPDATE' AS statement, count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'DELETE', count(*) FROM customer WHERE c_custkey <= 100 UNION ALL SELECT 'INSERT', 2"),
    "list_tables": (list_tables, "SELECT * FROM (VALUES ('c', 5), ('customer', 5), ('events', 6), ('lineitem', 11), ('nation', 3), ('orders', 6), ('part', 6), ('region', 2), ('supplier', 4)) AS t(table_name, n_columns)"),
    "read_last": (read_last, "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1"),
    "limit_only": (_statement("SELECT o_orderkey FROM orders LIMIT 10"), None),
    "session_constants": (session_constants, "SELECT 1 AS one, 'UTF8' AS encoding"),
    "session_settings": (session_settings, "SELECT * FROM (VALUES ('server_version', '16.3'), ('server_version_num', '160003'), ('client_encoding', 'UTF8'), ('datestyle', 'ISO, MDY'), ('standard_conforming_strings', 'on'), ('timezone', 'UTC'), ('server_encoding', '')) AS t(setting, value)"),
    "parameters": (parameters, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < -990 OR c_name = 'Customer#000000007' UNION ALL SELECT -5, 'O''Neil; DROP TABLE c', -1000.5"),
    "drop_table": (drop_table, "SELECT t.table_name, t.n_columns, CAST(1 AS BIGINT) AS c_custkey FROM (VALUES ('c', 1), ('other', 1)) AS t(table_name, n_columns)"),
    "datetime_column": (datetime_column, "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-03-20 12:00:00'"),
    "skip_fraction_bound": (skip_fraction_bound, FRACTIONS.replace("FROM c ", "FROM customer ")),
    "skip_contains": (skip_contains, "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '00077') OR starts_with(c_name, 'Customer#00000001')"),
    "skip_after_changes": (skip_after_changes, "SELECT CASE WHEN c_custkey = 3 THEN 5000 ELSE c_custkey END AS c_custkey, c_name FROM customer WHERE c_custkey < 12 AND NOT (c_custkey > 4 AND c_custkey < 9) UNION ALL SELECT 5001, 'new'"),
    "math_functions": (math_functions, "SELECT p_partkey, CAST(least(p_size ** 3, 32767) AS SMALLINT) AS cube, CAST(least(CAST(p_size AS DOUBLE) ** 20, 2147483647) AS INTEGER) AS held, CAST(round(cbrt(p_retailprice)) AS INTEGER) AS cube_root, CAST(round(sqrt(p_size)) AS SMALLINT) AS root, CAST(p_size AS DOUBLE) ** 2 AS squared FROM part"),
    "skip_equals_fullscan": (skip_equals_fullscan, SKIP.replace("FROM c ", "FROM customer ").replace("c_mktsegment STARTSWITH 'B'", "starts_with(c_mktsegment, 'B')")),
    "cache_equals_uncached": (cache_equals_uncached, f"SELECT {_COLUMNS} FROM customer WHERE c_nationkey = 3 AND c_custkey >= 20"),
    "pow_root": (pow_root, "SELECT p_partkey, CAST(p_size * p_size AS BIGINT) AS squared, CAST(round(sqrt(p_size)) AS BIGINT) AS root FROM part"),
    "stats_minmax": (lambda s, d: stats.minmax(_lineitem(s, d)), " UNION ALL ".join(f"SELECT '{c}' AS col, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS n FROM lineitem" for c in _NUMBERS)),
    "stats_count_max": (lambda s, d: _lineitem(s, d).agg(F.count("*").alias("n"), F.max("l_orderkey").alias("last")), "SELECT count(*) AS n, max(l_orderkey) AS last FROM lineitem"),
    "stats_quantiles": (lambda s, d: stats.quantiles(_lineitem(s, d), "l_extendedprice", [0.1, 0.25, 0.5, 0.75, 0.9]), "SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]) AS p, unnest(quantile_disc(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9])) AS value FROM lineitem"),
    "stats_sample": (lambda s, d: stats.sample(_lineitem(s, d).select("l_orderkey", "l_quantity"), "l_orderkey", 4096), None),
    "stats_prefix_freq": (lambda s, d: stats.affix_frequency(_part(s, d), "p_type", "prefix"), _AFFIX["left"]),
    "stats_suffix_freq": (lambda s, d: stats.affix_frequency(_part(s, d), "p_type", "suffix"), _AFFIX["right"]),
    "stats_byte_freq": (lambda s, d: stats.ngram_frequency(_part(s, d), "p_name", 1), _gram(1)),
    "stats_bigram": (lambda s, d: stats.ngram_frequency(_part(s, d), "p_name", 2), _gram(2)),
    "stats_trigram": (lambda s, d: stats.ngram_frequency(_part(s, d), "p_name", 3), _gram(3)),
    "stats_top_features": (lambda s, d: stats.top_features(_part(s, d), "p_type"), _TOP),
    "stats_blocks": (lambda s, d: stats.block_stats(_part(s, d), "p_partkey", ["p_size", "p_name"]).drop("p_name__first", "p_name__last"), "SELECT CAST(floor(p_partkey / 1024) AS BIGINT) AS block, count(*) AS rows, min(p_size) AS p_size__lo, max(p_size) AS p_size__hi, count(p_size) AS p_size__n, min(p_name) AS p_name__lo, max(p_name) AS p_name__hi, count(p_name) AS p_name__n, CAST(min(length(p_name)) AS INTEGER) AS p_name__short, CAST(max(length(p_name)) AS INTEGER) AS p_name__long FROM part GROUP BY 1"),
    "stats_sample_properties": (sample_properties, "SELECT count(DISTINCT l_orderkey) >= 1000 AS varied, least(count(*), 4096) AS n, true AS of_the_table, true AS repeatable FROM lineitem"),
    "stats_fingerprint_properties": (fingerprint_properties, "SELECT count(*) AS rows, true AS order_does_not_matter, true AS a_value_does FROM part"),
    "rule_thresholds": (rule_thresholds, "SELECT true AS some, true AS few, true AS rare, true AS scored_alike"),
    "rule_strings": (rule_strings, "SELECT true AS some, true AS counted_alike, true AS rare, true AS ranked"),
    "rule_ranges_unbroken": (lambda s, d: intervals.runs_across(s.read.parquet(f"{d}/events.parquet").where("value < 50"), "event_id"), "SELECT min(event_id) AS start, count(*) AS cnt FROM (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value < 50) GROUP BY g"),
    "ranges_intersect_many": (lambda s, d: intervals.intersect_many([_ranges(s, d, 0), _ranges(s, d, 1), _thirds(s, d)], ["user_id"]), _ISLANDS.format(cover=f"SELECT * FROM ({_A}) INTERSECT SELECT * FROM ({_B}) INTERSECT SELECT * FROM ({_THIRDS})")),
    "ranges_cheapest_gap": (lambda s, d: s.createDataFrame([(intervals.cheapest_gap(_ranges(s, d), ["user_id"], _GAPS, 24_000, 64),)], "gap int"), _GAP_SQL),
    "stats_fingerprint": (lambda s, d: stats.fingerprint(_part(s, d)), None),
    "rule_scores": (lambda s, d: stats.threshold_scores(_rows(s, d), "value", "pos", ["user_id"], [10, 50]), _SCORE),
    "rule_ranges": (lambda s, d: intervals.runs(s.read.parquet(f"{d}/events.parquet").where("value < 50").withColumn("part", F.floor(F.col("event_id") / 1024)), ["part"], "event_id"), "SELECT part, min(event_id) AS start, count(*) AS cnt FROM (SELECT *, event_id - row_number() OVER (PARTITION BY part ORDER BY event_id) AS g FROM (SELECT event_id, CAST(floor(event_id / 1024) AS BIGINT) AS part FROM events WHERE value < 50)) GROUP BY part, g"),
    "ranges_merge": (lambda s, d: intervals.merge(_ranges(s, d, 0), ["user_id"]), _ISLANDS.format(cover=_A)),
    "ranges_coarsen": (lambda s, d: intervals.coarsen(_ranges(s, d, 0), ["user_id"], 100), f"SELECT user_id, min(start) AS start, CAST(max(start + cnt) - min(start) AS BIGINT) AS cnt FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start) AS g FROM (SELECT *, CASE WHEN start <= lag(start + cnt) OVER (PARTITION BY user_id ORDER BY start) + 100 THEN 0 ELSE 1 END AS fresh FROM ({_ISLANDS.format(cover=_A)}))) GROUP BY user_id, g"),
    "ranges_intersect": (lambda s, d: intervals.intersect(_ranges(s, d, 0), _ranges(s, d, 1), ["user_id"]), _ISLANDS.format(cover=f"SELECT * FROM ({_A}) INTERSECT SELECT * FROM ({_B})")),
    "ranges_complement": (lambda s, d: intervals.complement(_ranges(s, d, 0), _bounds(s, d, 0), ["user_id"]), _ISLANDS.format(cover=f"SELECT user_id, unnest(range(s, e)) AS p FROM ({_BOUND}) EXCEPT SELECT * FROM ({_A})")),
    "ranges_merge_all": (lambda s, d: intervals.merge(_ranges(s, d), ["user_id"]), _ISLANDS.format(cover=_ALL)),
    "ranges_coarsen_all": (lambda s, d: intervals.coarsen(_ranges(s, d), ["user_id"], 100), f"SELECT user_id, min(start) AS start, CAST(max(start + cnt) - min(start) AS BIGINT) AS cnt FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start) AS g FROM (SELECT *, CASE WHEN start <= lag(start + cnt) OVER (PARTITION BY user_id ORDER BY start) + 100 THEN 0 ELSE 1 END AS fresh FROM ({_ISLANDS.format(cover=_ALL)}))) GROUP BY user_id, g"),
    "ranges_complement_all": (lambda s, d: intervals.complement(_ranges(s, d), _bounds(s, d), ["user_id"]), _ISLANDS.format(cover=f"SELECT user_id, unnest(range(s, e)) AS p FROM ({_BOUND_ALL}) EXCEPT SELECT * FROM ({_ALL})")),
    "ranges_overlap": (lambda s, d: intervals.overlapping(_ranges(s, d, 0), _ranges(s, d, 1), ["user_id"]), "SELECT DISTINCT a.user_id, a.event_id AS start, a.event_id % 40 + 1 AS cnt FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND a.event_id < b.event_id + b.event_id % 40 + 1 AND b.event_id < a.event_id + a.event_id % 40 + 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _statement(sql) for n, (sql, _) in STATEMENTS.items()} | {n: _change(n) for n in CHANGES} | {n: f for n, (f, _) in ANALYTICS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in STATEMENTS.items()} | {n: sql for n, (_, _, sql) in CHANGES.items()} | {n: sql for n, (_, sql) in ANALYTICS.items() if sql}
