"""Predicates on one row, statements, DML against a model, skipping and cache against plain scans."""

import random
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from basalt.errors import SqlError
from basalt.functions import maths
from basalt.operators import dml, skipping, stats
from basalt.operators.cache import ResultCache
from basalt.plans.parser import parse
from basalt.session import Engine

ROW = dict(id=7, floors=12, cost=9100, name="Harbour mill", town="Ostby", area=812.25, slope=2.5, built=180400, depth=-6, nan=float("nan"), big=Decimal(10) ** 37, listed=True, nothing=None)
SCHEMA = "id int, floors short, cost int, name string, town string, area double, slope float, built long, depth byte, nan double, big decimal(38,0), listed boolean, nothing int"


@pytest.fixture(scope="module")
def one(spark):
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame([tuple(ROW.values())], SCHEMA))
    return engine


PREDICATES = {
    # AND before OR, and brackets against it
    "id = 1 OR floors > 11 AND cost = 9100": True, "(id = 1 OR floors > 11) AND cost = 9101": False, "id = 7 OR floors = 1 AND cost = 1": True, "(id = 7 OR floors = 1) AND cost = 1": False,
    "(town CONTAINS 'stb' OR name = 'x') AND floors <= 12": True, "floors > 3 AND (cost = 1 OR name CONTAINS 'Mill')": False,
    # arithmetic on either side
    "( (floors + 2) * 3 - 2 ) / 4 = 10": True, "20 = id + 13": True, "cost - 100 = 3 * 3000": True, "id / 0 = 1": False, "id / 2 = 3": True, "0 - id / 2 = -3": True, "id * 100000 * 100000 > 0": True, "-id = -7": True,
    "area / (area - area) > 1e300": True, "big + 1 > big": True, "1 = 1": True,
    # mixed types
    "slope > 2.0 AND built < 180401 AND depth = -6": True, "slope = 2.5": True, "cost = cost": True, "floors > 11.5": True, "floors <= 11.5": False, "floors = 12.5": False, "floors != 12.5": True, "floors < 300000": True,
    "floors > -99999999999999999999": True, "big > 9999999999999999999": True, "floors >= 12 and floors <= 12": True,
    # text
    "name CONTAINS ''": False, "name STARTSWITH ''": True, "name ENDSWITH ''": True, "name contains 'ur m'": True, "name CONTAINS 'harbour'": False, "name ENDSWITH 'mill'": True, "name >= 'Harbour'": True,
    "name < 'Harbour mill'": False, "name <> 'x'": True, "'Harbour mill' = name": True,
    # NaN, booleans and NULL
    "nan = nan": False, "nan != nan": True, "nan > 0": False, "nan < 0": False, "nan != 1.0": True, "listed = TRUE": True, "listed != TRUE": False, "nothing = 1": False, "nothing != 1": False, "nothing = 1 OR id = 7": True,
}


@pytest.mark.parametrize("text,expected", PREDICATES.items())
def test_predicate(one, text, expected):
    assert (one.query(f"SELECT id FROM t WHERE {text}").count() == 1) is expected


@pytest.mark.parametrize("sql,state", {
    "SELECT nope FROM t": "42703", "SELECT id FROM missing": "0A000", "SELECT id FROM t WHERE nope = 1": "42703", "SELECT id FROM t WHERE": "42601", "SELECT id FROM t WHERE name = 'open": "42601",
    "SELECT id FROM t WHERE name > 5": "42804", "SELECT id FROM t WHERE id": "42804", "SELECT id FROM t LIMIT x": "42601", "SELECT id FROM t ORDER BY nope": "42703", "DELETE FROM t": "42601", "VACUUM": "0A000",
    "": "42601", "CREATE TABLE x (a MONEY)": "42804", "UPDATE t SET id = 1": "0A000", "SELECT id, FROM t": "42601",
}.items())
def test_errors(one, sql, state):
    with pytest.raises(SqlError) as e:
        one.sql(sql)
    assert e.value.state == state


def test_parse_types():
    (s,) = parse("CREATE TABLE t (a TINYINT, b UBIGINT, c DOUBLE PRECISION, d VARCHAR(10, 2) NOT NULL, e TIMESTAMP WITH TIME ZONE, f CHARACTER VARYING (5), g BOOLEAN PRIMARY KEY)")
    assert [t for _, t in s.columns] == ["I8", "U64", "F64", "STRING", "DATETIME", "STRING", "BOOL"]
    assert len(parse("SELECT a FROM t WHERE b = ';'; BEGIN;")) == 2


def test_pushdown_and_topk(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id as int) a", "cast(id as double) b", "cast(id as string) s", "id c").write.parquet(str(tmp_path / "p"))
    engine = Engine(spark)
    engine.register("p", spark.read.parquet(str(tmp_path / "p")))
    plan = engine.query("SELECT a FROM p WHERE a >= 5 AND b <= 10.5 AND s STARTSWITH '9' ORDER BY a LIMIT 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,5)" in plan and "LessThanOrEqual(b,10.5)" in plan and "IsNotNull(s)" in plan and "TakeOrderedAndProject" in plan and "c#" not in plan.split("ReadSchema")[1]


def test_dml_against_a_model(spark, tmp_path):
    engine, rng, model = Engine(spark, str(tmp_path / "db"), cache_size=5), random.Random(5), []
    engine.sql("CREATE TABLE e (id BIGINT, v INT, s TEXT)")
    for step in range(14):
        kind = rng.choice(["insert", "insert", "update", "delete"])
        cut = rng.randrange(40)
        if kind == "insert":
            new = [(len(model) * 100 + i, rng.randrange(50), rng.choice(["ab", "b'c", ""])) for i in range(3)]
            quote = lambda s: "'" + s.replace("'", "''") + "'"
            assert engine.sql("INSERT INTO e (s, id, v) VALUES " + ", ".join(f"({quote(s)}, {i}, {v})" for i, v, s in new)).rows_affected == 3
            model += new
        elif kind == "update":
            n = engine.sql(f"UPDATE e SET v = {step} WHERE v < {cut} AND s CONTAINS 'b'").rows_affected
            assert n == sum(v < cut and "b" in s for _, v, s in model)
            model = [(i, step if v < cut and "b" in s else v, s) for i, v, s in model]
        else:
            n = engine.sql(f"DELETE FROM e WHERE v > {45 - cut // 8}").rows_affected
            assert n == sum(v > 45 - cut // 8 for _, v, _ in model)
            model = [r for r in model if r[1] <= 45 - cut // 8]
        assert sorted(map(tuple, engine.query("SELECT * FROM e").collect())) == sorted(model)


def test_lost_update_is_refused(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.sql("CREATE TABLE x (a INT)")
    old = engine.catalog.load("x")
    engine.sql("INSERT INTO x VALUES (1)")
    with pytest.raises(SqlError) as e:
        engine.catalog.commit(old, files=[])
    assert e.value.state == "40001" and engine.query("SELECT a FROM x").count() == 1


def test_bulk_loads_keep_their_files_and_inserts_are_put_together(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.sql("CREATE TABLE x (a BIGINT)")
    engine.append("x", spark.range(640).selectExpr("id a").repartitionByRange(64, "a"))
    engine.analyze("x")
    assert len(engine.catalog.load("x").files) == 64
    for i in range(dml.COMPACT_FILES):
        engine.sql("INSERT INTO x VALUES ($1)", [1000 + i])
    m = engine.catalog.load("x")
    assert len(m.files) == 65 and engine.query("SELECT a FROM x").count() == 704
    assert len(skipping.candidates(engine.catalog, m, parse("SELECT a FROM x WHERE a < 5")[0].where)) == 2
    assert engine.expire("x") > 64 and engine.query("SELECT a FROM x WHERE a >= 1000").count() == 64 and engine.sql("DELETE FROM x WHERE a < 10").rows_affected == 10


def test_a_crashed_commit_leaves_the_table_whole(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.sql("CREATE TABLE x (a INT); INSERT INTO x VALUES (1)")
    # What a writer leaves that dies while it writes its manifest, or before it is renamed.
    (tmp_path / "db/x/_manifests/v0000000002.json-77.tmp").write_text('{"table": "x", "ver')
    assert engine.query("SELECT a FROM x").count() == 1
    engine.sql("INSERT INTO x VALUES (2)")
    assert engine.query("SELECT a FROM x").count() == 2 and engine.catalog.load("x").version == 2


def test_tables_go_and_come_back(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), cache_size=4)
    engine.sql("CREATE TABLE x (a INT); INSERT INTO x VALUES (1)")
    assert engine.query("SELECT * FROM x").count() == 1
    engine.sql("DROP TABLE x")
    with pytest.raises(SqlError) as e:
        engine.sql("SELECT * FROM x")
    assert e.value.state == "42P01"
    engine.sql("CREATE TABLE x (b TEXT)")
    assert engine.query("SELECT * FROM x").columns == ["b"]
    engine.register("y", spark.range(3))
    assert engine.query("SELECT * FROM y").count() == 3
    engine.register("y", spark.range(5))
    assert engine.query("SELECT * FROM y").count() == 5


def test_parameters_are_values(one):
    ask = lambda sql, *args: one.query(f"SELECT id FROM t WHERE {sql}", args).count()
    assert ask("id = $1 AND name = $2", 7, "Harbour mill") == 1 and ask("name = $1", "' OR 1 = 1 OR name = '") == 0
    assert ask("depth = $1 AND slope = $2 AND listed = $3", -6, 2.5, True) == 1 and ask("big = $1", Decimal(10) ** 37) == 1
    with pytest.raises(SqlError) as e:
        ask("id = $2", 1)
    assert e.value.state == "42P02"


def test_power_and_root(spark):
    df = spark.createDataFrame([(2.0, 10.0), (-3.0, 3.0), (10.0, 40.0), (-10.0, 41.0), (6.25, 0.5), (0.5, 0.0)], "x double, y double")
    got = df.select(maths.power(F.col("x"), F.col("y"), "I16").alias("p"), maths.power(F.col("x"), F.col("y"), "I64").alias("q"), maths.root(F.abs("x"), F.col("y"), "U8").alias("r")).collect()
    assert [r.p for r in got] == [1024, -27, 32767, -32768, 3, 1] and [r.q for r in got] == [1024, -27, 2**63 - 1, -(2**63), 3, 1]
    assert [r.r for r in got] == [1, 1, 1, 1, 39, None]


def test_values_and_domains(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.sql("CREATE TABLE d (u UTINYINT, f REAL, b BOOL, t DATETIME, c CHAR(3), w UBIGINT)")
    engine.sql("INSERT INTO d VALUES (255, 1.5, yes, '1970-01-02', 'long text', 18446744073709551615), (NULL, -2, off, 7, NULL, 0)")
    assert [tuple(r) for r in engine.query("SELECT * FROM d ORDER BY t DESC").collect()] == [(255, 1.5, True, 86400, "long text", Decimal(2**64 - 1)), (None, -2.0, False, 7, None, Decimal(0))]
    for bad, state in {"(256, 1, yes, 1, 'a', 1)": "22003", "('x', 1, yes, 1, 'a', 1)": "22P02", "(1, 1, maybe, 1, 'a', 1)": "22P02", "(1, 2)": "42601"}.items():
        with pytest.raises(SqlError) as e:
            engine.sql(f"INSERT INTO d VALUES {bad}")
        assert e.value.state == state
    with pytest.raises(SqlError):
        engine.sql("CREATE TABLE d (a INT)")


def test_skipping_is_a_superset_and_skips(spark, tmp_path):
    engine, rng = Engine(spark, str(tmp_path / "db")), random.Random(11)
    engine.sql("CREATE TABLE s (id BIGINT, v DOUBLE, name TEXT, big UBIGINT)")
    engine.append("s", spark.range(400).selectExpr("id", "case when id % 37 = 0 then double('nan') when id % 41 = 0 then null else id % 50 / 2 end v", "concat(char(97 + id div 50), id) name", "cast(id as decimal(20,0)) big").repartitionByRange(8, "id"))
    plain = Engine(spark)
    plain.register("s", engine.query("SELECT * FROM s"))
    engine.analyze("s")
    m = engine.catalog.load("s")
    (narrow,) = parse("SELECT id FROM s WHERE id < 20 AND name STARTSWITH 'a'")
    assert len(m.files) == 8 and len(skipping.candidates(engine.catalog, m, narrow.where)) == 1
    fraction = lambda: f"{rng.randrange(-3, 420)}.{'0' * rng.randrange(11)}{rng.randrange(10)}"
    atoms = [lambda: f"id {rng.choice(['=', '<', '<=', '>', '>=', '!='])} {rng.randrange(-5, 420)}", lambda: f"id {rng.choice(['=', '<', '<=', '>', '>=', '!='])} {fraction()}", lambda: f"big {rng.choice(['=', '<', '<=', '>', '>='])} {fraction()}", lambda: f"name CONTAINS '{rng.choice(['b12', '399', 'a1', 'h37', 'zzz', 'c10', '0'])}'", lambda: f"{rng.randrange(30)}.5 {rng.choice(['=', '<', '>='])} v", lambda: f"name {rng.choice(['STARTSWITH', 'ENDSWITH', 'CONTAINS', '=', '>='])} '{rng.choice(['a', 'b1', '9', 'h399', ''])}'", lambda: f"id + 1 > {rng.randrange(400)}"]
    for _ in range(25):
        where = rng.choice(atoms)()
        for _ in range(rng.randrange(3)):
            where = f"({where}) {rng.choice(['AND', 'OR'])} {rng.choice(atoms)()}"
        sql = f"SELECT id FROM s WHERE {where}"
        assert sorted(map(tuple, engine.query(sql).collect())) == sorted(map(tuple, plain.query(sql).collect())), where
    for sql, n in {"id < 5.0000001": 6, "id < 0.0000001": 1, "id >= 398.99999999": 1, "id > 399.00000001": 0, "id = 5.0000001": 0}.items():
        assert engine.query(f"SELECT id FROM s WHERE {sql}").count() == n, sql
    count = lambda sql: len(skipping.candidates(engine.catalog, engine.catalog.load("s"), parse(f"SELECT id FROM s WHERE {sql}")[0].where))
    assert count("name CONTAINS 'b99'") == 1 and count("name CONTAINS 'zzz'") == 0 and count("id = 5.0000001") == 0
    engine.sql("UPDATE s SET id = 5000 WHERE id = 399")
    assert engine.query("SELECT id FROM s WHERE id = 5000").count() == 1
    # Seven files keep their summaries; the new one is read until it has one.
    assert count("id < 20") == 2
    engine.analyze("s")
    assert count("id < 20") == 1 and engine.query("SELECT id FROM s WHERE id = 5000").count() == 1
    engine.sql("ALTER TABLE s ADD COLUMN extra INT")
    assert engine.query("SELECT id FROM s WHERE extra = 1").count() == 0 and count("id < 20") == 1


def test_cache_keys_and_invalidation(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), cache_size=2)
    engine.sql("CREATE TABLE k (a INT); INSERT INTO k VALUES (3), (1), (2)")
    assert engine.query("SELECT a FROM k LIMIT 1").count() == 1
    assert [r.a for r in engine.query("SELECT a FROM k ORDER BY a DESC").collect()] == [3, 2, 1]
    assert engine.query("SELECT a FROM k ORDER BY a DESC") is engine.query("SELECT a FROM k ORDER BY a DESC")
    engine.sql("DELETE FROM k WHERE a = 2")
    assert len(engine.cache) == 0 and engine.query("SELECT a FROM k").count() == 2


def test_result_cache():
    gone = []
    c = ResultCache(2, gone.append)
    assert c.insert("a", 1) and not c.insert("a", 2) and c.insert("b", 2) and not c.insert("c", 3)
    assert c.get("a") == 1
    c.force_insert("c", 3)
    assert gone == [2] and c.get_all(["a", "b", "c"]) == {"a": 1, "c": 3}
    c.retain(lambda k, v: v > 1)
    assert c.drain() == [("c", 3)] and len(c) == 0 and c.remove_oldest() is None


def test_intervals_against_sets(spark):
    from basalt.operators import intervals as I

    rng = random.Random(3)
    make = lambda: [(k, rng.randrange(60), rng.randrange(0, 9)) for k in (1, 2) for _ in range(8)]
    cover = lambda rs: {(k, p) for k, s, n in rs for p in range(s, s + n)}
    back = lambda df: [(r.k, r.start, r.cnt) for r in df.collect()]
    for _ in range(3):
        a, b = make(), make()
        x, y = (spark.createDataFrame(r, "k long, start long, cnt long") for r in (a, b))
        bounds = spark.createDataFrame([(1, 5, 50), (2, 0, 70)], "k long, start long, cnt long")
        assert cover(back(I.merge(x, ["k"]))) == cover(a)
        assert cover(back(I.intersect(x, y, ["k"]))) == cover(a) & cover(b)
        assert cover(back(I.complement(x, bounds, ["k"]))) == cover([(1, 5, 50), (2, 0, 70)]) - cover(a)
        assert sorted(back(I.overlapping(x, y, ["k"]))) == sorted(r for r in a if cover([r]) & cover(b))
        assert cover(back(I.intersect_many([x, y, bounds], ["k"]))) == cover(a) & cover(b) & cover([(1, 5, 50), (2, 0, 70)])
        gap = I.cheapest_gap(x, ["k"], [0, 1, 3, 9], 500, 64)
        cost = {g: len(c := back(I.coarsen(x, ["k"], g))) * 500 + len(cover(c) - cover(a)) * 64 for g in (0, 1, 3, 9)}
        assert cost[gap] == min(cost.values())
    assert back(I.merge(x.where("false"), ["k"])) == []
    at = spark.createDataFrame([(i,) for i in range(60_000, 210_000) if i % 1000], "p long")
    whole = {(r.start, r.cnt) for r in I.runs_across(at.union(at.select((F.col("p") + 10**6).alias("p"))).union(spark.range(196_000, 197_000, 1000).selectExpr("id p")), "p").collect()}
    assert len(whole) == 299 and (195_001, 1999) in whole


def test_string_rules_against_plain_loops(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcxyz") for _ in range(rng.randrange(1, 9)))) for i in range(400)] + [(400 + i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "p long, t string")
    got = stats.string_rules(df, "t", "p").collect()
    top = [(r.kind, r.feature) for r in stats.top_features(df, "t").collect()]
    rules = {}
    for kind, f in top:
        for c in range(1, {"byte": 5, "bigram": 2, "trigram": 2}.get(kind, 1) + 1):
            holds = {"prefix": lambda t: t.startswith(f), "suffix": lambda t: t.endswith(f)}.get(kind, lambda t: t.count(f) >= c)
            hit = {i for i, t in rows if t is not None and holds(t)}
            if 0 < len(hit) <= max(0.05 * len(rows), 16):
                rules[{"prefix": "STARTSWITH", "suffix": "ENDSWITH"}.get(kind, "CONTAINS"), f, c] = hit
    want, taken = [], set()
    while rules:
        cost = {r: sum(i - 1 not in h for i in h) * 256 + len(h) + 4 * len(h & taken) for r, h in rules.items()}
        best = min(cost, key=lambda r: (cost[r], r))
        want.append((*best, cost[best]))
        taken |= rules.pop(best)
    assert len(want) > 10 and [(r.op, r.value, r["count"], r.score) for r in got] == want[:128]


def test_threshold_rules_against_plain_loops(spark):
    rng = random.Random(10)
    x = [rng.choice([rng.gauss(0, 10), float(rng.randrange(5)), float("nan")]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(x)), "p long, v double")
    v = [a for a in x if a == a]
    got = stats.threshold_rules(df, "v", "p").collect()
    assert 5 < len(got) <= 32 and len({(r.op, r["rows"]) for r in got}) == len(got)
    for r in got:
        hit = [a < r.threshold if r.op == "<" else a > r.threshold for a in v]
        assert (r["rows"], r.runs) == (sum(hit), sum(b and not a for a, b in zip([False, *hit], hit))) and r.threshold in v
        assert r.score == 24 * r.runs + 64 * r["rows"] and r["rows"] <= max(0.05 * len(v), 16)
    assert [r.score for r in got] == sorted(r.score for r in got)


def test_quantiles_against_sorting(spark):
    rng = random.Random(12)
    for values in ([rng.gauss(0, 1) for _ in range(3001)], [float(rng.randrange(4)) for _ in range(500)], [7.0], []):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        at = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
        got = {r.p: r.value for r in stats.quantiles(df, "v", at).collect()}
        order = sorted(values)
        assert got == {p: order[max(-(-int(p * 1000) * len(order) // 1000), 1) - 1] if order else None for p in at}
