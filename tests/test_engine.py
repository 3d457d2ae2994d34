"""Statements, storage, pruning and the operators beside SQL, on small fixtures."""

import datetime as dt
import json
import random

import numpy as np
import pytest

from tesserae.errors import ConflictError, EngineError
from tesserae.operators import maintenance
from tesserae.operators.graph import ContextStore, Graph, snippet
from tesserae.operators.vector import VectorRegistry, trigram
from tesserae.plans import dialect
from tesserae.plans.fanout import FanOut
from tesserae.plans.predicate import And, Compare, Or, fnv1a, may_match, read, shard
from tesserae.sources.catalog import Store, Table, parse_create
from tesserae.sources.parts import CHECKPOINT, Bloom, Part, Stats, commit, parts_of, snapshot, sweep
from tesserae.types import TypeSpec


def test_types_round_trip():
    for text, name in (("bigint", "Int64"), ("DateTime64(6)", "TimestampUs"), ("decimal(10, 2)", "Decimal(10,2)"), ("array(map(string,int))", "Array(Map(Utf8,Int32))"), ("uint64", "UInt64")):
        assert str(TypeSpec.parse(text)) == name
        assert TypeSpec.parse(name).spark == TypeSpec.parse(text).spark
    for bad in ("struct(a int)", "decimal(39,0)", "decimal(3,4)", "json"):
        with pytest.raises(EngineError):
            TypeSpec.parse(bad)


def test_ddl_round_trip_and_rules():
    table, absent = parse_create("CREATE TABLE IF NOT EXISTS e(id Int64 NOT NULL, ts DateTime, tags Array(String)) ORDER BY (id, ts) ENGINE = local UNIQUE (id) TTL ts INTERVAL 3 DAYS COMPRESSION = lz4")
    assert absent and table.unique == ["id"] and table.ttl == ("ts", 3 * 86_400) and not table.columns[0].nullable
    assert Table.from_json(table.to_json()) == table
    again, _ = parse_create(table.to_ddl())
    assert (again.columns, again.sort_key, again.ttl, again.compression) == (table.columns, table.sort_key, table.ttl, "lz4")
    for bad in ("(a Int64) UNIQUE (a)", "(a Int64, b Int64) ORDER BY (a, b) UNIQUE (b)", "(a Int64) ORDER BY x", "(a Int64, a Int64)", "(a Int64) TTL a INTERVAL 1 DAY", "(a TimestampUs) TTL a INTERVAL 1 DAY"):
        with pytest.raises(EngineError):
            parse_create(f"CREATE TABLE t {bad}")


def test_statements(session, rows):
    sql = lambda q: rows(session.sql(q))
    assert sql("CREATE TABLE t (id Int64, name String, v Float64) ORDER BY id") == [("created table 't'",)]
    assert sql("CREATE TABLE IF NOT EXISTS t (id Int64)") == [("table 't' is there, nothing to do",)]
    assert sql("INSERT INTO t VALUES (2, 'b', 2.0), (1, 'a', 1.0)") == [(2,)]
    assert sql("INSERT INTO t (id, name) VALUES (3, NULL)") == [(1,)]
    assert sorted(sql("SELECT * FROM t")) == [(1, "a", 1.0), (2, "b", 2.0), (3, None, None)]
    assert sql("UPDATE t SET v = v + 1, name = 'z' WHERE v > 1") == [(1,)]
    assert sorted(sql("SELECT id, name, v FROM t")) == [(1, "a", 1.0), (2, "z", 3.0), (3, None, None)]
    assert sql("DELETE FROM t WHERE v < 2") == [(1,)]  # the null stays
    assert sorted(sql("SELECT id FROM t")) == [(2,), (3,)]
    assert sql("ALTER TABLE t ADD COLUMN w Int32") == [("added column 'w' to 't' (4 columns)",)]
    assert sorted(sql("SELECT id, w FROM t")) == [(2, 0), (3, 0)]
    assert sql("ALTER TABLE t DROP COLUMN name") == [("dropped column 'name' from 't' (3 columns)",)]
    with pytest.raises(EngineError):
        session.sql("ALTER TABLE t DROP COLUMN id")
    assert sql("CREATE TABLE c AS SELECT id, v * 2 AS d FROM t WHERE v IS NOT NULL") == [("created table 'c' with 1 rows",)]
    assert sql("SHOW TABLES LIKE 'c%'") == [("c",)] and sql("SHOW DATABASES") == [("default",)]
    assert sql("DESCRIBE c") == [("id", "Int64", True, True), ("d", "Float64", True, False)]
    assert "t: 2 of 2 parts" in sql("EXPLAIN SELECT * FROM t")[0][0] and "t: 0 of 2 parts" in sql("EXPLAIN SELECT * FROM t WHERE id > 77")[0][0]
    assert sql("SELECT table_name FROM information_schema.tables ORDER BY table_name") == [("c",), ("t",)]
    assert sql("TRUNCATE TABLE t") == [("truncated 't'",)] and sql("SELECT count(*) AS n FROM t") == [(0,)]
    assert sql("DROP TABLE t") == [("dropped table 't'",)] and sql("DROP TABLE IF EXISTS t") == [("no table 't', nothing to do",)]
    for bad in ("BEGIN", "CREATE VIEW v AS SELECT 1", "ATTACH 'x'", "ALTER TABLE c RENAME COLUMN d TO e", "USE other", "SHOW TABLES FROM other"):
        with pytest.raises(EngineError):
            session.sql(bad)
    assert session.metrics["errors"] == 7 and len(session.audit) == session.metrics["queries"] == len(session.audited())
    assert [x["sql"] for x in session.audited(session.audit[-2]["at"])] == ["USE other", "SHOW TABLES FROM other"] and session.audited(session.audit[-1]["at"] + 1) == []


def test_unique_keeps_the_last_and_optimize_merges(session, rows):
    session.sql("CREATE TABLE e (id Int64, kind String) ORDER BY (kind, id) UNIQUE (kind)")
    session.sql("INSERT INTO e VALUES (1, 'a'), (3, 'a'), (2, 'b'), (2, 'a')")
    assert sorted(rows(session.sql("SELECT id, kind FROM e"))) == [(2, "b"), (3, "a")]
    session.sql("INSERT INTO e VALUES (9, 'a')")
    assert len(rows(session.sql("SELECT * FROM e"))) == 3  # seen until OPTIMIZE
    session.sql("OPTIMIZE TABLE e")
    assert sorted(rows(session.sql("SELECT id, kind FROM e"))) == [(2, "b"), (9, "a")]
    assert session.stats("e")["parts"] == 1


def test_ttl(session, rows):
    session.sql("CREATE TABLE k (id Int64, ts TimestampMs) ORDER BY id TTL ts INTERVAL 1 DAY")
    session.sql("INSERT INTO k SELECT 1, timestamp_ntz'2001-01-01 00:00:00' UNION ALL SELECT 2, NULL UNION ALL SELECT 3, timestamp_ntz'2999-01-01 00:00:00' UNION ALL SELECT 4, timestamp_ntz'1960-01-01 00:00:00'")
    assert sorted(rows(session.sql("SELECT id FROM k"))) == [(2,), (3,)]


def test_unique_keeps_the_newest_of_equal_keys(session, rows):
    """Two old rows, then a larger insert with the same full keys: the newer ones stay, whatever merges and however often."""
    session.sql("CREATE TABLE e (id Int64, v String) ORDER BY (id) UNIQUE (id)")
    session.sql("INSERT INTO e VALUES (1, 'old'), (2, 'old')")
    session.sql("INSERT INTO e SELECT id, 'new' FROM range(1, 400)")
    session.sql("OPTIMIZE TABLE e")
    assert rows(session.sql("SELECT count(*) AS n FROM e")) == [(399,)] and rows(session.sql("SELECT v FROM e WHERE id < 3")) == [("new",)] * 2
    for k in range(8):  # the eighth part merges by itself
        session.sql(f"INSERT INTO e VALUES (1, 'v{k}'), ({1000 + k}, 'x')")
        if k == 3:
            session.sql("UPDATE e SET v = 'changed' WHERE id = 2")  # a rewritten part keeps its place
    session.sql("OPTIMIZE TABLE e")
    assert rows(session.sql("SELECT v FROM e WHERE id = 1")) == [("v7",)] and rows(session.sql("SELECT v FROM e WHERE id = 2")) == [("changed",)]
    session.sql("INSERT INTO e VALUES (5, 'a'), (5, 'b')")
    assert rows(session.sql("SELECT v FROM e WHERE id = 5 AND v < 'new'")) == [("b",)]
    p = lambda n, k: Part(f"p{k}", "", n, 0, 0, {}, k)
    assert [x.seq for x in maintenance.adjacent([p(900, 1), p(10, 2), p(500, 3), p(20, 4), p(30, 5)], 1000)] == [4, 5] and maintenance.adjacent([p(900, 1), p(200, 2)], 1000) == []


def test_torn_and_corrupt_parts(session, rows):
    session.sql("CREATE TABLE t (id Int64) ORDER BY id")
    session.sql("INSERT INTO t VALUES (1)")
    torn = maintenance.write_part(session.spark, session.store, session.catalog.get("t"), session.spark.sql("select 2L as id"))
    assert rows(session.sql("SELECT id FROM t")) == [(1,)]
    assert sweep(session.store, "t") == 0 and sweep(session.store, "t", -1) == 1 and torn.name not in session.store.list("parts/t")
    session.sql("INSERT INTO t VALUES (3)")
    session.store.put("log/t/000000000002.json", b"{")
    with pytest.raises(EngineError, match="corrupt"):
        session.sql("SELECT id FROM t")


def test_log(session, rows):
    """Versions, checkpoints, conflicts, and readers that know an older version or another table of the name."""
    from tesserae.session import Session
    from tesserae.sources import parts

    session.sql("CREATE TABLE t (id Int64) ORDER BY id")
    session.sql("INSERT INTO t VALUES (1)")
    other = Session(session.spark, session.store.root)
    first = parts_of(session.store, "t")[0]
    for k in range(CHECKPOINT + 3):
        commit(session.store, "t", [Part(f"x{k}", "", 0, 0, 0, {})])
    assert snapshot(session.store, "t").version == CHECKPOINT + 4 and f"{CHECKPOINT:012d}.all.json" in session.store.list("log/t")
    parts._KNOWN.clear()
    assert [p.name for p in parts_of(other.store, "t")] == [first.name, *(f"x{k}" for k in range(CHECKPOINT + 3))]
    commit(session.store, "t", [], [p for p in parts_of(session.store, "t") if p.name != first.name])
    with pytest.raises(ConflictError):
        commit(session.store, "t", [], [Part("x0", "", 0, 0, 0, {})])
    assert commit(session.store, "t", [], mark="m") and not commit(session.store, "t", [], mark="m")
    assert rows(other.sql("SELECT id FROM t")) == [(1,)]
    session.sql("DROP TABLE t")
    session.sql("CREATE TABLE t (id Int64) ORDER BY id")
    session.sql("INSERT INTO t VALUES (7)")
    assert rows(other.sql("SELECT id FROM t")) == [(7,)]


def test_a_rewrite_is_seen_whole_or_not_at_all(session, rows, monkeypatch):
    session.sql("CREATE TABLE t (id Int64, v Int64) ORDER BY id")
    for k in range(3):
        session.sql(f"INSERT INTO t VALUES ({k}, 1), ({k + 10}, 1)")
    write = maintenance.write_part
    calls = []

    def failing(*a, **b):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return write(*a, **b)

    before = session.sql("SELECT id, v FROM t")
    monkeypatch.setattr(maintenance, "write_part", failing)
    with pytest.raises(RuntimeError):
        session.sql("UPDATE t SET v = 2")
    assert rows(session.sql("SELECT DISTINCT v FROM t")) == [(1,)] and rows(session.sql("SELECT count(*) AS n FROM t")) == [(6,)]
    monkeypatch.undo()
    assert rows(session.sql("UPDATE t SET v = 2")) == [(6,)] and rows(session.sql("SELECT DISTINCT v FROM t")) == [(2,)]
    assert sorted(rows(before)) == [(k, 1) for k in (0, 1, 2, 10, 11, 12)]  # a query that began before still reads what it saw


@pytest.mark.parametrize(("kind", "values"), [("Int32", [1, -5, 0]), ("Float64", [0.0, -0.0, 2.5]), ("String", ["", "é", "x" * 50]), ("Bool", [True, False]), ("Date32", [dt.date(1999, 2, 3)]), ("TimestampUs", [dt.datetime(2020, 1, 2, 3, 4, 5, 600), dt.datetime(2020, 1, 2)])])
def test_bloom_filters_miss_nothing(session, kind, values):
    session.sql(f"CREATE TABLE b (k {kind}) ORDER BY k UNIQUE (k)")
    t = session.catalog.get("b")
    session.insert("b", session.spark.createDataFrame([(v,) for v in values] + [(None,)], t.schema))
    fresh = parts_of(Store(session.store.root), "b")[0]
    stored = Part.from_json(session.store, "b", fresh.to_json()).columns["k"].bloom
    assert all(v in stored for v in values) and isinstance(stored, Bloom)
    assert kind == "Bool" or sum(v in stored for v in {"Int32": range(100, 200), "Float64": [k + 0.5 for k in range(100, 200)], "String": map(str, range(100))}.get(kind, [])) < 10


def test_claims_conflict(session):
    session.sql("CREATE TABLE t (id Int64) ORDER BY id")
    session.sql("INSERT INTO t VALUES (1), (2)")
    name = parts_of(session.store, "t")[0].name
    assert session.store.claim(f"merge-claims/t/{name}")
    with pytest.raises(ConflictError):
        session.sql("DELETE FROM t WHERE id = 1")


def test_pruning_reads_few_parts(session, rows):
    session.sql("CREATE TABLE t (id Int64, v Float64) ORDER BY id UNIQUE (id)")
    for k in range(4):
        session.sql(f"INSERT INTO t VALUES ({10 * k}, {k}.5), ({10 * k + 4}, NULL)")
    assert rows(session.sql("SELECT v FROM t WHERE id = 20")) == [(2.5,)] and session.pruned[0].scanned == 1
    assert rows(session.sql("SELECT id FROM t WHERE id = 22")) == [] and session.pruned[0].scanned == 0  # bloom
    assert len(rows(session.sql("SELECT id FROM t WHERE id BETWEEN 10 AND 24 AND v IS NULL"))) == 2 and session.pruned[0].scanned == 2
    assert len(rows(session.sql("SELECT id FROM t WHERE id > 30 OR v < 1"))) == 2
    assert rows(session.sql("SELECT count(*) AS n, min(id) AS a, max(id) AS b FROM t")) == [(8, 0, 34)] and session.pruned[0].scanned == 0
    found = [rows(session.sql(f"SELECT id FROM t WHERE tesserae_shard(id, {i}, 3)")) for i in range(3)]
    assert sorted(x for f in found for (x,) in f) == [0, 4, 10, 14, 20, 24, 30, 34]


def test_pruning_is_sound():
    """Random parts and predicates: a part with a matching row is never left out."""
    r = random.Random(5)
    values = {"i": lambda: r.choice([None, -2, 0, 1, 3]), "f": lambda: r.choice([None, float("nan"), -0.0, 0.0, 1.5, -3.0]), "s": lambda: r.choice([None, "", "a", "b"])}

    def stats(column):
        known = [v for v in column if v is not None and v == v]
        return Stats(sum(v is None for v in column), min(known, default=None), max(known, default=None), any(v is not None and v != v for v in column))

    def predicate(depth=2):
        if depth and r.random() < 0.5:
            return r.choice([And, Or])((predicate(depth - 1), predicate(depth - 1)))
        c = r.choice("ifs")
        return Compare(c, r.choice(["=", "<", "<=", ">", ">="]), next(v for v in iter(values[c], object()) if v is not None and v == v))

    def holds(p, row):
        if isinstance(p, And):
            return all(holds(x, row) for x in p.items)
        if isinstance(p, Or):
            return any(holds(x, row) for x in p.items)
        v = row[p.column]
        if v is None:
            return False
        if v != v:
            return p.op in (">", ">=")  # NaN is above all
        return {"=": v == p.value, "<": v < p.value, "<=": v <= p.value, ">": v > p.value, ">=": v >= p.value}[p.op]

    for _ in range(3000):
        rows = [{c: fn() for c, fn in values.items()} for _ in range(r.randint(1, 4))]
        part = Part("p", "", len(rows), 0, 0, {c: stats([x[c] for x in rows]) for c in values})
        p = predicate()
        if any(holds(p, x) for x in rows):
            assert may_match(part, p), (rows, p)


def test_predicate_reader():
    assert read("a = 1 AND (b > 'x' OR c <= 2.5)") == And((Compare("a", "=", 1), Or((Compare("b", ">", "x"), Compare("c", "<=", 2.5)))))
    assert read("5 > t.a") == Compare("a", "<", 5)
    assert read("a IN (1, -2) AND f(b) = 3") == Or((Compare("a", "=", 1), Compare("a", "=", -2)))
    assert read("a = 1 OR f(b)") is None and read("NOT a = 1") is None and read("a = b + 1") is None
    assert read("d >= DATE '2020-01-02'") == Compare("d", ">=", dt.date(2020, 1, 2))


def test_dialect(session, rows):
    one = lambda q: rows(session.sql(q))
    assert one("SELECT 10 / 4 AS a, 10.0 / 4 AS b, strpos('abc', 'c') AS c, array_length([1, 2]) AS d, MAP {'k': 7}['k'] AS e, lcm(4, 6) AS f")[0] == (2, 2.5, 3, 2, 7, 12)
    assert one("SELECT x FROM (VALUES (3), (1), (2), (NULL)) AS t(x) ORDER BY x") == [(1,), (2,), (3,), (None,)]
    assert one("SELECT x FROM (VALUES (3), (NULL), (2)) AS t(x) ORDER BY x DESC") == [(None,), (3,), (2,)]
    assert one("SELECT x FROM (VALUES (3), (1), (2)) AS t(x) QUALIFY row_number() OVER (ORDER BY x DESC) = 1") == [(3,)]
    assert one("SELECT DISTINCT ON (k) k, v FROM (VALUES (1, 5), (1, 7), (2, 6)) AS t(k, v) ORDER BY k, v DESC") == [(1, 7), (2, 6)]
    assert one("SELECT 'ab' ~ '^a' AS m, 'ab' SIMILAR TO 'a%' AS s, '10 / 4 ~' AS lit") == [(True, True, "10 / 4 ~")]
    assert one("SELECT gpu_filtered_sum(x) AS s, gpu_dot(x, y) AS d FROM (VALUES (1, 2), (3, NULL), (4, 5)) AS t(x, y)") == [(8.0, 22.0)]
    assert one("SELECT date_bin(INTERVAL '15 minutes', timestamp_ntz'2024-01-01 10:22:00') AS b") == [(dt.datetime(2024, 1, 1, 10, 15),)]
    t = "(SELECT ARRAY(10, 20, 30) AS a, MAP('k', 7) AS m, 'a.b' AS s, 2 AS two)"
    assert one(f"SELECT a[1], a[-1], a[4], array_element(a, two), m['k'], m['z'], (a)[2] FROM {t}") == [(10, 30, None, 20, 7, None, 20)]
    assert one(f"SELECT array_slice(a, 2, 3), array_slice(a, -2, -1), a[2:2], array_slice(a, 1, 3, 2), string_to_array(s, '.'), string_to_array('a,,b', ',', '') FROM {t}") == [([20, 30], [20, 30], [20], [10, 30], ["a", "b"], ["a", None, "b"])]
    assert one("SELECT trunc(2.7) AS a, trunc(-2.7) AS b, trunc(3.14159, 2) AS c, trunc(DATE '2024-05-06', 'year') AS d") == [(2.0, -2.0, 3.14, dt.date(2024, 1, 1))]
    assert one("SELECT regexp_match('x12y34', '[0-9]+') AS a, regexp_match('x12y34', '([a-z])([0-9]+)') AS b, regexp_match('abc', 'Z') AS c, regexp_match('ABC', 'b', 'i') AS d") == [(["12"], ["x", "12"], None, ["B"])]
    v = "(VALUES (1), (2), (3)) AS v(x)"
    assert one(f"SELECT 3 > ALL (SELECT x FROM {v}), 4 > ALL (SELECT x FROM {v}), 1 < ANY (SELECT x FROM {v}), 2 = ALL (SELECT x FROM {v}), 5 >= ALL (SELECT x FROM {v} WHERE x > 9), 5 > ANY (SELECT x FROM {v} WHERE x > 9)") == [(False, True, True, False, True, False)]
    assert one(f"SELECT 4 > ALL (SELECT nullif(x, 2) FROM {v}), 2 > ALL (SELECT nullif(x, 2) FROM {v}), 0 > ANY (SELECT nullif(x, 2) FROM {v}), 2 <> ALL (SELECT x FROM {v}), x + 1 > SOME (SELECT x FROM {v}) AS s FROM {v} ORDER BY x LIMIT 1") == [(None, False, None, False, True)]
    w = "(VALUES (1, 1), (1, 2), (2, 3), (4, 4)) AS w(k, i)"
    assert one(f"SELECT i, count(*) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM {w} ORDER BY i") == [(1, 2), (2, 2), (3, 3), (4, 2)]
    assert one(f"SELECT sum(i) AS s FROM (SELECT * FROM {w} QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1) q") == [(9,)]
    assert sorted(one(f"WITH a AS (SELECT i FROM {w} QUALIFY rank() OVER (ORDER BY k) = 1) SELECT i FROM a UNION ALL SELECT k FROM {w} QUALIFY row_number() OVER (ORDER BY i DESC) = 1")) == [(1,), (2,), (4,)]
    session.sql("CREATE TABLE d (id Int64, x Float64) ORDER BY id")
    session.sql("INSERT INTO d VALUES (3, 3.0), (4, 4.0)")
    assert one("SELECT (id) / (2) AS a, id * 3 / 2 AS b, x / 2 AS c, id / x AS e, abs(id) / 2 AS f, cast(x AS Int) / 2 AS g FROM d WHERE id = 3") == [(1, 4, 1.5, 1.0, 1, 1)]
    assert one("SELECT sum(id) / count(*) AS m, max(id) / 3 AS n, avg(id) / 2 AS o, sum(id) / 2.0 AS p FROM d") == [(3, 1, 1.75, 3.5)]


def test_views_of_the_caller_stay(spark, session, rows):
    spark.sql("select 5 as x").createOrReplaceTempView("mine")
    session.sql("CREATE TABLE mine (id Int64) ORDER BY id")
    session.sql("INSERT INTO mine VALUES (1)")
    assert rows(session.sql("SELECT id FROM mine")) == [(1,)] and rows(spark.sql("select x from mine")) == [(5,)]


@pytest.mark.parametrize("where", ["", "WHERE v > 5 OR k = 'a'", "WHERE k = 'a or b' OR (v < 3 AND k <> 'x')", "WHERE v BETWEEN 2 AND 8 AND k IN ('a', 'b')"])
def test_fan_out_equals_the_query(session, rows, where):
    from tesserae.plans.fanout import fan_out

    session.sql("CREATE TABLE f (k String, v Int64) ORDER BY k")
    for i in range(5):
        session.sql(f"INSERT INTO f VALUES ('a', {i}), ('b', {2 * i}), ('a or b', {3 * i}), (NULL, {i})")
    q = f"SELECT k, count(*) AS n, sum(v) AS s, min(v) AS low FROM f {where} GROUP BY k"
    assert sorted(rows(fan_out(session, q, 3)), key=str) == sorted(rows(session.sql(q)), key=str)
    marked = "AND tesserae_shard(k, {}, 3)".format if where else "WHERE tesserae_shard(k, {}, 3)".format
    if " OR " not in where:
        assert sum(rows(session.sql(f"SELECT count(*) AS n FROM f {where} {marked(i)}"))[0][0] for i in range(3)) == rows(session.sql(f"SELECT count(*) AS n FROM f {where}"))[0][0]
    else:
        with pytest.raises(EngineError):
            session.sql(f"SELECT count(*) AS n FROM f {where} {marked(0)}")


def test_files(session, rows, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("id,name\n3,z\n")
    assert rows(session.sql(f"SELECT count(*) AS n FROM read_csv('{tmp_path}/a.csv', '{tmp_path}/b.csv')")) == [(3,)]
    for kind in ("parquet", "csv", "json", "arrow"):
        assert rows(session.sql(f"COPY (SELECT 1 AS a, 'b' AS c) TO '{tmp_path}/out.{kind}'")) == [(1,)]
        assert rows(session.sql(f"SELECT a, c FROM read_parquet('{tmp_path}/out.{kind}')")) == [(1, "b")]
    with pytest.raises(EngineError):
        session.sql(f"SELECT * FROM read_csv('{tmp_path}/a.txt')")
    from tesserae.sources import files

    (tmp_path / "l.csv").write_text("name,id,amount,ok\nn,1,2.5,yes\n,x,null,0\n")
    session.sql("CREATE TABLE l (id Int64, name String, amount Float64, ok Bool) ORDER BY id")
    assert rows(files.load(session.spark, f"{tmp_path}/l.csv", session.catalog.get("l"))) == [(1, "n", 2.5, True), (None, None, None, False)]
    df = session.sql("SELECT 1 AS a, NULL AS b")
    assert json.loads(files.encode(df, "json")) == [{"a": 1, "b": None}] and files.encode(df, "csv") == "a,b\n1,\n" and "NULL" in files.encode(df, "box")


def test_merge_policy():
    p = lambda n: Part(str(n), "", n, 0, 0, {})
    assert [x.rows for x in maintenance.pick([p(256)] * 5 + [p(768)], 1000)] == [256] * 3
    assert maintenance.pick([p(900), p(901)], 1000) == [] and [x.rows for x in maintenance.pick([p(5), p(100), p(700)], 1000)] == [5, 100]


def test_fnv_and_shards():
    assert fnv1a("") == 0xCBF29CE484222325 and fnv1a("a") == 0xAF63DC4C8601EC8C
    parts = [Part(f"x{k}", "", 1, 0, 0, {}) for k in range(20)]
    assert sorted(p.name for i in range(3) for p in shard(parts, i, 3)) == sorted(p.name for p in parts)


def test_fanout_rewrites():
    f = FanOut.parse("SELECT k, count(*) AS n, sum(v) AS s FROM t WHERE v > 1 GROUP BY k ORDER BY n DESC LIMIT 3")
    assert f.partial_sql() == "SELECT k AS c0, count(*) AS c1, sum(v) AS c2 FROM t WHERE v > 1 GROUP BY k"
    assert f.final_sql() == "SELECT c0 AS `k`, CAST(sum(c1) AS BIGINT) AS `n`, sum(c2) AS `s` FROM partial GROUP BY c0 ORDER BY `n` DESC NULLS FIRST LIMIT 3"
    for bad in ("SELECT * FROM t", "SELECT avg(v) FROM t", "SELECT count(*) + 1 FROM t", "SELECT k FROM t JOIN u USING (k)", "SELECT DISTINCT k FROM t", "WITH x AS (SELECT 1) SELECT 1 FROM x", "SELECT count(*) FROM t HAVING count(*) > 1", "SELECT k FROM t WHERE k IN (SELECT 1)"):
        with pytest.raises(EngineError):
            FanOut.parse(bad)


def test_vectors(spark, tmp_path, session, rows):
    v = session.vectors
    v.create("docs", 3)
    assert v.add("docs", [[1, 0, 0], [0, 1, 0], [0.9, 0.1, 0]], [{"title": t} for t in "abc"]) == [0, 1, 2]
    assert [r[0] for r in rows(v.search("docs", [1, 0, 0], 2))] == [0, 2]
    assert rows(session.sql("SELECT id, payload FROM vector_search('docs', [1, 0, 0], 2) WHERE payload ILIKE '%c%'")) == [(2, '{"title": "c"}')]
    assert len(rows(v.search("docs", [1, 0, 0], 9))) == 3
    for bad in (lambda: v.create("docs", 3), lambda: v.create("a b", 3), lambda: v.create("z", 0), lambda: v.create("i", 5, "l2", "ivf", m=2), lambda: v.search("docs", [1, 0], 1), lambda: v.search("docs", [1, 0, 0], 0), lambda: v.search("no", [1], 1), lambda: v.add("docs", [[1, 2, 3]], ["a", "b"])):
        with pytest.raises(EngineError):
            bad()
    v.create("none", 2)
    assert rows(v.search("none", [1, 0], 3)) == [] and sorted(v.names()) == ["docs", "none"]
    again = VectorRegistry(spark, session.store)
    assert again.meta("docs")["next"] == 3
    again.drop("none")
    assert again.names() == ["docs"]
    assert len(trigram("abc")) == 128 and abs(np.linalg.norm(trigram("Abc")) - 1) < 1e-9 and trigram("ABC") == trigram("abc")


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_ivf_recall(spark, session, metric):
    rng = np.random.default_rng(42)
    x = (rng.normal(size=(4, 1, 32)) * 3 + rng.normal(size=(4, 300, 32))).reshape(-1, 32)
    v = session.vectors
    v.create("s", 32, metric, "ivf", nlist=16, m=8, niter=5, nbits=6)
    v.create("f", 32, metric)
    for name in ("s", "f"):
        v.add(name, x.tolist())
    assert v.meta("s")["lists"] and not v.meta("f")["lists"]
    hit = 0
    for q in x[::240]:
        exact = {r["id"] for r in v.search("f", q.tolist(), 10).collect()}
        hit += len(exact & {r["id"] for r in v.search("s", q.tolist(), 10, 8).collect()})
    assert hit / (10 * len(x[::240])) >= 0.7
    new = v.add("s", [x[0].tolist()])
    assert new[0] in {r["id"] for r in v.search("s", x[0].tolist(), 5).collect()}  # later vectors are found as well


def people(spark):
    g = Graph(spark)
    for k, age in (("ann", 30), ("bob", 34), ("carl", 41), ("dave", 29)):
        g.upsert_node(k, ["Person"], {"age": age, "name": k.title()})
    for a, b in (("ann", "bob"), ("bob", "carl"), ("ann", "dave")):
        g.upsert_edge(a, b, "KNOWS", {"since": 2000})
    return g


def test_graph(spark, rows):
    g = people(spark)
    assert [(r["key"], r["depth"]) for r in g.neighbors("ann", "out", 2).collect()] == [("bob", 1), ("dave", 1), ("carl", 2)]
    assert [r["key"] for r in g.neighbors("carl", "in", 0).collect()] == ["bob", "ann"]
    assert g.shortest_path("carl", "dave") == ["carl", "bob", "ann", "dave"] and g.shortest_path("ann", "ann") == [] and g.shortest_path("ann", "zed") is None
    with pytest.raises(EngineError):
        g.neighbors("zed")
    with pytest.raises(EngineError):
        g.upsert_edge("ann", "ann", "KNOWS")
    assert rows(g.search("AN")) == [("ann", 4)] and rows(g.search("person", 2)) == [("ann", 2), ("bob", 2)]
    assert g.delete_edges("ann", "dave") == 1 and g.delete_node("bob") and not g.edges


def test_cypher(spark, rows):
    g = people(spark)
    run = lambda q: rows(g.cypher(q))
    assert run("MATCH (a:Person {key: 'ann'})-[:KNOWS]->(b) RETURN b.key AS k ORDER BY k") == [("bob",), ("dave",)]
    assert run("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c) WHERE a.age < 31 AND NOT c.name STARTS WITH 'B' RETURN c.name") == [("Carl",)]
    assert run("MATCH (a {key: 'ann'})-[p:KNOWS*1..3]->(b) RETURN b.key AS k ORDER BY k") == [("bob",), ("carl",), ("dave",)]
    assert run("MATCH (a {key: 'bob'})--(x) RETURN count(*) AS n") == [(2,)]
    assert run("MATCH (a:Nobody) RETURN count(*) AS n") == [(0,)]
    assert run("MATCH (a)-[:KNOWS]->(b) RETURN a.key AS k, count(b) AS n, avg(b.age) AS m ORDER BY n DESC LIMIT 1") == [("ann", 2, 31.5)]
    assert run("MATCH (a)-[r:LIKES]->(b) RETURN r.type") == []
    assert run("MATCH (a {key: 'ann'}), (b {key: 'carl'}) RETURN a.age, b.age") == [("30", "41")]
    assert run("MATCH (a)-[:KNOWS]->(b), (b)-[:KNOWS]->(c) RETURN a.key, c.key") == [("ann", "carl")]
    assert run("MATCH (a)-[:KNOWS]->(b) WHERE b.age IN [34, 29] RETURN DISTINCT a.key") == [("ann",)]
    assert run("CREATE (x:Task {key: 't/1'})-[:DEPENDS_ON]->(y:Task {key: 't/2'})") == [(2, 1)]
    assert run("MATCH (t:Task {key: 't/1'}) SET t.state = 'done'") == [(1,)]
    assert run("MATCH (t:Task) WHERE t.state = 'done' RETURN t.key") == [("t/1",)]
    assert run("MATCH (t:Task {key: 't/2'}) DELETE t") == [(1,)] and not [e for e in g.edges if "t/1" in e]
    for bad in ("MERGE (a)", "MATCH (a) WITH a RETURN a", "MATCH (a) RETURN b", "MATCH (a)-[*1..9]->(b) RETURN b", "MATCH (a)"):
        with pytest.raises(EngineError):
            g.cypher(bad)


def test_context(spark, tmp_path):
    store = Store(str(tmp_path))
    g = Graph(spark, store)
    c = ContextStore(g)
    for k in "abc":
        c.put(k, title=f"note {k}", text=f"text of\n{k}", tags=["x"])
    c.link("a", "b")
    c.link("b", "c")
    assert c.find("note")[0]["key"] == "a" and c.path("a", "c") == ["a", "b", "c"] and c.stats()["edges"] == 2
    g.save()
    assert ContextStore(Graph(spark, store)).get("b")["title"] == "note b"
    assert c.delete("b") and c.stats() == {"notes": 2, "nodes": 2, "edges": 0, "kinds": {"note": 2}}
    assert snippet("x" * 300 + "HIT\n" + "y" * 300, "hit", 20).count("…") == 2


def test_memory(session, rows):
    m = session.memory
    m.create("t", [("id", "Int64"), ("name", "String"), ("score", "Float64")], "id")
    assert m.insert("t", [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]) == 2 and m.insert("t", '{"id": 1, "name": "c", "score": 2.5}\n') == 1
    assert rows(session.sql("SELECT count(*) AS n FROM t")) == [(3,)] and m.get("t", 1) == {"id": 1, "name": "c", "score": 2.5} and m.get("t", 9) is None
    assert m.compact("t") == 1 and sorted(rows(session.sql("SELECT id, name FROM t"))) == [(1, "c"), (2, "b")]
    with pytest.raises(EngineError):
        m.create("u", [("id", "Int64")], "x")


def test_api_roles(spark, tmp_path):
    from tesserae.api import ADMIN, READ, WRITE, connect

    c = connect(str(tmp_path / "wh"), spark)
    c.create_table("CREATE TABLE t (id Int64, v Float64) ORDER BY id")
    assert c.insert_json("t", '[{"id": 1, "v": 0.5}, {"id": 2}]') == 2 and c.sql("SELECT sum(v) AS s FROM t") == [{"s": 0.5}]
    assert c.call("query", {"sql": "SELECT id FROM t ORDER BY id"}) == [{"id": 1}, {"id": 2}]
    for tool, args, role in (("query", {"sql": "DELETE FROM t"}, READ), ("cypher", {"query": "CREATE (a:X {key: 'k'})"}, READ), ("vector_create", {"name": "v", "dim": 2}, WRITE)):
        with pytest.raises(EngineError):
            c.call(tool, args, role)
    c.call("vector_create", {"name": "v", "dim": 2}, ADMIN)
    assert c.call("query", {"sql": "DELETE FROM t WHERE id = 2"}, WRITE) == [{"count": 1}] and c.health()["status"] == "ok"
    assert [r.asDict() for r in c.fan_out("SELECT count(*) AS n, sum(v) AS s FROM t", 2).collect()] == [{"n": 1, "s": 0.5}]


def test_streaming(session, rows, tmp_path):
    from tesserae.streaming.ingest import files, into_table, windowed

    session.spark.sql("select id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as ts from range(10)").write.parquet(f"{tmp_path}/in")
    stream = files(session.spark, f"{tmp_path}/in", "id long, ts timestamp")
    session.sql("CREATE TABLE s (id Int64) ORDER BY id")
    into_table(stream.select("id"), session, "s", f"{tmp_path}/cp").awaitTermination()
    assert rows(session.sql("SELECT count(*) AS n FROM s")) == [(10,)]
    q = windowed(stream, "ts", "5 minutes", "0 seconds", [], {"n": "count(*)"}).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in session.spark.sql("select n from w").collect()) == [5, 5]


def made(df) -> int:
    """The most rows that a step of a finished query made."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        if (found := p.metrics().get("numOutputRows")).isDefined():
            most = max(most, found.get().value())
    return most


def test_cypher_counts_without_pairs(spark, rows):
    """Patterns that meet at a node: the rows of the pairs, but not the pairs, be they asked for by number or by what one side has."""
    rng = random.Random(5)
    kinds = {"a": ("A", 60), "b": ("B", 70), "h": ("H", 3)}
    props = {f"{k}{i}": {"v": rng.choice(["1", "2", "3.5", "x"]), **({"w": str(i % 4)} if i % 3 else {})} for k, (_, n) in kinds.items() for i in range(n)}
    nodes = [(x, [kinds[x[0]][0]], p) for x, p in props.items()]
    nodes.append(("a0", ["A"], {"v": "3.5"}))  # a key that two rows have
    edges = [(x, f"h{rng.randrange(3)}", kinds[x[0]][0], {}) for x in props if x[0] != "h" for _ in range(rng.randrange(1, 3))]
    g = Graph.from_frames(spark.createDataFrame(nodes, "key string, labels array<string>, props map<string,string>"), spark.createDataFrame(edges, "src string, dst string, kind string, props map<string,string>"))
    both = [(a[2], b[2], props[h]) for s, h, _, _ in edges for a in nodes if a[0] == s and a[1] == ["A"] for t, k, _, _ in edges if k == h for b in nodes if b[0] == t and b[1] == ["B"]]
    number = lambda x: float(x) if x not in (None, "x") else None
    meet = "MATCH (a:A)-[:A]->(h:H), (b:B)-[:B]->(h)"

    def told(cypher: str) -> list:
        df = g.cypher(cypher)
        got = rows(df)
        assert made(df) < len(both) / 4
        return sorted(got, key=str)

    def grouped(key, fold) -> list:
        return sorted(((k, *fold([x for x in both if key(x) == k])) for k in {key(x) for x in both}), key=str)

    assert told(f"{meet} RETURN count(*) AS n") == [(len(both),)]
    assert told(f"{meet} RETURN h.v AS v, count(*) AS n") == grouped(lambda x: x[2]["v"], lambda g: [len(g)])
    assert told(f"{meet} RETURN a.w AS w, count(a.w) AS n, count(a) AS m, count(DISTINCT h.key) AS d, max(a.v) AS top") == grouped(
        lambda x: x[0].get("w"), lambda g: [sum("w" in x[0] for x in g), len(g), 3, "3.5"])
    values = [number(x[0]["v"]) for x in both if number(x[0]["v"]) is not None]
    [(total, mean)] = told(f"{meet} RETURN sum(a.v) AS s, avg(a.v) AS m")
    assert total == pytest.approx(sum(values)) and mean == pytest.approx(sum(values) / len(values))
    assert told(f"{meet} WHERE b.v = 2 AND a.w <> '1' RETURN count(*) AS n") == [(sum(x[1]["v"] == "2" and x[0].get("w") not in (None, "1") for x in both),)]
    assert told(f"{meet} WHERE a.v = 77 RETURN count(*) AS n, sum(a.v) AS s, avg(a.v) AS m") == [(0, 0.0, None)]
    assert told(f"{meet} WHERE a.v = 77 RETURN h.key AS k, count(*) AS n") == []
    assert told("MATCH (a:A), (b:B) RETURN count(*) AS n") == [(61 * 70,)] and told("MATCH (a:A), (b:Nobody) RETURN count(*) AS n") == [(0,)]
    collected = rows(g.cypher(f"{meet} RETURN h.key AS k, collect(a.v) AS vs"))
    assert sorted(v for _, vs in collected for v in vs) == sorted(x[0]["v"] for x in both)
    pairs = sum(x[0]["v"] == x[1]["v"] for x in both)
    assert rows(g.cypher(f"{meet} WHERE a.v = b.v RETURN count(*) AS n")) == [(pairs,)]
    ends = [{(i, e[1]) for e in edges for i, x in enumerate(nodes) if x[0] == e[0] and x[1] == [k]} for k in "AB"]
    assert told("MATCH (a:A)-[*1..1]->(h:H), (b:B)-[*1..1]->(h) RETURN count(*) AS n") == [(sum(h == k for _, h in ends[0] for _, k in ends[1]),)]


def test_distinct_apart_from_large_aggregates(session, rows):
    """Beside count(DISTINCT x), percentiles are not kept for each x; results and names stay."""
    session.sql("CREATE TABLE t (k Int64, v Float64) ORDER BY k")
    session.insert("t", session.spark.createDataFrame([(i % 7 if i % 5 else None, float(i)) for i in range(101)], "k bigint, v double"))
    got = session.sql("SELECT percentile(v, 0.5) / count(DISTINCT k) AS a, count( distinct k, v ) + 1 AS b, approx_count_distinct(k) AS c, count(DISTINCT k) FROM t WHERE v >= 1")
    assert rows(got) == [(50.5 / 7, 81, 7, 7)] and got.columns == ["a", "b", "c", "count(DISTINCT k)"]
    got = session.sql("SELECT percentile(v, 0.5) AS a, count(DISTINCT k) AS n FROM t WHERE v >= 1")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert rows(got) == [(50.5, 7)] and "partial_percentile" in plan and "merge_percentile" not in plan
    assert rows(session.sql("SELECT percentile(v, 0.5) AS a, count(DISTINCT k) AS n FROM t WHERE v < 0")) == [(None, 0)]
    for same in ("SELECT count(DISTINCT k) AS n FROM t", "SELECT k, median(v) AS m, count(DISTINCT v) AS n FROM t GROUP BY k"):
        assert dialect.rewrite(same) == same
