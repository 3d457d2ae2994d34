"""Every query with an oracle gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from tesserae.plans import engine_queries, relational

DIR = "/root/testdata/sf0.001"
if not Path(DIR).exists():
    pytest.skip("no test data", allow_module_level=True)
QUERIES = relational.queries() | engine_queries.queries()
ORACLES = relational.oracle_sql() | engine_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in relational.TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v


def ordered(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = ordered(QUERIES[name](spark, DIR).toArrow())
    if name in ORACLES:
        assert got == ordered(duck.sql(ORACLES[name]).to_arrow_table())
    else:
        assert got[1]


@pytest.mark.parametrize("name, table", [("sort_nulls", "events"), ("join_lateral", "customer"), ("int_div_dialect", "orders"), ("null_order_dialect", "events")])
def test_whole_tables(spark, duck, name, table):
    """A row for every row of the table, not for a prefix of its ids."""
    whole = DIR.replace("sf0.001", "sf0.01")
    assert QUERIES[name](spark, whole).count() == duck.sql(f"select count(*) from '{whole}/{table}.parquet'").fetchall()[0][0]


def test_null_order_of_all_events(spark, duck):
    got = [tuple(r) for r in QUERIES["null_order_dialect"](spark, DIR).collect()]
    assert len(got) > 50 and got == duck.sql(ORACLES["null_order_dialect"]).fetchall()


@pytest.mark.parametrize("customers", [[(1, 19)], [(1, 4)], [(1, 2)], [(1, 2), (9, 2), (9, 4)], [(1, 2), (8, 2), (8, 3), (9, 3), (9, 4)], [(2, 19)], [(1, 77)], []], ids=str)
def test_shortest_path_as_far_as_its_sql(spark, tmp_path, customers):
    """Paths of 3 hops, 1, none, 3 by customers, 5, which is beyond what SQL takes, and from a start without an edge that leads on, or without a row."""
    con, name = duckdb.connect(), "graph_shortest_path"
    for t in ("region", "nation", "customer", "supplier"):
        given = con.sql(f"select * from '{DIR}/{t}.parquet'")
        if t == "customer":
            own = ", ".join(map(str, customers)) or "(0, 0)"
            given = con.sql(f"select k as c_custkey, t.* exclude (c_custkey, c_nationkey), cast(n as int) as c_nationkey from given t, (values {own}) v(k, n) where t.c_custkey = 0 and {bool(customers)}")
        given.write_parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert ordered(QUERIES[name](spark, str(tmp_path)).toArrow()) == ordered(con.sql(ORACLES[name]).to_arrow_table())
