"""Statements end to end, over small tables."""

from __future__ import annotations

import math

import pytest

from relspark import BindError, Engine

USERS = (("id", "INT"), ("age", "INT"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filter_and_project(load):
    e = load("users", USERS, [(1, 42), (2, 18)])
    assert rows(e.sql("SELECT id FROM users WHERE age > 20")) == [(1,)]


def test_literals_make_bigint(load):
    df = load("users", USERS, [(1, 20), (2, 30), (3, 40)]).sql("SELECT id + 100 AS new_id, age * 2 AS double_age FROM users")
    assert df.dtypes == [("new_id", "bigint"), ("double_age", "bigint")]
    assert rows(df) == [(101, 40), (102, 60), (103, 80)]


def test_float_is_32_bits(load):
    df = load("data", (("id", "INT"), ("value", "FLOAT")), [(1, 10.5), (2, 20.3)]).sql("SELECT id, value + 5, id * value AS product FROM data")
    assert df.dtypes == [("id", "int"), ("expr1", "float"), ("product", "float")]
    assert [r[1] for r in rows(df)] == pytest.approx([15.5, 25.3], abs=1e-5)


JOINED = "SELECT u.name, o.amount FROM users u, orders o WHERE u.id = o.user_id"


@pytest.fixture
def shop(load):
    load("users", (("id", "INT"), ("name", "STRING")), [(1, "Alice"), (2, "Bob"), (3, "Charlie"), (9, "Nobody")])
    return load("orders", (("id", "INT"), ("user_id", "BIGINT"), ("amount", "INT")), [(100, 7, 1), (101, 1, 50), (102, 2, 30), (103, 1, 20), (104, 3, 100)])


@pytest.mark.parametrize("strategy", [None, "nested_loop", "hash", "sort_merge", "broadcast"])
def test_join_strategies_agree(shop, strategy):
    """Non-matching rows on both sides, repeated keys, INT = BIGINT."""
    assert rows(shop.sql(JOINED, strategy)) == [("Alice", 20), ("Alice", 50), ("Bob", 30), ("Charlie", 100)]


@pytest.mark.parametrize(("strategy", "node"), [("hash", "ShuffledHashJoin"), ("sort_merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin"), ("nested_loop", "CartesianProduct")])
def test_strategy_reaches_the_plan(shop, strategy, node):
    assert node in shop.explain(JOINED, strategy)


def test_large_sides_are_not_broadcast(shop, monkeypatch):
    from relspark.operators import relational

    monkeypatch.setattr(relational, "BROADCAST_BYTES", 1)
    shop.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" not in shop.explain(JOINED, "broadcast")
    finally:
        shop.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_demonstration(spark, capsys, tmp_path):
    from relspark.__main__ import main

    main([str(tmp_path)])
    assert "Alan" in capsys.readouterr().out
    main([str(tmp_path), "SELECT COUNT(*) AS n FROM users"])
    assert "| 2|" in capsys.readouterr().out.replace("|  2|", "| 2|")


def test_join_with_filters_and_self_join(shop):
    assert rows(shop.sql(JOINED + " AND u.id > 1 AND o.amount >= 100")) == [("Charlie", 100)]
    assert rows(shop.sql("SELECT a.id, b.id AS other FROM orders a, orders b WHERE a.user_id = b.user_id AND a.id < b.id")) == [(101, 103)]
    assert shop.sql("SELECT * FROM users, orders").columns == ["users.id", "users.name", "orders.id", "orders.user_id", "orders.amount"]
    assert shop.sql("SELECT * FROM users, orders").count() == 20


def test_aggregates(load):
    e = load("m", (("category", "STRING"), ("value", "FLOAT"), ("n", "INT")), [("A", 10.5, 1), ("A", 20.3, 2), ("B", 5.7, 3), ("B", 8.2, 4), ("B", 12.1, 5)])
    df = e.sql("SELECT category, COUNT(*), SUM(value), AVG(value), MIN(value), MAX(value), SUM(n) AS s, AVG(n) AS a FROM m GROUP BY category")
    assert df.dtypes == [("category", "string"), ("count_*", "bigint"), ("sum", "float"), ("avg", "float"), ("min", "float"), ("max", "float"), ("s", "bigint"), ("a", "float")]
    a, b = rows(df)
    assert a[1:] == pytest.approx((2, 30.8, 15.4, 10.5, 20.3, 3, 1.5), abs=0.01)
    assert b[1:] == pytest.approx((3, 26.0, 8.67, 5.7, 12.1, 12, 4.0), abs=0.01)


def test_grouping_forms(load):
    e = load("t", (("a", "INT"), ("b", "INT")), [(1, 1), (1, 2), (2, 1)])
    assert rows(e.sql("SELECT a + b, COUNT(*) FROM t GROUP BY a + b")) == [(2, 1), (3, 2)]
    assert rows(e.sql("SELECT a FROM t GROUP BY a")) == [(1,), (2,)]
    assert rows(e.sql("SELECT a * 10 AS x, SUM(b) FROM t GROUP BY a")) == [(10, 3), (20, 1)]
    assert rows(e.sql("SELECT COUNT(*) FROM t GROUP BY 1")) == [(3,)]
    assert rows(e.sql("SELECT COUNT(*), SUM(a) FROM t WHERE a > 5")) == [(0, None)]
    assert rows(e.sql("SELECT a, COUNT(*) FROM t WHERE a > 5 GROUP BY a")) == []


def test_division(load):
    e = load("t", (("x", "INT"), ("f", "FLOAT"), ("z", "FLOAT")), [(7, 7.0, 0.0)])
    (row,) = rows(e.sql("SELECT x / 2 AS a, (0 - x) / 2 AS b, f / 2 AS c, f / z AS d, (0 - f) / z AS e, z / z AS g, 2147483647 + 1 AS h FROM t"))
    assert row[:5] == (3, -3, 3.5, math.inf, -math.inf)
    assert math.isnan(row[5])
    assert row[6] == 2147483648
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        e.sql("SELECT x / (x - 7) AS q FROM t").collect()


def test_comparisons(load):
    e = load("t", (("big", "BIGINT"), ("f", "FLOAT"), ("b", "BOOLEAN"), ("s", "STRING")), [(16777217, 16777216.0, True, "true")])
    assert e.sql("SELECT s FROM t WHERE big = f").count() == 1  # both as 32-bit floats
    assert e.sql("SELECT s FROM t WHERE b = s").count() == 1  # as text
    assert e.sql("SELECT s FROM t WHERE b > FALSE AND s >= 'true'").count() == 1


def test_output_names(load):
    load("u", (("id", "INT"), ("n", "STRING")))
    e = load("v", (("ID", "INT"),))
    names = lambda q: e.sql(q).columns
    assert names("SELECT u.id, v.id, v.id FROM u, v") == ["id", "v.ID", "v.ID_1"]
    assert names("SELECT id, id + 1, 2, id * 3 AS id FROM u") == ["id", "expr1", "expr2", "id_1"]
    assert names("SELECT U.ID x, N FROM u") == ["x", "N"]
    assert names("SELECT * FROM u WHERE id = 1") == ["id", "n"]
    assert names("SELECT SUM(id), SUM(id) FROM u") == ["sum", "sum_1"]


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("SELECT x FROM nowhere", "Unknown table: nowhere at 1:15"),
        ("SELECT zz FROM u", "Unknown column: zz at 1:8"),
        ("SELECT w.id FROM u", "No table in FROM is called w"),
        ("SELECT u.id FROM u a", "No table in FROM is called u"),
        ("SELECT id FROM u, v", "Ambiguous column: id at 1:8"),
        ("SELECT a.id FROM u a, v a", "FROM has two tables called a"),
        ("SELECT * FROM u GROUP BY id", r"Groups have no \*"),
        ("SELECT id, n FROM u GROUP BY id", "A group doesn't determine this value"),
        ("SELECT SUM(id) + 1 FROM u", "Aggregate not allowed here"),
        ("SELECT id FROM u WHERE COUNT(*) > 1", "Aggregate not allowed here"),
        ("SELECT upper(n) FROM u", "Unknown function: upper"),
        ("SELECT MEDIAN(id) FROM u GROUP BY id", "No such aggregate: MEDIAN"),
        ("SELECT SUM(*) FROM u", "An aggregate takes one argument"),
        ("SELECT COUNT() FROM u", "An aggregate takes one argument"),
        ("SELECT SUM(n) FROM u", "SUM wants a number"),
        ("SELECT n + 1 FROM u", "Arithmetic wants numbers, not STRING and BIGINT"),
        ("SELECT id FROM u WHERE id = 'x'", "Can't compare INT with STRING"),
        ("SELECT id FROM u WHERE id", "WHERE wants BOOLEAN"),
        ("SELECT id AND TRUE AS x FROM u", "AND wants BOOLEAN"),
        ("SELECT id AS k, COUNT(*) FROM u GROUP BY k", "Unknown column: k"),
        ("INSERT INTO u VALUES (1)", "A row has 1 values for 2 columns"),
        ("INSERT INTO u (id) VALUES (1)", "INSERT leaves out n"),
        ("INSERT INTO u (id, id) VALUES (1, 2)", "INSERT names a column twice"),
        ("INSERT INTO u (id, zz) VALUES (1, 2)", "Unknown column: zz"),
        ("INSERT INTO u VALUES ('x', 'y')", "id expects INT"),
        ("INSERT INTO u VALUES (3000000000, 'y')", "id out of range for INT"),
        ("INSERT INTO u VALUES (id, 'y')", "Unknown column: id"),
        ("CREATE TABLE u (x INT)", "Table already exists: u"),
        ("CREATE TABLE w (x INT, X INT)", "Duplicate column: X"),
        ("DROP TABLE w", "Unknown table: w"),
    ],
)
def test_bind_errors(load, query, message):
    load("u", (("id", "INT"), ("n", "STRING")))
    e = load("v", (("id", "INT"),))
    with pytest.raises(BindError, match=message):
        e.validate(query) if query.startswith("DROP") else e.sql(query)
    assert e.sql("SELECT * FROM u").count() == 0


def test_insert(engine):
    engine.sql("CREATE TABLE data (x INT, y INT, label STRING, v VARCHAR(3), f FLOAT)")
    done = engine.sql("INSERT INTO data VALUES (10 + 5, 20 * 2, 'First', 'abc', 2), (100 - 50, 8 / 2, 'it''s', '', 1 / 2)")
    assert done.dtypes == [("inserted_count", "int")]
    assert rows(done) == [(2,)]
    assert rows(engine.sql("SELECT * FROM data")) == [(15, 40, "First", "abc", 2.0), (50, 4, "it's", "", 0.0)]
    engine.sql("INSERT INTO data (f, v, label, y, x) VALUES (7, 'z', 'l', 2, 1)")
    assert engine.sql("SELECT x FROM data WHERE f = 7").count() == 1
    with pytest.raises(BindError, match=r"v exceeds VARCHAR\(3\)"):
        engine.sql("INSERT INTO data VALUES (1, 1, 'ok', 'fine', 1), (1, 1, '', 'toolong', 1)")
    assert engine.sql("SELECT * FROM data").count() == 3  # all or nothing


def test_validate_gives_types(load):
    e = load("u", (("id", "INT"), ("n", "VARCHAR", 5)))
    assert e.validate("SELECT id, id + 1, n, id = 1 AS b, COUNT(*) FROM u GROUP BY id, n") == [("id", "INT"), ("expr1", "BIGINT"), ("n", "VARCHAR"), ("b", "BOOLEAN"), ("count_*", "BIGINT")]
    assert e.validate("INSERT INTO u VALUES (1, 'a')") == [("inserted_count", "INT")]
    assert e.sql("SELECT * FROM u").count() == 0


def test_catalyst_pushes_down_and_prunes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    for name in ("orders", "customer", "lineitem"):
        e.register_parquet(name, f"/root/testdata/sf0.001/{name}.parquet")
    plan = e.explain("SELECT c.c_name FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' AND c.c_acctbal > 10")
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "EqualTo(o_orderstatus,F)" in physical
    assert "GreaterThan(c_acctbal,10.0)" in physical
    assert "o_totalprice" not in physical
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in physical
    grouped = e.explain("SELECT l_returnflag, SUM(l_quantity) FROM lineitem GROUP BY l_returnflag")
    assert "partial_sum" in grouped
    assert "Python" not in grouped


def test_statistics(load):
    found = load("t", (("a", "INT"), ("s", "STRING")), [(1, "x"), (2, "y"), (2, "z")]).statistics("t")
    assert found.rows == 3
    assert (found.columns["a"].distinct, found.columns["a"].least, found.columns["a"].most) == (2, 1, 2)


@pytest.mark.parametrize(
    ("query", "plan"),
    [
        ("SELECT id, n FROM u WHERE id >= 10", "Project[id, n](Filter[(id >= 10)](Scan u))"),
        ("SELECT * FROM u", "Scan u"),
        ("SELECT * FROM u WHERE TRUE", "Filter[TRUE](Scan u)"),
        ("SELECT x.n FROM u x, v WHERE x.id = v.id AND v.id > 1 AND NOT n = 'a'", "Project[n](Filter[(v.id > 1) AND NOT (n = 'a')](Join[(x.id = v.id)](Scan u AS x, Scan v)))"),
        ("SELECT a.id FROM u a, u b, v WHERE a.id = v.id AND a.id = b.id", "Project[id](Join[(a.id = v.id)](Join[(a.id = b.id)](Scan u AS a, Scan u AS b), Scan v))"),
        ("SELECT n, COUNT(*) FROM u GROUP BY n, id", "Aggregate[2 keys: n, count_*](Scan u)"),
        ("SELECT u.id FROM u, v", "Project[id](Join[TRUE](Scan u, Scan v))"),
    ],
)
def test_bound_plans(load, query, plan):
    load("u", (("id", "INT"), ("n", "STRING")))
    e = load("v", (("id", "INT"),))
    assert e.plan(query) == plan
    assert "Physical Plan" in e.explain(query, mode="formatted")
