"""The registered queries of the engine, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.engine import Engine
from relspark.errors import BindError
from relspark.functions import scalar
from relspark.functions.scalar import Typed
from relspark.operators import project
from relspark.sources.scratch import scratch_dir
from relspark.types import STRING, Schema

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine_on(spark: SparkSession, sf_dir: str, data_dir: str | None = None) -> Engine:
    engine = Engine(spark, data_dir or scratch_dir(spark, "tables"))
    for name in TABLES:
        engine.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return engine


_SHARED: dict[tuple[str, str], Engine] = {}


def shared_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine for all queries that only read, so that files are looked at once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        _SHARED[key] = engine_on(spark, sf_dir)
    return _SHARED[key]


@dataclass(frozen=True)
class Query:
    """A SELECT of the dialect. oracle None: the same text is valid for DuckDB."""

    text: str
    oracle: str | None = None
    strategy: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shared_engine(spark, sf_dir).sql(self.text, self.strategy)


_CUSTOMER_ORDERS = "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c, orders o WHERE c.c_custkey = o.o_custkey"
_FOUR_WAY = "FROM region r, nation n, customer c, orders o WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND o.o_custkey = c.c_custkey"

SELECTS: dict[str, Query] = {
    # scans
    "scan_star": Query("SELECT * FROM region"),
    "scan_columns": Query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem"),
    "scan_filtered_star": Query("SELECT * FROM customer WHERE c_nationkey = 7"),
    # predicates
    "filter_range": Query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"),
    "filter_string_eq": Query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_string_order": Query("SELECT n_name FROM nation WHERE n_name >= 'J' AND n_name <> 'JORDAN'"),
    "filter_and_or_not": Query("SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey < 5 OR c_nationkey >= 20) AND NOT c_mktsegment = 'AUTOMOBILE'"),
    "filter_double_not": Query("SELECT c_custkey FROM customer WHERE NOT NOT c_nationkey = 3"),
    "filter_arithmetic": Query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber + 10) * 2 > 30 AND l_quantity <= 3"),
    "filter_boolean_literal": Query("SELECT r_name FROM region WHERE TRUE"),
    # projection
    "comments": Query("-- all of them\nSELECT r_name -- the name\nFROM region;"),
    "project_columns_alias": Query("SELECT c_custkey AS id, c_name label FROM customer"),
    "project_arith_bigint": Query(
        "SELECT l_orderkey, l_linenumber + 100 AS more, l_linenumber * 2, l_orderkey - l_linenumber FROM lineitem",
        "SELECT l_orderkey, CAST(l_linenumber + 100 AS BIGINT) AS more, CAST(l_linenumber * 2 AS BIGINT) AS expr1, l_orderkey - l_linenumber AS expr2 FROM lineitem",
    ),
    "project_int_div": Query(
        "SELECT o_orderkey, o_orderkey / 7 AS q, (0 - o_orderkey) / 7 AS negative FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, (0 - o_orderkey) // 7 AS negative FROM orders",
    ),
    "project_beyond_int": Query("SELECT r_name, 2147483647 + 1 AS big FROM region", "SELECT r_name, CAST(2147483648 AS BIGINT) AS big FROM region"),
    "project_float_mixed": Query("SELECT p_partkey, p_retailprice * p_size AS v, p_retailprice / p_size AS per, p_retailprice + 1 AS up FROM part"),
    "project_float_zero_div": Query(
        "SELECT p_partkey, p_retailprice / (p_size - p_size) AS v FROM part",
        "SELECT p_partkey, CASE WHEN p_retailprice > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END AS v FROM part",
    ),
    "project_bool": Query("SELECT p_partkey, p_size > 25 AS big, NOT p_size = 1 AND p_brand <> 'Brand#13' AS flag FROM part"),
    "project_literals": Query(
        "SELECT r_name, 1, 'it''s', TRUE AS yes FROM region",
        "SELECT r_name, CAST(1 AS BIGINT) AS expr1, 'it''s' AS expr2, TRUE AS yes FROM region",
    ),
    "project_dup_names": Query(
        "SELECT n_name, n_name, n_nationkey AS n_name, n_nationkey + 1 AS n_name FROM nation",
        'SELECT n_name, n_name AS "nation.n_name", n_nationkey AS "nation.n_nationkey", CAST(n_nationkey + 1 AS BIGINT) AS n_name_1 FROM nation',
    ),
    # joins
    "join_equi": Query(_CUSTOMER_ORDERS),
    "join_hash": Query(_CUSTOMER_ORDERS, strategy="hash"),
    "join_sort_merge": Query(_CUSTOMER_ORDERS, strategy="sort_merge"),
    "join_broadcast": Query("SELECT s.s_suppkey, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey", strategy="broadcast"),
    "join_nested_loop": Query("SELECT s.s_suppkey, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey", strategy="nested_loop"),
    "join_theta": Query("SELECT a.n_nationkey, b.n_nationkey AS other FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "join_cross": Query("SELECT r_name, n_name FROM region, nation"),
    "join_self": Query("SELECT a.s_suppkey, b.s_suppkey AS twin FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    "join_three_way": Query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c, nation n, region r WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey"),
    "join_multi_key": Query("SELECT c.c_name, s.s_name FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey"),
    "join_star_qualified": Query(
        "SELECT * FROM nation n, region WHERE n.n_regionkey = r_regionkey",
        'SELECT n.n_nationkey AS "n.n_nationkey", n.n_name AS "n.n_name", n.n_regionkey AS "n.n_regionkey", r.r_regionkey AS "region.r_regionkey", r.r_name AS "region.r_name" FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey',
    ),
    "join_filter_mixed": Query("SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_nationkey > 20 AND o.o_totalprice >= 100000 AND (o.o_orderkey > 100 OR c.c_custkey < 50)"),
    "join_int_bigint": Query("SELECT n.n_name, c.c_name FROM nation n, customer c WHERE n.n_nationkey = c.c_custkey"),
    # aggregation
    "agg_count": Query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_count_default_name": Query("SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment", 'SELECT c_mktsegment, COUNT(*) AS "count_*" FROM customer GROUP BY c_mktsegment'),
    "agg_five": Query(
        "SELECT l_returnflag, COUNT(l_orderkey), SUM(l_quantity), AVG(l_quantity), MIN(l_extendedprice), MAX(l_extendedprice) FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, COUNT(l_orderkey) AS count, SUM(l_quantity) AS sum, AVG(l_quantity) AS avg, MIN(l_extendedprice) AS min, MAX(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_int": Query(
        "SELECT l_linestatus, SUM(l_linenumber) AS s, AVG(l_linenumber) AS a, MAX(l_orderkey) AS m FROM lineitem GROUP BY l_linestatus",
        "SELECT l_linestatus, CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(AVG(l_linenumber) AS FLOAT) AS a, MAX(l_orderkey) AS m FROM lineitem GROUP BY l_linestatus",
    ),
    "agg_multi_key": Query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_expr_key": Query(
        "SELECT l_linenumber + 1, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber + 1",
        "SELECT CAST(l_linenumber + 1 AS BIGINT) AS expr1, COUNT(*) AS n FROM lineitem GROUP BY ALL",
    ),
    "agg_finer_key": Query(
        "SELECT n_regionkey * 2 AS twice, COUNT(*) AS n FROM nation GROUP BY n_regionkey",
        "SELECT CAST(n_regionkey * 2 AS BIGINT) AS twice, COUNT(*) AS n FROM nation GROUP BY n_regionkey",
    ),
    "agg_constant_key": Query("SELECT COUNT(*) AS n FROM nation GROUP BY 1", "SELECT COUNT(*) AS n FROM nation"),
    "agg_group_only": Query("SELECT event_type FROM events GROUP BY event_type"),
    "agg_global": Query("SELECT COUNT(*) AS n, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM orders"),
    "agg_global_empty": Query("SELECT COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders WHERE FALSE"),
    "agg_empty_groups": Query("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus"),
    "agg_minmax_string": Query("SELECT c_nationkey, MIN(c_name) AS first, MAX(c_mktsegment) AS last FROM customer GROUP BY c_nationkey"),
    "agg_minmax_bool": Query("SELECT p_brand, MIN(p_size > 10) AS every, MAX(p_size > 49) AS some FROM part GROUP BY p_brand"),
    "agg_of_expression": Query(
        "SELECT o_custkey, SUM(o_orderkey * 2) AS s, COUNT(*) AS n FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, CAST(SUM(o_orderkey * 2) AS BIGINT) AS s, COUNT(*) AS n FROM orders GROUP BY o_custkey",
    ),
    "join_agg_flagship": Query(
        f"SELECT r.r_name, COUNT(*) AS orders, SUM(o.o_orderkey) AS keys, AVG(c.c_nationkey) AS mean, MIN(o.o_totalprice) AS least, MAX(o.o_totalprice) AS most {_FOUR_WAY} AND o.o_totalprice > 1000 GROUP BY r.r_name",
        f"SELECT r.r_name, COUNT(*) AS orders, CAST(SUM(o.o_orderkey) AS BIGINT) AS keys, CAST(AVG(c.c_nationkey) AS FLOAT) AS mean, MIN(o.o_totalprice) AS least, MAX(o.o_totalprice) AS most {_FOUR_WAY} AND o.o_totalprice > 1000 GROUP BY r.r_name",
    ),
    # what the optimizer is expected to rewrite
    "opt_pushdown": Query("SELECT c.c_name, o.o_orderkey FROM customer c, orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND c.c_acctbal > 5000"),
    "opt_pruning": Query("SELECT l.l_linenumber AS n, o.o_orderpriority FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49"),
    "opt_reorder": Query("SELECT l.l_orderkey, s.s_name, n.n_name FROM lineitem l, supplier s, nation n WHERE l.l_suppkey = s.s_suppkey AND s.s_nationkey = n.n_nationkey AND n.n_nationkey = 3"),
}


# ---- queries that write, or use the operators directly -------------------------


def insert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir)
    engine.sql("CREATE TABLE users (id INT, name VARCHAR(10), age BIGINT, active BOOLEAN)")
    engine.sql("INSERT INTO users VALUES (1, 'Alice', 20 + 5, TRUE), (2, 'Bob', 60 / 2, 1 > 2), (3, 'O''Hara', 0 - 1, FALSE)")
    return engine.sql("SELECT * FROM users")


def insert_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir)
    engine.sql("CREATE TABLE m (category STRING, value FLOAT, n INT)")
    engine.sql("INSERT INTO m (n, category, value) VALUES (1, 'A', 7), (2, 'A', 9), (3, 'B', 100)")
    return engine.sql("SELECT category, SUM(value) AS s, AVG(value) AS a, MAX(value / 2) AS half, COUNT(*) AS n FROM m GROUP BY category")


def insert_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir)
    engine.sql("CREATE TABLE t (x INT)")
    return engine.sql("INSERT INTO t VALUES (1), (2), (3)")


def ddl_create_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    data_dir = scratch_dir(spark, "tables")
    engine = engine_on(spark, sf_dir, data_dir)
    engine.sql("CREATE TABLE kept (x INT)")
    engine.sql("CREATE TABLE gone (x INT)")
    engine.sql("DROP TABLE gone")
    return spark.createDataFrame([(n,) for n in Engine(spark, data_dir).catalog.list_tables()], "table_name string")


def row_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir)
    engine.catalog.create_table("t", Schema.of(("id", "INT"), ("name", "STRING")))
    table = engine.table("t")
    ids = table.insert((1, "a"), (2, "b"), (3, "c"))
    table.update(ids[1], (2, "changed"))
    table.delete(ids[2])
    return table.scan()


def append_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_on(spark, sf_dir)
    engine.catalog.create_table("copied", Schema.of(("n_nationkey", "INT"), ("n_name", "VARCHAR", 25)))
    engine.table("copied").append(engine.sql("SELECT n_name, n_nationkey FROM nation"))
    return engine.sql("SELECT c.n_name, n.n_regionkey FROM copied c, nation n WHERE c.n_nationkey = n.n_nationkey")


def project_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = engine_on(spark, sf_dir).catalog.scan("nation")
    joined = scalar.concat(Typed(F.col("n_name"), STRING), Typed(F.col("n_nationkey"), "INT"))
    return project(nation, [(joined.column, "label")])


def _people(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[str]]:
    engine = engine_on(spark, sf_dir)
    engine.catalog.create_table("people", Schema.of(("id", "INT"), ("name", "STRING")))
    return engine, engine.table("people").insert((1, "a"), (2, "b"), (3, "c"))


def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, ids = _people(spark, sf_dir)
    table = engine.table("people")
    return spark.createDataFrame([tuple(table.read(ids[1]))], table.schema.to_spark())


def tuple_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _people(spark, sf_dir)[0].table("people")
    return spark.createDataFrame([tuple(r) for r in table.tuples()], table.schema.to_spark())


def validate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_engine(spark, sf_dir).validate("SELECT n_nationkey + 1 AS next, n_name, n_nationkey > 3 AS many FROM nation")
    return spark.createDataFrame(found, "name string, kind string")


def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, and stored anew after the table has changed."""
    engine, _ = _people(spark, sf_dir)
    first = engine.statistics("people")
    engine.table("people").insert((9, "z"))
    out = [(f.rows, f.columns["id"].least, f.columns["id"].most, f.columns["name"].most) for f in (first, engine.statistics("people"), Engine(spark, engine.catalog.data_dir).statistics("people"))]
    return spark.createDataFrame(out, "rows long, least int, most int, last string")


def _refused(*texts: str) -> Callable[[SparkSession, str], DataFrame]:
    """Which statements are refused when bound, and where."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for text in texts:
            try:
                shared_engine(spark, sf_dir).sql(text)
                out.append((text, False, None))
            except BindError as e:
                out.append((text, True, e.position.column))
        return spark.createDataFrame(out, "statement string, refused boolean, error_column int")

    return run


def _refusals(*cases: tuple[str, int]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    rows = ", ".join("('{}', TRUE, CAST({} AS INTEGER))".format(text.replace("'", "''"), at) for text, at in cases)
    return _refused(*(text for text, _ in cases)), f"SELECT * FROM (VALUES {rows}) t(statement, refused, error_column)"


WRITERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "insert_roundtrip": (
        insert_roundtrip,
        "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'Alice', CAST(25 AS BIGINT), TRUE), (2, 'Bob', 30, FALSE), (3, 'O''Hara', -1, FALSE)) t(id, name, age, active)",
    ),
    "insert_column_list": (
        insert_column_list,
        "SELECT * FROM (VALUES ('A', CAST(16 AS FLOAT), CAST(8 AS FLOAT), CAST(4.5 AS FLOAT), CAST(2 AS BIGINT)), ('B', 100, 100, 50, 1)) t(category, s, a, half, n)",
    ),
    "insert_count": (insert_count, "SELECT CAST(3 AS INTEGER) AS inserted_count"),
    "ddl_create_drop": (ddl_create_drop, "SELECT 'kept' AS table_name"),
    "row_update_delete": (row_update_delete, "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'a'), (2, 'changed')) t(id, name)"),
    "append_table": (append_table, "SELECT n_name, n_regionkey FROM nation"),
    "point_read": (point_read, "SELECT CAST(2 AS INTEGER) AS id, 'b' AS name"),
    "tuple_scan": (tuple_scan, "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'a'), (2, 'b'), (3, 'c')) t(id, name)"),
    "validate_types": (validate_types, "SELECT * FROM (VALUES ('next', 'BIGINT'), ('n_name', 'STRING'), ('many', 'BOOLEAN')) t(name, kind)"),
    "table_statistics": (table_statistics, "SELECT * FROM (VALUES (CAST(3 AS BIGINT), CAST(1 AS INTEGER), CAST(3 AS INTEGER), 'c'), (4, 1, 9, 'z'), (4, 1, 9, 'z')) t(rows, least, most, last)"),
    "error_group_alias": _refusals(("SELECT n_regionkey AS r, COUNT(*) FROM nation GROUP BY r", 56)),
    "error_aggregate_place": _refusals(("SELECT n_name FROM nation WHERE COUNT(*) > 1", 33), ("SELECT COUNT(*) FROM nation GROUP BY SUM(n_regionkey)", 38)),
    "error_aggregate_in_expression": _refusals(("SELECT SUM(n_regionkey) + 1 FROM nation", 8), ("SELECT MEDIAN(n_regionkey) FROM nation", 8)),
    "error_aggregate_arguments": _refusals(("SELECT SUM(*) FROM nation", 8), ("SELECT MIN(n_name, n_regionkey) FROM nation", 8)),
    "project_concat": (project_concat, "SELECT n_name || CAST(n_nationkey AS VARCHAR) AS label FROM nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**SELECTS, **{name: run for name, (run, _) in WRITERS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{name: q.oracle or q.text for name, q in SELECTS.items()}, **{name: sql for name, (_, sql) in WRITERS.items()}}
