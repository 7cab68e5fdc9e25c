from __future__ import annotations

import pytest

from relspark import BindError, CatalogError, Column, Engine, Schema
from relspark.streaming import feed, follow

PEOPLE = Schema.of(("id", "INT"), ("name", "VARCHAR", 5))


def test_create_find_drop_reopen(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    first = e.catalog.create_table("Users", PEOPLE)
    assert e.catalog.get_table("USERS") == first
    with pytest.raises(CatalogError, match="already exists"):
        e.catalog.create_table("users", PEOPLE)
    second = e.catalog.create_table("b", Schema.of(("x", "FLOAT")))
    assert second.id > first.id
    e.table("Users").insert((1, "Ann"))
    e.catalog.drop_table("b")
    e.catalog.drop_table_id(second.id)  # again: nothing happens
    again = Engine(spark, str(tmp_path))
    assert again.catalog.list_tables() == ["Users"]
    assert again.catalog.get_table("users").schema == PEOPLE
    assert again.table(first.id).scan().collect() == [(1, "Ann")]
    assert again.catalog.create_table("c", PEOPLE).id > second.id
    with pytest.raises(CatalogError, match="Unknown table"):
        again.table("b")


def test_two_writers_cannot_both_log(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    a.catalog.create_table("t", PEOPLE)
    with pytest.raises(Exception, match="exists"):
        b.catalog.create_table("t", PEOPLE)


def test_appends_and_updates_of_two_writers_all_count(spark, tmp_path):
    a = Engine(spark, str(tmp_path))
    a.catalog.create_table("t", PEOPLE)
    first, _ = a.table("t").insert((1, "a"), (2, "b"))
    b = Engine(spark, str(tmp_path))
    a.table("t").update(first, (1, "A"))
    b.sql("INSERT INTO t VALUES (3, 'c')")
    a.sql("INSERT INTO t VALUES (4, 'd')")
    for e in (a, b, Engine(spark, str(tmp_path))):
        assert sorted(map(tuple, e.sql("SELECT * FROM t").collect())) == [(1, "A"), (2, "b"), (3, "c"), (4, "d")]
    b.sql("DROP TABLE t")
    with pytest.raises(BindError):
        a.sql("SELECT * FROM t")


def test_an_update_that_others_overtake_is_an_error(spark, tmp_path, monkeypatch):
    """The append that comes between reading and logging stays, the update doesn't count."""
    a, b = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    a.catalog.create_table("t", PEOPLE)
    (row,) = a.table("t").insert((1, "a"))
    table = a.table("t")
    original = table._rewrite

    def overtaken(before, df):
        b.table("t").insert((2, "b"))
        original(before, df)

    monkeypatch.setattr(table, "_rewrite", overtaken)
    for change in (lambda: table.update(row, (1, "x")), lambda: table.delete(row)):
        with pytest.raises(CatalogError, match="another writer"):
            change()
    assert sorted(map(tuple, a.table("t").scan().collect())) == [(1, "a"), (2, "b"), (2, "b")]


def test_an_unfinished_append_does_not_count(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    e.catalog.create_table("t", PEOPLE)
    monkeypatch.setattr(e.catalog, "log_append", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        e.table("t").insert((1, "a"))
    assert Engine(spark, str(tmp_path)).table("t").scan().count() == 0


def test_named_batches_count_once(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.catalog.create_table("t", PEOPLE)
    rows = spark.createDataFrame([("ok", 1)], "name string, id long")
    for handle in (e, e, Engine(spark, str(tmp_path))):
        handle.table("t").append(rows, "first")
    e.table("t").append(rows, "second")
    assert e.table("t").scan().count() == 2


def test_statistics_are_stored_until_rows_change(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    e.catalog.create_table("t", PEOPLE)
    e.table("t").insert((1, "a"), (5, "b"))
    found = e.statistics("t")
    again = Engine(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(again.catalog, "scan", None)
        assert again.statistics("t") == found
    again.table("t").insert((7, "c"))
    assert (e.statistics("t").rows, e.statistics("t").columns["id"].most) == (3, 7)


def test_rows_by_id(engine):
    engine.catalog.create_table("t", PEOPLE)
    t = engine.table("t")
    a, b = t.insert((1, "Ann"), {"NAME": "Bob", "id": 2})
    assert t.read(b) == (2, "Bob")
    assert t.update(b, (3, "Cy")) == b
    assert sorted(map(tuple, t.tuples())) == [(1, "Ann"), (3, "Cy")]
    t.delete(a)
    assert t.read(a) is None
    assert [tuple(r) for r in t.scan().collect()] == [(3, "Cy")]
    for action in (lambda: t.update(a, (1, "x")), lambda: t.delete("none")):
        with pytest.raises(CatalogError, match="No such row"):
            action()


@pytest.mark.parametrize(
    ("row", "message"),
    [
        ((None, "a"), "id can't be NULL"),
        ((1, None), "name can't be NULL"),
        ((True, "a"), "id expects INT"),
        ((1 << 31, "a"), "id expects INT"),
        ((1, "sixsix"), r"name exceeds VARCHAR\(5\)"),
        ((1, "😀😀😀"), "exceeds"),  # six UTF-16 units
        ((1,), "2 values"),
    ],
)
def test_values_are_checked(engine, row, message):
    engine.catalog.create_table("t", PEOPLE)
    with pytest.raises(CatalogError, match=message):
        engine.table("t").insert((7, "fine"), row)
    assert engine.table("t").scan().count() == 0


def test_append_checks_in_the_plan(spark, engine):
    engine.catalog.create_table("t", PEOPLE)
    t = engine.table("t")
    t.append(spark.createDataFrame([("ok", 1)], "name string, id long"))
    assert [tuple(r) for r in t.scan().collect()] == [(1, "ok")]
    for bad in [(None, 1)], [("toolong", 1)]:
        with pytest.raises(Exception, match="NULL|VARCHAR"):
            t.append(spark.createDataFrame(bad, "name string, id long"))
    assert t.scan().count() == 1


@pytest.mark.parametrize("make", [lambda: Schema(()), lambda: Schema.of(("a", "INT"), ("A", "INT")), lambda: Column("a", "VARCHAR"), lambda: Column("a", "INT", 3), lambda: Column("", "INT")])
def test_schema_rules(make):
    with pytest.raises(CatalogError):
        make()


def test_outside_parquet_is_read_only(engine):
    engine.register_parquet("region", "/root/testdata/sf0.001/region.parquet")
    assert engine.sql("SELECT * FROM region").count() == 5
    with pytest.raises(Exception, match="read-only"):
        engine.sql("INSERT INTO region VALUES (9, 'x')")
    engine.sql("DROP TABLE region")
    assert engine.catalog.lookup("region") is None


def test_streams(spark, engine, tmp_path):
    for name in ("a", "b"):
        engine.catalog.create_table(name, PEOPLE)
    engine.table("a").insert((1, "x"), (2, "y"))
    for _ in range(2):  # the second run finds nothing new
        feed(follow(engine.table("a")), engine.table("b"), str(tmp_path / "c"), available_now=True).awaitTermination(60)
    assert sorted(map(tuple, engine.table("b").scan().collect())) == [(1, "x"), (2, "y")]
