"""Every registered query of the engine against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from relspark.queries import TABLES, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    ours = queries()[name](spark, SF)
    theirs = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    at = [columns.index(c) for c in ours.columns]
    expected = sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)
    assert sorted(map(tuple, ours.collect()), key=repr) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_operators(monkeypatch):
    """A missing library of theirs leaves the engine's queries."""
    import builtins
    import sys

    import __spark_entry__ as entry

    original = builtins.__import__

    def blocked(name, *rest):
        if name.split(".")[0] in ("tiktoken", "public_tokenizers"):
            raise ModuleNotFoundError(name)
        return original(name, *rest)

    for name in list(sys.modules):
        if name.startswith("relspark.llm") or name == "corpus_pipeline":
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", blocked)
    assert set(entry.queries()) == set(queries())
    assert set(entry.oracle_sql()) == set(oracle_sql())
