from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def engine(spark, tmp_path):
    from relspark import Engine

    return Engine(spark, str(tmp_path / "data"))


@pytest.fixture
def load(engine):
    """load("users", [("id", "INT")], rows): a table with these rows."""
    from relspark import Schema

    def make(name, columns, rows=()):
        engine.catalog.create_table(name, Schema.of(*columns))
        engine.table(name).insert(*rows)
        return engine

    return make
