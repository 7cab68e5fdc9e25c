"""python -m relspark [DATA_DIR] [SQL ...]: runs statements, or a short demonstration."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import SparkSession

from relspark.engine import Engine

DEMO = (
    "CREATE TABLE users (id INT, name VARCHAR(20), age INT)",
    "INSERT INTO users VALUES (1, 'Ada', 36), (2, 'Alan', 20 + 21)",
    "SELECT name, age + 1 AS next FROM users WHERE age > 36",
)


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    data_dir = arguments[0] if arguments else tempfile.mkdtemp()
    engine = Engine(spark, data_dir)
    for statement in arguments[1:] or DEMO:
        print(statement)
        engine.sql(statement).show()


if __name__ == "__main__":
    main(sys.argv[1:])
