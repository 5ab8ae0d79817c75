"""Run queries on Spark and their SQL on DuckDB, and compare whole results.

    python -m checks.compare [--folder DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.catalog import QUERIES
from checks.oracle import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FAMILY = {"int": "whole", "bigint": "whole", "INTEGER": "whole", "BIGINT": "whole", "double": "real", "DOUBLE": "real",
          "string": "text", "VARCHAR": "text", "date": "date", "DATE": "date",
          "timestamp_ntz": "time", "TIMESTAMP": "time", "boolean": "truth", "BOOLEAN": "truth"}


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    cursor = connection.execute(sql)
    theirs = {c[0]: FAMILY.get(str(c[1]), str(c[1])) for c in cursor.description}
    ours = {name: FAMILY.get(kind, kind) for name, kind in spark_df.dtypes}
    if ours != theirs:
        return f"schema: spark {ours} sql {theirs}"
    expected = _rows(list(theirs), cursor.fetchall())
    found = _rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if found != expected:
        return (f"rows: spark {sum(found.values())} sql {sum(expected.values())}; only spark "
                f"{list((found - expected).items())[:3]}; only sql {list((expected - found).items())[:3]}")
    return None if expected else "no rows"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--folder", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = oracle_connection(options.folder)
    failed = 0
    for name in options.names or QUERIES:
        begin = time.time()
        try:
            found = difference(QUERIES[name](spark, options.folder), connection, ORACLE[name])
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:400]}"
        failed += found is not None
        print(f"{name:32s} {time.time() - begin:6.2f}s {'ok' if found is None else found}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
