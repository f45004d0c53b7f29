"""Run queries and their SQL side by side: ``python -m harness.compare FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from harness import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("careerlake")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    """A value in a form both engines share."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark, connection, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = catalog.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_time, start = time.time() - start, time.time()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spark_time:.1f}s"
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    want = rows_of(names, result.fetchall())
    label = f"{len(got)} rows, {spark_time:.1f}s, SQL {time.time() - start:.1f}s"
    mine = dict(df.dtypes)
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = "; ".join(f"{n}: {mine[n]}/{types[n]}" for n in sorted(names))
    if got != want:
        only = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return False, f"{label}; want {len(want)} rows\n  mine {only[0]}\n  SQL  {only[1]}\n  {kinds}"
    return True, f"{label} [{kinds}]"


def main(folder: str, chosen: list[str]) -> int:
    spark, connection = session(), connect(folder)
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in chosen or list(catalog.queries()):
        try:
            good, text = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on with the next query
            good, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "FAIL", name, text, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
