"""Helpers that several operators share."""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.session import scratch_path
from careerlake.sources import files

# Word separators of all operators: space and the control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text: maximal runs without separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def positions(count: Column) -> Column:
    """The array 0 .. count - 1; empty for counts below one."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and text, so that repeated or missing ids do no harm."""
    return F.xxhash64(doc_id, text)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {name.lower() for name in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def sampled(df: DataFrame, wanted: int, total: int, seed: int = 7) -> DataFrame:
    """About ``wanted`` of the ``total`` rows, each drawn by itself: no task sends more than its
    share, and rows that are equal are drawn one by one."""
    return df if total <= wanted else df.filter(F.rand(seed) < wanted / total)


def drawn(df: DataFrame, key: Column, wanted: int, total: int, seed: int = 7) -> DataFrame:
    """About ``wanted`` of the ``total`` rows, chosen by a hash of ``key``: the same rows whatever
    the files and tasks are. Rows of one key are drawn together."""
    share = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df if total <= wanted else df.filter(share < wanted / total)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def keep_until_exit(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that goes when the session's program ends."""
    path = scratch_path(spark, label)

    def drop() -> None:
        try:
            files.delete(spark, path)
        except Exception:  # the session has ended before; its folder is the cluster's to clean
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut there, and a lost
    executor costs no recomputation."""
    path = keep_until_exit(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table made by ``written`` before the program ends."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        files.delete(df.sparkSession, path)
