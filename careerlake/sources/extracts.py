"""The seven CSV extracts: all-text, header row, quoted newlines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from careerlake.functions.text import scrub_null_tokens
from careerlake.model import STAGING
from careerlake.session import at_once
from careerlake.sources import files

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"',
               "encoding": "UTF-8"}


def extract_paths(folder: str) -> dict[str, str]:
    """Table name -> extract path below a folder (S3)."""
    return {name: f"{folder}/{name}.csv" for name in STAGING}


def existing_extracts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Only the extracts that are present; a missing file is skipped (S3)."""
    return {n: p for n, p in extract_paths(folder).items() if files.exists(spark, p)}


def read_extract(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One extract with its empty and null-like cells as empty strings."""
    raw = spark.read.schema(STAGING[name]).options(**CSV_OPTIONS).csv(path)
    return raw.select(*[scrub_null_tokens(raw[c]).alias(c) for c in raw.columns])


def read_extracts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Staging tables of a folder; a table without a file is empty."""
    present = existing_extracts(spark, folder)
    return {
        name: read_extract(spark, name, present[name]) if name in present
        else spark.createDataFrame([], schema)
        for name, schema in STAGING.items()
    }


def write_extracts(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Replace the extracts of a folder, all seven of them."""
    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").options(
            header=True, quote='"', escape='"', emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}.csv")

    if tables:
        at_once(next(iter(tables.values())).sparkSession, write, tables.items())


def has_data(tables: Mapping[str, DataFrame]) -> bool:
    """True if any staging table holds a row."""
    return any(not df.isEmpty() for df in tables.values())


def remove_extracts(spark: SparkSession, folder: str) -> None:
    """Delete the extracts of a folder after a good load."""
    for path in existing_extracts(spark, folder).values():
        files.delete(spark, path)
