"""The staging layer: all-text Parquet tables, replaced by every load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from careerlake.model import STAGING
from careerlake.session import at_once


def replace(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Overwrite all seven tables; one that is not given becomes empty."""
    spark = next(iter(tables.values())).sparkSession

    def write(name: str, schema: StructType) -> None:
        rows = (tables[name].select(*schema.fieldNames()) if name in tables
                else spark.createDataFrame([], schema))
        rows.write.mode("overwrite").parquet(f"{folder}/raw_{name}")

    at_once(spark, write, STAGING.items())


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/raw_{name}")
            for name, schema in STAGING.items()}
