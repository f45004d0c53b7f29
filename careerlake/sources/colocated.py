"""Star schema saved as bucketed tables, so joins on the job id need no shuffle."""

from __future__ import annotations

from pyspark.sql import SparkSession

from careerlake.model import STAR_TABLES, Star

BUCKETED_BY = {
    "fact_job_postings": "job_id",
    "dim_job_details": "job_id",
    "dim_locations": "job_id",
    "dim_skills": "job_id",
    "dim_categories": "job_id",
}


def save(star: Star, database: str, buckets: int) -> None:
    """Write the star as tables of a database, job tables bucketed and sorted by job."""
    for name, df in star.tables().items():
        writer = df.write.mode("overwrite").format("parquet")
        if name in BUCKETED_BY:
            key = BUCKETED_BY[name]
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def exists(spark: SparkSession, database: str) -> bool:
    """True if every table of the star is present."""
    return all(spark.catalog.tableExists(f"{database}.{name}") for name in STAR_TABLES)


def load(spark: SparkSession, database: str) -> Star:
    return Star(**{name: spark.table(f"{database}.{name}") for name in STAR_TABLES})
