"""Filtered base rows of the star schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlake.model import Star

# Fixed value: the choice that means "no filter".
ALL = "All"


@dataclass(frozen=True)
class Filters:
    """Dashboard choices; each one left at ``All`` filters nothing."""

    industry: str = ALL
    category: str = ALL
    level: str = ALL
    location: str = ALL


@dataclass(frozen=True)
class ChosenStar(Star):
    """A star of jobs that have passed the filters, with their joined rows in ``jobs``."""

    jobs: DataFrame


def matching_jobs(star: Star, filters: Filters = Filters(), columns: Sequence[str] = ()
                  ) -> DataFrame:
    """One row per posting that passes the filters, with the detail ``columns`` asked for.

    Industry, category and location choices only decide which jobs stay, so they are
    semi-joins: a job keeps all its other locations (F4) and is never multiplied.
    The joins share the key ``job_id``, so one exchange per table serves them all.
    """
    needed = ["job_id", *columns]
    if isinstance(star, ChosenStar):
        return star.jobs.select("company_id", "industry_id", *dict.fromkeys(needed))
    details = star.dim_job_details
    if filters.level != ALL:
        details = details.filter(F.col("job_level") == filters.level)
    jobs = star.fact_job_postings.select("job_id", "company_id", "industry_id").join(
        details.select(*dict.fromkeys(needed)), "job_id")
    if filters.category != ALL:
        chosen = star.dim_categories.filter(F.col("category_name") == filters.category)
        jobs = jobs.join(chosen.select("job_id"), "job_id", "left_semi")
    if filters.location != ALL:
        chosen = star.dim_locations.filter(F.col("location_name") == filters.location)
        jobs = jobs.join(chosen.select("job_id"), "job_id", "left_semi")
    if filters.industry != ALL:
        chosen = star.dim_industries.filter(F.col("industry_name") == filters.industry)
        jobs = jobs.join(chosen.select("industry_id"), "industry_id", "left_semi")
    return jobs


def job_categories(star: Star, filters: Filters = Filters()) -> DataFrame:
    """Categories of the jobs; with a category chosen, only that one."""
    if filters.category == ALL:
        return star.dim_categories
    return star.dim_categories.filter(F.col("category_name") == filters.category)


def with_category_count(star: Star, jobs: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Add ``copies``: how often the join to categories repeats a job.

    A job without a category still counts once. Means over the joined rows weight a
    job by this number; counting before the join keeps the joined rows out of memory.
    """
    per_job = job_categories(star, filters).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_categories"))
    return jobs.join(per_job, "job_id", "left").withColumn(
        "copies", F.coalesce(F.col("_categories"), F.lit(1))).drop("_categories")
