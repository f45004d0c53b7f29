"""Schemas of every layer and the star-schema bundle."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


TEXT, LONG, INT, FLAG = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
DATE, MOMENT = T.DateType(), T.TimestampNTZType()


def _typed(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _list_of(**columns: T.DataType) -> T.ArrayType:
    return T.ArrayType(_typed(**columns))


# One posting as the feed delivers it. Keys that are absent read as NULL.
JOB_DOCUMENT = _typed(
    jobId=TEXT, jobUrl=TEXT, alias=TEXT, jobTitle=TEXT,
    companyId=LONG, companyName=TEXT, companyProfile=TEXT, companyLogo=TEXT,
    salary=TEXT, prettySalaryVI=TEXT, prettySalary=TEXT,
    salaryMin=LONG, salaryMax=LONG, isSalaryVisible=FLAG,
    jobLevelVI=TEXT, jobDescription=TEXT, jobRequirement=TEXT,
    approvedOn=TEXT, expiredOn=TEXT, yearsOfExperience=INT,
    benefits=_list_of(benefitNameVI=TEXT, benefitName=TEXT, benefitValue=TEXT),
    skills=_list_of(skillName=TEXT),
    workingLocations=_list_of(cityNameVI=TEXT, address=TEXT),
    jobFunction=_typed(
        parentNameVI=TEXT, parentName=TEXT, children=_list_of(nameVI=TEXT, name=TEXT)),
)
FEED_PAGE = T.StructType([T.StructField("data", T.ArrayType(JOB_DOCUMENT))])

# Staging: every value is text.
STAGING = {
    "fact_job_postings": _strings("job_id", "company_id", "industry_id", "crawled_at"),
    "dim_job_details": _strings(
        "job_id", "job_title", "job_url", "salary_text", "job_level", "posted_date",
        "expiry_date", "years_of_experience", "job_description", "job_requirements",
        "job_benefits",
    ),
    "dim_companies": _strings(
        "company_id", "company_name", "description", "logo_url", "profile_url"
    ),
    "dim_industries": _strings("industry_id", "industry_name"),
    "dim_locations": _strings("job_id", "location_name"),
    "dim_skills": _strings("job_id", "skill_name"),
    "dim_categories": _strings("job_id", "category_name"),
}

# Warehouse: typed star schema, the vector table, and the name -> id key tables.
WAREHOUSE = {
    "fact_job_postings": _typed(
        job_id=LONG, company_id=LONG, industry_id=LONG, crawled_at=MOMENT),
    "dim_job_details": _typed(
        job_id=LONG, job_title=TEXT, job_url=TEXT, salary_text=TEXT, salary_numeric=LONG,
        job_level=TEXT, posted_date=DATE, expiry_date=DATE, years_of_experience=INT,
        job_description=TEXT, job_requirements=TEXT, job_benefits=TEXT),
    "dim_companies": _typed(
        company_id=LONG, company_name=TEXT, description=TEXT, logo_url=TEXT, profile_url=TEXT),
    "dim_industries": _typed(industry_id=LONG, industry_name=TEXT),
    "dim_locations": _typed(job_id=LONG, location_name=TEXT),
    "dim_skills": _typed(job_id=LONG, skill_name=TEXT),
    "dim_categories": _typed(job_id=LONG, category_name=TEXT),
    "dim_job_vectors": _typed(
        job_id=LONG, chunk_text=TEXT, embedding=T.ArrayType(T.FloatType())),
    "key_companies": _typed(value=TEXT, id=LONG),
    "key_industries": _typed(value=TEXT, id=LONG),
}

PRIMARY_KEYS = {
    "fact_job_postings": ["job_id"],
    "dim_job_details": ["job_id"],
    "dim_companies": ["company_id"],
    "dim_industries": ["industry_id"],
    "dim_locations": ["job_id", "location_name"],
    "dim_skills": ["job_id", "skill_name"],
    "dim_categories": ["job_id", "category_name"],
    "dim_job_vectors": ["job_id"],
}

# child table, key column, parent table
FOREIGN_KEYS = [
    ("fact_job_postings", "job_id", "dim_job_details"),
    ("fact_job_postings", "company_id", "dim_companies"),
    ("fact_job_postings", "industry_id", "dim_industries"),
    ("dim_locations", "job_id", "dim_job_details"),
    ("dim_skills", "job_id", "dim_job_details"),
    ("dim_categories", "job_id", "dim_job_details"),
    ("dim_job_vectors", "job_id", "dim_job_details"),
]

AUDIT_EVENT = _typed(
    run_id=TEXT, pipeline_name=TEXT, event_time=MOMENT, status=TEXT,
    records_processed=LONG, error_message=TEXT)

VECTOR_SIZE = 384


@dataclass(frozen=True)
class Star:
    """The seven star-schema tables as DataFrames."""

    fact_job_postings: DataFrame
    dim_job_details: DataFrame
    dim_companies: DataFrame
    dim_industries: DataFrame
    dim_locations: DataFrame
    dim_skills: DataFrame
    dim_categories: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


STAR_TABLES = [f.name for f in fields(Star)]


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A table without rows; the limit tells the planner so, and joins with it are not run."""
    return spark.createDataFrame([], WAREHOUSE[name]).limit(0)
