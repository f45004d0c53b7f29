"""Dashboard reports over the star schema.

Every report takes the star and the chosen filters and returns a DataFrame. Counts
are distinct jobs. Dimension names are joined after counting per id, so a company or
industry that owns a large part of the jobs is one row by then.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.functions import display
from careerlake.functions.text import cloud_tokens
from careerlake.model import Star
from careerlake.operators.ranking import top_k
from careerlake.plans.star import (
    ALL, ChosenStar, Filters, job_categories, matching_jobs, with_category_count,
)
from careerlake.session import checkpointed

# List lengths and limits of the reports.
TOP_SKILLS = TOP_COMPANIES = TOP_CATEGORIES = 10
TOP_LOCATIONS = TOP_INDUSTRIES = 5
TREEMAP_CATEGORIES = 3
MOST_YEARS = 10
CLOUD_WORDS = 50
TABLE_ROWS = 100
OTHER_NAMES = ["Khác", "Khác "]
OTHERS = "others"

# Columns of the KPI row.
KPI_SCHEMA = ["total_jobs", "total_companies", "avg_salary", "avg_experience"]


def kpi(star: Star, filters: Filters = Filters(), weighted: bool = True) -> DataFrame:
    """Jobs, companies, mean non-zero salary and mean years, as one row.

    Means weight a job by its categories; ``weighted=False`` counts each job once.
    Distinct counts come from grouping in two steps, per job and per company, which
    needs no copy of the rows per distinct column.
    """
    jobs = matching_jobs(star, filters, ["salary_numeric", "years_of_experience"])
    jobs = (with_category_count(star, jobs, filters) if weighted
            else jobs.withColumn("copies", F.lit(1)))
    copies = F.col("copies").cast("double")
    salary, years = F.nullif(F.col("salary_numeric"), F.lit(0)), F.col("years_of_experience")
    parts = {
        "salary_sum": salary * copies,
        "salary_rows": F.when(salary.isNotNull(), copies),
        "years_sum": years * copies,
        "years_rows": F.when(years.isNotNull(), copies),
    }
    per_job = jobs.groupBy("company_id", "job_id").agg(
        *[F.sum(c).alias(name) for name, c in parts.items()])
    per_company = per_job.groupBy("company_id").agg(
        F.count("job_id").alias("jobs"), *[F.sum(name).alias(name) for name in parts])
    return per_company.agg(
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("total_jobs"),
        F.count("company_id").alias("total_companies"),
        (F.sum("salary_sum") / F.nullif(F.sum("salary_rows"), F.lit(0.0))).alias("avg_salary"),
        (F.sum("years_sum") / F.nullif(F.sum("years_rows"), F.lit(0.0))).alias("avg_experience"),
    )


def kpi_labels(row: DataFrame) -> DataFrame:
    """The KPI row as display text (P25)."""
    return row.select(
        display.count_label(F.col("total_jobs")).alias("total_jobs"),
        display.count_label(F.col("total_companies")).alias("total_companies"),
        display.salary_label(F.col("avg_salary")).alias("avg_salary"),
        display.years_label(F.col("avg_experience")).alias("avg_exp"),
    )


def largest(counts: DataFrame, name: str, n: int | None = None) -> DataFrame:
    ordered = counts.orderBy(F.desc("jobs"), F.asc_nulls_last(name))
    return ordered if n is None else ordered.limit(n)


def _jobs_per_value(star: Star, filters: Filters, bridge: DataFrame, name: str) -> DataFrame:
    jobs = matching_jobs(star, filters).select("job_id")
    return jobs.join(bridge, "job_id").groupBy(name).agg(F.count_distinct("job_id").alias("jobs"))


def top_skills(star: Star, filters: Filters = Filters(), n: int = TOP_SKILLS) -> DataFrame:
    """Skills with the most jobs (R2)."""
    return largest(_jobs_per_value(star, filters, star.dim_skills, "skill_name"), "skill_name", n)


def level_distribution(star: Star, filters: Filters = Filters()) -> DataFrame:
    """Jobs per level."""
    jobs = matching_jobs(star, filters, ["job_level"])
    counts = jobs.groupBy("job_level").agg(F.count_distinct("job_id").alias("jobs"))
    return largest(counts, "job_level")


def top_companies(star: Star, filters: Filters = Filters(), n: int = TOP_COMPANIES) -> DataFrame:
    """Companies with the most jobs."""
    per_id = matching_jobs(star, filters).groupBy("company_id").agg(
        F.count_distinct("job_id").alias("jobs"))
    names = star.dim_companies.select("company_id", "company_name")
    counts = per_id.join(names, "company_id").groupBy("company_name").agg(
        F.sum("jobs").alias("jobs"))
    return largest(counts, "company_name", n)


def category_salaries(star: Star, filters: Filters = Filters(), n: int = TOP_CATEGORIES
                      ) -> DataFrame:
    """Categories with the highest mean salary."""
    paid = matching_jobs(star, filters, ["salary_numeric"]).filter("salary_numeric > 0")
    listed = job_categories(star, filters).filter(F.col("category_name").isNotNull())
    means = paid.select("job_id", "salary_numeric").join(listed, "job_id").groupBy(
        "category_name").agg(F.avg("salary_numeric").alias("avg_salary"))
    return means.orderBy(F.desc("avg_salary"), F.asc("category_name")).limit(n).withColumn(
        "avg_salary_millions", display.millions(F.col("avg_salary")))


def salary_by_experience(star: Star, filters: Filters = Filters(), most_years: int = MOST_YEARS
                         ) -> DataFrame:
    """Mean salary and jobs per year of experience (R6); means are category-weighted."""
    columns = ["salary_numeric", "years_of_experience"]
    paid = matching_jobs(star, filters, columns).filter(
        (F.col("salary_numeric") > 0) & (F.col("years_of_experience") <= most_years))
    weighted = with_category_count(star, paid, filters)
    copies = F.col("copies").cast("double")
    per_job = weighted.groupBy("years_of_experience", "job_id").agg(
        F.sum(F.col("salary_numeric") * copies).alias("salary"), F.sum(copies).alias("copies"))
    per_year = per_job.groupBy("years_of_experience").agg(
        (F.sum("salary") / F.sum("copies")).alias("avg_salary"),
        F.count("job_id").alias("jobs"))
    return per_year.withColumn(
        "avg_salary_millions", display.millions(F.col("avg_salary"))
    ).orderBy(F.asc("years_of_experience"))


def treemap(star: Star, filters: Filters = Filters(), industries: int = TOP_INDUSTRIES,
            categories: int = TREEMAP_CATEGORIES) -> DataFrame:
    """Largest categories of the largest industries (R7), with their shade.

    An industry's size is the sum of its category counts. All windows and the top-5
    run over counted (industry, category) pairs.
    """
    jobs = matching_jobs(star, filters).select("job_id", "industry_id")
    listed = job_categories(star, filters).filter(F.col("category_name").isNotNull())
    per_id = jobs.join(listed, "job_id").groupBy("industry_id", "category_name").agg(
        F.count_distinct("job_id").alias("jobs"))
    named = star.dim_industries.filter(F.col("industry_name").isNotNull())
    pairs = per_id.join(named, "industry_id").groupBy("industry_name", "category_name").agg(
        F.sum("jobs").alias("jobs"))
    return shaded(pairs, industries, categories)


def shaded(pairs: DataFrame, industries: int, categories: int) -> DataFrame:
    """Largest categories of the largest industries, from their common jobs."""
    most = (
        pairs.groupBy("industry_name").agg(F.sum("jobs").alias("industry_jobs"))
        .orderBy(F.desc("industry_jobs"), F.asc("industry_name")).limit(industries)
    )
    kept = pairs.join(most.select("industry_name"), "industry_name", "left_semi")
    ranked = top_k(kept, ["industry_name"], [F.desc("jobs"), F.asc("category_name")], categories)
    return ranked.withColumn("shade", F.col("rank") - 1).drop("rank").orderBy(
        F.asc("industry_name"), F.desc("jobs"), F.asc("category_name"))


def top_locations(star: Star, filters: Filters = Filters(), n: int = TOP_LOCATIONS) -> DataFrame:
    """Locations with the most jobs and their share among those shown."""
    places = star.dim_locations.filter(F.col("location_name").isNotNull())
    return shares(_jobs_per_value(star, filters, places, "location_name"), n)


def shares(counts: DataFrame, n: int) -> DataFrame:
    """The locations with the most jobs, and their share among them."""
    top = largest(counts, "location_name", n)
    # The window runs over the few rows of the report.
    total = F.sum("jobs").over(Window.partitionBy())
    share = F.round(100 * F.col("jobs") / total).cast("int")
    return top.withColumn("share", share).orderBy(F.desc("jobs"), F.asc("location_name"))


def word_counts(texts: DataFrame, column: str, stop_words: Sequence[str],
                weight: Column | None = None) -> DataFrame:
    """Occurrences of each word in a text column."""
    weight = F.lit(1) if weight is None else weight
    words = texts.filter(F.col(column).isNotNull()).select(
        weight.alias("_weight"), F.explode(cloud_tokens(F.col(column), stop_words)).alias("word"))
    return words.groupBy("word").agg(F.sum("_weight").alias("n"))


def word_cloud(star: Star, stop_words: Sequence[str], filters: Filters = Filters(),
               n: int = CLOUD_WORDS, sample: int | None = None) -> DataFrame:
    """Most common words of the job requirements with font sizes.

    ``stop_words`` is the list of the site; words on it are not shown.

    The whole corpus counts. ``sample`` takes only that many joined rows, lowest job
    ids first, for sites that show a quick sample (T9).
    """
    jobs = matching_jobs(star, filters, ["job_requirements"]).filter(
        F.col("job_requirements").isNotNull())
    texts = with_category_count(star, jobs, filters)
    if sample is not None:
        repeated = texts.select("job_id", "job_requirements", F.explode(
            F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        texts = repeated.orderBy("job_id", "copy").limit(sample).withColumn("copies", F.lit(1))
    counts = word_counts(texts, "job_requirements", stop_words, F.col("copies"))
    return sized_words(counts, n)


def sized_words(counts: DataFrame, n: int = CLOUD_WORDS) -> DataFrame:
    """The ``n`` most common words, capitalized, with their font size."""
    top = counts.orderBy(F.desc("n"), F.asc("word")).limit(n)
    shown = Window.partitionBy()  # over the few words shown
    size = display.font_size(F.col("n"), F.min("n").over(shown), F.max("n").over(shown))
    return top.select(
        display.word_label(F.col("word")).alias("key"), F.col("n").alias("value"),
        size.alias("size")).orderBy(F.desc("value"), F.asc("key"))


TABLE_TEXTS = {
    "title": "job_title", "salary": "salary_text", "company": "company_name",
    "desc": "job_description", "req": "job_requirements", "ben": "job_benefits",
    "url": "job_url",
}


def latest_jobs(star: Star, filters: Filters = Filters(), n: int = TABLE_ROWS,
                chosen: ChosenStar | None = None) -> DataFrame:
    """Newest jobs with their texts; jobs without a date come first.

    The rows are picked from ids and dates alone, once: the few chosen ids are written down.
    Only the chosen jobs are joined to company names and long texts. ``chosen`` may hold the
    jobs that pass the filters.
    """
    jobs = matching_jobs(chosen or star, filters, ["posted_date"])
    dated = jobs.groupBy("job_id").agg(F.max("posted_date").alias("posted_date"))
    newest = checkpointed(
        dated.orderBy(F.desc_nulls_first("posted_date"), F.asc("job_id")).limit(n))
    owners = star.fact_job_postings.select("job_id", "company_id").join(
        newest.select("job_id"), "job_id", "left_semi")
    companies = owners.join(
        star.dim_companies.select("company_id", "company_name"), "company_id", "left"
    ).groupBy("job_id").agg(F.max("company_name").alias("company_name"))
    texts = star.dim_job_details.drop("posted_date").join(
        newest.select("job_id"), "job_id", "left_semi")
    rows = newest.join(companies, "job_id").join(texts, "job_id").groupBy("job_id").agg(
        F.max("posted_date").alias("posted_date"),
        *[F.max(c).alias(c) for c in TABLE_TEXTS.values()])
    return rows.select(
        "job_id", "posted_date",
        *[display.blank(F.col(c)).alias(name) for name, c in TABLE_TEXTS.items()],
    ).orderBy(F.desc_nulls_first("posted_date"), F.asc("job_id"))


def filter_options(star: Star) -> DataFrame:
    """Choices of the four dropdowns, ``All`` included."""
    sources = {
        "industry": (star.dim_industries, "industry_name"),
        "category": (star.dim_categories, "category_name"),
        "level": (star.dim_job_details, "job_level"),
        "location": (star.dim_locations, "location_name"),
    }
    lists = []
    for name, (table, column) in sources.items():
        values = table.select(F.col(column).alias("choice")).filter("choice IS NOT NULL")
        lists.append(values.distinct().select(F.lit(name).alias("filter"), "choice"))
    spark = star.dim_industries.sparkSession
    sentinels = spark.createDataFrame([(name, ALL) for name in sources], "filter string, choice string")
    return reduce(DataFrame.unionByName, lists, sentinels)


def option_order(choice: Column) -> list[Column]:
    """``All`` first, other-groups last, the rest in Vietnamese order."""
    last = choice.isin(OTHER_NAMES) | (F.lower(choice) == OTHERS)
    bucket = F.when(choice == ALL, 0).when(last, 2).otherwise(1)
    return [bucket, F.collate(choice, "vi"), choice]


def sorted_options(options: DataFrame) -> DataFrame:
    """The choices of each dropdown in order, with their position from 1."""
    place = Window.partitionBy("filter").orderBy(*option_order(F.col("choice")))
    return options.withColumn("position", F.row_number().over(place).cast("bigint")).orderBy(
        "filter", "position")


def _base_star(star: Star, filters: Filters) -> ChosenStar:
    """The star with the joined rows of the jobs that pass the filters, written down once.

    Reports of one document read these narrow rows instead of joining and filtering ten times.
    """
    columns = ["job_level", "salary_numeric", "years_of_experience", "posted_date"]
    return ChosenStar(**star.tables(), jobs=checkpointed(matching_jobs(star, filters, columns)))


def dashboard_document(star: Star, stop_words: Sequence[str], filters: Filters = Filters()
                       ) -> DataFrame:
    """All reports as one row: charts as lists of labels and values, tables as lists.

    Each report is short by then. Its rows are folded with their sort keys in front and
    sorted as a list, so no window runs over a whole report.
    """
    narrow = _base_star(star, filters)
    kept = Filters(category=filters.category)  # categories of the jobs still depend on it

    def rows(order: Sequence[Column], values: dict[str, Column]) -> Column:
        keys = [c.alias(f"_{i}") for i, c in enumerate(order)]
        listed = F.sort_array(F.collect_list(F.struct(
            *keys, F.struct(*[c.alias(n) for n, c in values.items()]).alias("_row"))))
        return F.transform(listed, lambda r: r["_row"])

    def table(report: DataFrame, name: str, order: Sequence[Column], values: dict[str, Column]
              ) -> DataFrame:
        return report.agg(rows(order, values).alias(name))

    def chart(report: DataFrame, name: str, order: Sequence[Column], values: dict[str, Column]
              ) -> DataFrame:
        folded = report.agg(rows(order, values).alias("_rows"))
        return folded.select(F.struct(*[
            F.transform("_rows", lambda r: r[n]).alias(n) for n in values]).alias(name))

    def label(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("None"))

    jobs, salary = F.col("jobs"), F.col("avg_salary_millions")
    # The newest rows need long texts, so they come from the whole star.
    labels = kpi_labels(kpi(narrow, kept))
    sections = [
        labels.select(F.struct(*labels.columns).alias("kpi")),
        chart(top_skills(narrow, kept), "bar_skills", [-jobs, F.col("skill_name")],
              {"labels": label("skill_name"), "data": jobs}),
        chart(level_distribution(narrow, kept), "pie_levels", [-jobs, F.col("job_level")],
              {"labels": label("job_level"), "data": jobs}),
        chart(top_companies(narrow, kept), "bar_companies", [-jobs, F.col("company_name")],
              {"labels": label("company_name"), "data": jobs}),
        chart(category_salaries(narrow, kept), "bar_salaries",
              [-F.col("avg_salary"), F.col("category_name")],
              {"labels": label("category_name"), "data": salary}),
        chart(salary_by_experience(narrow, kept), "mix_exp", [F.col("years_of_experience")],
              {"labels": label("years_of_experience"), "jobs": jobs, "salary": salary}),
        table(treemap(narrow, kept), "treemap", [F.col("industry_name"), F.col("shade")],
              {"industry": F.col("industry_name"), "category": F.col("category_name"),
               "value": jobs}),
        chart(top_locations(narrow, kept), "pie_locations", [-jobs, F.col("location_name")],
              {"labels": label("location_name"), "data": jobs}),
        table(word_cloud(star, stop_words, filters), "word_cloud",
              [-F.col("value"), F.col("key")], {"key": F.col("key"), "value": F.col("value")}),
        table(latest_jobs(star, filters, chosen=narrow), "table_data",
              [F.col("posted_date").isNotNull(), -F.unix_date("posted_date"), F.col("job_id")],
              {name: F.col(name) for name in TABLE_TEXTS}),
    ]
    names = [s.columns[0] for s in sections]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)
    return stacked.agg(*[F.first(name, ignorenulls=True).alias(name) for name in names])


def dashboard_json(star: Star, stop_words: Sequence[str], filters: Filters = Filters()
                   ) -> DataFrame:
    """The dashboard document as JSON text."""
    document = dashboard_document(star, stop_words, filters)
    return document.select(F.to_json(
        F.struct(*document.columns), {"ignoreNullFields": "false"}).alias("document"))
