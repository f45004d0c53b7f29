"""Reports over summaries against those over the star."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from careerlake.plans import dashboard, summaries
from careerlake.plans.star import Filters
from harness import roles
from harness.compare import plain
from harness.dashboard import CHOSEN, STOP_WORDS
from tests.conftest import SMALL

CHOICES = [Filters(), CHOSEN, Filters(location="NATION_3"), Filters(category="PROMO"), Filters(level="2-HIGH", industry="NATION_7"),
           Filters(industry="NO SUCH")]
REPORTS = ["kpi", "top_skills", "treemap", "level_distribution", "category_salaries", "salary_by_experience", "top_locations"]


def with_losses(star):
    """Some salaries below zero or missing, and jobs without any category, level or years."""
    details, key = star.dim_job_details, F.col("job_id")
    details = details.withColumns({
        "salary_numeric": F.when(key % 5 == 0, -F.col("salary_numeric")).when(key % 7 != 0, F.col("salary_numeric")),
        "years_of_experience": F.when(key % 11 != 0, F.col("years_of_experience")),
        "job_level": F.when(key % 13 != 0, F.col("job_level"))})
    return replace(star, dim_job_details=details, dim_categories=star.dim_categories.filter("job_id % 9 <> 0"))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The star, and summaries of it from two loads of which some jobs are in both."""
    star = with_losses(roles.star(spark, SMALL))
    path = str(tmp_path_factory.mktemp("summaries"))
    for jobs in ("job_id % 3 = 0", "job_id % 3 <> 0 OR job_id % 2 = 0"):
        summaries.summarize(replace(star, fact_job_postings=star.fact_job_postings.filter(jobs))).append(path)
    return star, summaries.Summaries.read(spark, path), path


@pytest.mark.parametrize("name", REPORTS)
def test_reports_equal_those_over_the_star(kept, name):
    star, summary, _ = kept
    for filters in CHOICES[:2] if name not in REPORTS[:3] else CHOICES:
        want = getattr(dashboard, name)(star, filters)
        got = getattr(summaries, name)(summary, filters)
        assert got.columns == want.columns
        assert plain([tuple(r) for r in got.collect()]) == plain([tuple(r) for r in want.collect()])


def test_only_summaries_are_read(kept):
    _, summary, path = kept
    for report in (summaries.top_skills(summary, CHOSEN), summaries.treemap(summary)):
        assert all(f.startswith(f"file://{path}/") for f in report.inputFiles())
    read = summaries.top_skills(summary, CHOSEN)._jdf.queryExecution().toString()
    assert "PartitionFilters" in read and "dim_" not in read


def test_rows_do_not_grow_with_the_jobs(spark):
    star = roles.star(spark, SMALL)
    one = summaries.summarize(replace(star, fact_job_postings=star.fact_job_postings.filter("job_id % 8 = 1")))
    whole = summaries.summarize(star)
    few, many = one.jobs.count(), whole.jobs.count()
    assert many < 2 * few


def test_word_sketches_of_loads_are_combined(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    parts = [summaries.word_sketch(docs.filter(f"doc_id % 3 = {k}"), "text", STOP_WORDS) for k in range(3)]
    sketches = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = dashboard.word_counts(docs, "text", STOP_WORDS).orderBy(F.desc("n"), "word").limit(50).collect()
    got = summaries.top_words(sketches).collect()
    assert [(r.word, r.n) for r in got] == [tuple(r) for r in want]
    tight = [summaries.word_sketch(docs, "text", STOP_WORDS, tracked=100)]
    exact = {r.word: r.n for r in dashboard.word_counts(docs, "text", STOP_WORDS).collect()}
    for r in summaries.top_words(tight[0], 10).collect():
        assert exact[r.word] <= r.n <= exact[r.word] + r.most_error
    nothing = summaries.word_sketch(docs.limit(0), "text", STOP_WORDS)
    assert summaries.top_words(nothing).isEmpty()


def test_tasks_send_narrow_rows_and_no_bitmaps(spark):
    """Bitmaps are finished where their bucket is: no exchange carries the bits of one task."""
    star = roles.star(spark, SMALL)
    made = summaries.summarize(star)
    plan = made.jobs._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Exchange")]
    assert "unhex" in above and "bit_or" in above and "bitmap_construct_agg" not in plan
    assert made.companies.count() == star.fact_job_postings.join(star.dim_job_details, "job_id").count()


def test_bits_stand_where_the_bitmap_functions_look(spark):
    ids = [-70000, -1, 0, 1, 2, 63, 64, 65, 32767, 32768, 32769, 10**12]
    rows = spark.createDataFrame([(i,) for i in ids], "job_id long").withColumn(
        "entries", F.array(F.struct(F.lit("d").alias("dimension"), F.lit(None).cast("string").alias("value"))))
    want = rows.groupBy(F.bitmap_bucket_number("job_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("job_id")).alias("bits"))
    got = summaries._bits(rows)
    assert sorted(map(tuple, got.select("bucket", "bits").collect())) == sorted(map(tuple, want.collect()))
    held = rows.select(F.bitmap_bucket_number("job_id"), F.bitmap_bit_position("job_id")).distinct().collect()
    assert sorted(map(tuple, summaries._positions(got).collect())) == sorted(map(tuple, held))
