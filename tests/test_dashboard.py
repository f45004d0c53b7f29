import pytest
from pyspark.sql import functions as F

from careerlake.plans import dashboard
from careerlake.plans.star import Filters
from harness import catalog, roles
from harness.dashboard import STOP_WORDS
from tests.conftest import SMALL

NATIVE = [name for name in catalog.queries() if name not in {
    "hybrid_search", "search_scopes", "rag_context", "prompt_table", "cosine_topk", "cosine_topk_cells", "embed_encoder",
    "embedded_requests",
    "incremental_load", "extract_load", "session_activity"}]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert banned not in plan


def test_a_filter_that_matches_nothing_gives_empty_reports(spark):
    star = roles.star(spark, SMALL)
    nobody = Filters(industry="NO SUCH")
    row = dashboard.kpi(star, nobody).first()
    assert (row.total_jobs, row.total_companies, row.avg_salary) == (0, 0, None)
    assert tuple(dashboard.kpi_labels(dashboard.kpi(star, nobody)).first()) == ("0", "0", "N/A", "0 Years")
    assert dashboard.top_skills(star, nobody).isEmpty()


def test_location_filter_keeps_other_locations_of_the_jobs(spark):
    star = roles.star(spark, SMALL)
    place = star.dim_locations.groupBy("location_name").count().orderBy(F.desc("count")).first()[0]
    rows = dashboard.top_locations(star, Filters(location=place)).collect()
    assert rows[0].location_name == place and len(rows) > 1


def test_sample_takes_joined_rows(spark):
    star = roles.star(spark, SMALL, texts=True)
    whole = dashboard.word_cloud(star, STOP_WORDS, n=10**6).agg(F.sum("value")).first()[0]
    some = dashboard.word_cloud(star, STOP_WORDS, n=10**6, sample=100).agg(F.sum("value")).first()[0]
    assert 0 < some < whole


def test_option_order(spark):
    names = ["Khác", "Zalo", "All", "Đà Nẵng", "Dak", "Êm", "E", "An"]
    options = spark.createDataFrame([("x", n) for n in names], "filter string, choice string")
    assert [r.choice for r in dashboard.sorted_options(options).collect()] == [
        "All", "An", "Dak", "Đà Nẵng", "E", "Êm", "Zalo", "Khác"]


def test_dashboard_document_has_all_sections(spark):
    document = dashboard.dashboard_document(roles.star(spark, SMALL, texts=True), STOP_WORDS).first().asDict()
    assert set(document) == {
        "kpi", "bar_skills", "pie_levels", "bar_companies", "bar_salaries", "mix_exp", "treemap",
        "pie_locations", "word_cloud", "table_data"}
    assert len(document["table_data"]) == 100 and len(document["treemap"]) == 15
    assert set(document["bar_skills"].asDict()) == {"labels", "data"}
    assert set(document["mix_exp"].asDict()) == {"labels", "jobs", "salary"}
    assert set(document["treemap"][0].asDict()) == {"industry", "category", "value"}


def test_dashboard_document_of_no_jobs_has_empty_lists(spark):
    star = roles.star(spark, SMALL, texts=True)
    document = dashboard.dashboard_document(star, STOP_WORDS, Filters(industry="NO SUCH")).first()
    assert document.bar_skills.labels == [] == document.pie_levels.data == document.table_data
    assert document.kpi.total_jobs == "0"


def test_stop_words_are_dropped(spark):
    texts = spark.createDataFrame([("experience kinh nghiem skills Python python",)], "t string")
    rows = dashboard.word_counts(texts, "t", ["experience", "skills", "kinh"]).collect()
    assert {(r.word, r.n) for r in rows} == {("nghiem", 1), ("python", 2)}


def test_reports_of_a_document_join_the_facts_once(spark):
    star = roles.star(spark, SMALL)
    place = Filters(location="NATION_3")
    chosen = dashboard._base_star(star, place)
    plan = dashboard.level_distribution(chosen)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for report in (dashboard.kpi, dashboard.top_skills, dashboard.salary_by_experience):
        assert report(chosen).collect() == report(star, place).collect()
    newest = dashboard.latest_jobs(star, place, chosen=chosen).collect()
    assert newest == dashboard.latest_jobs(star, place).collect()
