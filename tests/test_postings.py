"""Keyword search through the title index against the search of one request."""

import pytest
from pyspark.sql import functions as F

from careerlake.functions.matching import split_words
from careerlake.operators import postings
from careerlake.plans import search
from careerlake.session import scratch_path

DOCS = [
    (1, "Senior C++ Developer", "Acme", "work in Hà Nội"),
    (2, "Developer", "Nội Corp", "remote"),
    (3, "Sales_Manager (B2B)", "Acme", "da_nang office"),
    (4, None, "Acme", "developer"),
    (5, "", None, None),
    (6, "IT Support Engineer", "Orion", "hà nội"),
    (7, "Kỹ sư IT", "Orion", "Đà Nẵng"),
    (8, "developers developers developers", "X", "IT"),
    (9, "a++b c# dev", "X", "y"),
    (10, "Developer", "Nội Corp", "remote"),
]
REQUESTS = [
    ("it", ""), ("IT support", ""), ("developer", ""), ("developer", "hà nội"), ("developer", "nội|acme"), ("dev", ""),
    ("manager", "da nang"), ("c++", ""), ("c#", ""), ("++", ""), ("ỹ s", ""), ("kỹ sư", "đà nẵng"), ("b2b", ""), ("b2", ""),
    ("xyz", ""), ("", ""), ("", "acme"), ("developer developer", "remote"), ("velop", "y|remote"), ("(b2b)", ""), ("(b", ""),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "job_id long, job_title string, company_name string, chunk_text string").withColumns(
        {"salary_text": F.lit(""), "job_url": F.lit(""), "embedding": F.array(F.lit(1.0))})
    path = scratch_path(spark, "titles")
    postings.index_titles(docs.filter("job_id < 5")).append(path)
    postings.index_titles(docs.filter("job_id >= 5")).append(path)
    requests = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(REQUESTS)], "query_id long, t string, p string").select(
        "query_id", split_words(F.lower("t")).alias("title_words"),
        F.filter(F.split("p", r"\|"), lambda x: x != "").alias("places"))
    return docs, requests, postings.TitleIndex.read(spark, path)


def test_equals_the_search_of_each_request(tables):
    docs, requests, index = tables
    found = {}
    for r in postings.keyword_table(requests, docs, index).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.job_id)
    some = 0
    for r in requests.collect():
        want = [d.job_id for d in search.keyword_search(docs, r.title_words, r.places).collect()] if r.title_words else []
        assert found.get(r.query_id, []) == want, (r.title_words, r.places)
        some += bool(want)
    assert some > 10


def test_the_lowest_ids_stay(tables):
    docs, requests, index = tables
    rows = postings.keyword_table(requests.filter("query_id = 2"), docs, index, n=2).collect()
    assert [(r.job_id, r.rank, r.vector_distance) for r in rows] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert postings.keyword_table(requests.limit(0), docs, index).isEmpty()


def test_requests_look_at_their_rarest_gram_and_its_bucket(spark, tables):
    docs, requests, index = tables
    many = spark.createDataFrame([(i, f"Developer number {i}") for i in range(400)], "job_id long, job_title string")
    chosen = postings.rarest_grams(
        spark.createDataFrame([(1, ["developer", "number", "377"]), (2, ["nothing"])], "query_id long, title_words array<string>"),
        postings.index_titles(many)).collect()
    assert [(r.query_id, r.gram) for r in chosen] in ([(1, "377")], [(1, "=377")])
    plan = postings._titled(requests, docs, index)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_gram_of_most_titles_is_dealt_out(spark):
    docs = spark.range(2000).select(F.col("id").alias("job_id"), F.lit("The same title").alias("job_title"))
    parts = postings.index_titles(docs).postings.filter("gram = 'itl'").groupBy("slice").count().collect()
    assert len(parts) == postings.SLICES and max(r["count"] for r in parts) < 300


def test_titles_are_checked_where_they_meet_a_question(tables):
    docs, requests, index = tables
    found = postings._titled(requests, docs, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join" in line)
    assert "slice" in last and "forall" in last


def test_requests_that_ask_the_same_are_one_question(spark, tables):
    docs, _, index = tables
    asked = spark.range(50).select(
        F.col("id").alias("query_id"), F.array(F.lit("developer")).alias("title_words"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("remote"))).otherwise(F.array().cast("array<string>")).alias("places"))
    ids, questions = postings._questions(asked)
    assert questions.count() == 2 and ids.count() == 50
    rows = postings.keyword_table(asked, docs, index).groupBy("query_id").agg(F.sort_array(F.collect_list("job_id")).alias("jobs")).collect()
    assert len(rows) == 50
    assert {tuple(r.jobs) for r in rows if r.query_id % 2} == {(1, 2, 8, 10)} and {tuple(r.jobs) for r in rows if r.query_id % 2 == 0} == {(2, 10)}
