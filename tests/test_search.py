import numpy as np
import pytest
from pyspark.sql import functions as F

from careerlake.functions import matching, text
from careerlake.operators.embed import embed_hashed, embed_with, require_size
from careerlake.operators import nearest as nearest_module
from careerlake.operators.nearest import nearest
from careerlake.plans import search

DOC_SCHEMA = ("job_id long, job_title string, company_name string, salary_text string, job_url string, "
              "chunk_text string, embedding array<float>")
DOCS = [
    (1, "Senior Data Engineer", "Co A", "1", "u1", "hà_nội data engineer spark", [1.0, 0.0]),
    (2, "Data Analyst", "Co B", "2", "u2", "hà nội sql data engineer", [3.0, 1.0]),
    (3, "Accountant", "Co C", "3", "u3", "huế excel said", [0.0, 1.0]),
    (4, "AI Engineer, Data", "HN Tech", "4", "u4", "python", [1.0, 1.0]),
    (5, "Cook", "Co E", "5", "u5", "kitchen", [0.0, 0.0]),
]
# id, query, attachment, title, places, vector
REQUESTS = [
    (1, "data engineer ai", "", "Data Engineer", [], [1.0, 0.0]),
    (2, "Tìm việc data, cần gấp", "", "", ["Hà Nội "], [1.0, 0.0]),
    (3, "excel?", "", "", ["nowhere"], [1.0, 0.0]),
    (4, "", "", "", [], [0.0, 1.0]),
    (5, "(ai)", "my cv", "", ["hn", "huế"], [1.0, 0.0]),
    (6, "zzzz", "", "", [], [1.0, 0.0]),
]
# Worked by hand: jobs in order with their score, and whether places had to be ignored.
# 1: job 1 has the title (10000), all its words (5000) and two of three keywords (200); job 4 all
#    words and three keywords; job 2 the title in its text (1000), one keyword in the title (100)
#    and one in the text (10). Titles with all words count as distance 0.
# 2: "data" is in both titles, so distance decides; job 1 and 2 name the place.
# 4: nothing is asked for, so distance alone decides; job 5 has none and comes last.
# 5: "ai" is a word of job 4's title and only a part of a word ("said") in job 3.
EXPECTED = {
    1: ([(1, 15200), (4, 5300), (2, 1110)], False),
    2: ([(1, 100), (2, 100)], False),
    3: ([(3, 10)], True),
    4: ([(3, 0), (4, 0), (2, 0), (1, 0), (5, 0)], False),
    5: ([(4, 100)], False),
    6: ([], False),
}


def prepared(spark):
    df = spark.createDataFrame(REQUESTS, "query_id long, user_query string, cv_text string, job_title string, "
                                         "locations array<string>, embedding array<double>")
    return search.prepare_requests(df)


def found(result):
    rows = {}
    for r in result.rows.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.job_id, r.lexical_score))
    return {r.query_id: (rows.get(r.query_id, []), r.is_fallback) for r in result.scopes.collect()}


@pytest.mark.parametrize("block", [512, 3])
def test_hybrid_search_gives_the_worked_results(spark, block):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).repartition(3)
    assert found(search.hybrid_search(prepared(spark), docs, 10, 300, block)) == EXPECTED


def test_short_branches_and_results(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).repartition(3)
    one = found(search.hybrid_search(prepared(spark), docs, 10, 1))
    assert one[1] == ([(1, 15200)], False)  # nearest, and lowest id of those with all words
    assert one[4] == ([(3, 0)], False)
    assert found(search.hybrid_search(prepared(spark), docs, 2))[1] == ([(1, 15200), (4, 5300)], False)


def test_single_request_branches(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    assert [r.job_id for r in search.keyword_search(docs, ["data"], ["hà nội"], 5).collect()] == [1, 2]
    assert [r.job_id for r in search.keyword_search(docs, ["data", "ai"], [], 5).collect()] == [4]
    near = [r.job_id for r in search.vector_search(docs, [2.0, 1.0], [], 4).collect()]
    assert near == [2, 4, 1, 3]
    asked = spark.createDataFrame([(1, [2.0, 1.0])], "query_id long, embedding array<double>")
    assert near == [r.job_id for r in nearest(docs, asked, 4).orderBy("rank").collect()]


def test_documents_are_scanned_once_for_all_blocks(spark, tmp_path):
    spark.createDataFrame(DOCS, DOC_SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    asked = prepared(spark).select("query_id", "embedding")
    plan = nearest(docs, asked, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_requests_and_chunks_are_normalized_alike(spark):
    df = spark.createDataFrame([(1, "java, sql!", "", "", [], "Java, SQL!")],
                               "query_id long, user_query string, cv_text string, job_title string, "
                               "locations array<string>, chunk string")
    row = search.prepare_requests(df).select("search_text", text.normalize(F.col("chunk")).alias("c")).first()
    assert row.search_text == row.c == "java sql"

    def segment(c):
        return F.regexp_replace(c, "java sql", "java_sql")

    assert search.prepare_requests(df, segment=segment).first().search_text == "java_sql"


def test_texts_are_read_once_for_all_requests(spark, tmp_path):
    spark.createDataFrame(DOCS, DOC_SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    marked = search.marked_documents(docs.select(*search.DOCUMENT_COLUMNS), prepared(spark))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") <= 1


@pytest.mark.parametrize("most", [100_000, 2])
def test_terms_are_found_as_the_single_search_finds_them(spark, monkeypatch, most):
    monkeypatch.setattr(nearest_module, "TERMS", most)
    texts = ["c# dev", "a c#b", "hanoi", "Hà Nội", "x-ray q.1", "q.10", "it", "item", "", None, "c++", "dataset"]
    terms = ["c#", "hà nội", "it", "q.1", "data", "c", "zz", "\U0001f600", "x-r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    asked = spark.createDataFrame([(t,) for t in terms + terms], "term string")
    form = docs.select("id", "t", matching.searchable(F.col("t")).alias("f"))
    marks = {r.term: r.m for r in asked.distinct().select("term", nearest_module.term_mark(F.col("term")).alias("m")).collect()}
    for row in form.select("id", "t", nearest_module.mentioned_marks(asked, [F.col("f")]).alias("found")).collect():
        for term in terms:
            single = docs.filter(f"id = {row.id}").filter(matching.mentions_all([term], F.col("t"))).count()
            assert (marks[term] in row.found) == bool(single), (row.t, term)


def test_no_requests_and_no_documents(spark):
    docs, asked = spark.createDataFrame(DOCS, DOC_SCHEMA), prepared(spark)
    nothing = search.hybrid_search(asked.filter("query_id < 0"), docs)
    assert nothing.rows.isEmpty() and nothing.scopes.isEmpty()
    empty = search.hybrid_search(asked, docs.filter("job_id < 0"))
    assert empty.rows.isEmpty() and empty.scopes.count() == len(REQUESTS)


def test_lexical_score_examples(spark):
    rows = [("Senior Data Engineer", "x data engineer y", 15200), ("Engineer, Data", "x ai y", 5210),
            ("Analyst", "data engineer said", 1020), ("Cook", "kitchen", 0)]
    df = spark.createDataFrame(rows, "t string, c string, expected int")
    terms = matching.literal_terms(["data", "engineer", "ai"])
    score = matching.lexical_score(
        matching.searchable(F.col("t")), matching.searchable_chunk(F.col("c")),
        F.lit("data engineer"), matching.literal_terms(["data", "engineer"]), terms)
    assert [r.s for r in df.select(score.alias("s")).collect()] == [r[2] for r in rows]


def test_intent_and_search_text(spark):
    df = spark.createDataFrame(
        [('{"job_title": " Dev ", "locations": ["Hà Nội", "", null, " HN"]}',), ("oops",), (None,)], "j string")
    rows = [r[0] for r in df.select(search.parse_intent(F.col("j"))).collect()]
    assert [(r.job_title, r.locations) for r in rows] == [("dev", ["hà nội", "hn"]), ("", []), ("", [])]
    text = search.search_text(F.lit("dev"), F.lit("find  me"), F.lit("a \n b" + " c" * 600))
    assert spark.range(1).select(text).first()[0] == "dev find  me a b" + " c" * 247 + ""


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string")
    rows = {r.id: np.array(r.embedding) for r in embed_hashed(df, "t").collect()}
    assert len(rows[1]) == 384 and abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and not rows[2].any()
    plan = embed_hashed(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan

    def factory():
        return lambda texts: np.array([[len(t), 1] for t in texts])

    assert [r.embedding for r in embed_with(df, "t", factory, batch_size=2).orderBy("id").collect()] == [
        [5.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="must have 384"):
        require_size(spark.createDataFrame([([1.0],)], "embedding array<float>")).collect()


def test_encoder_is_built_once_per_worker():
    from careerlake.operators.embed import held_encoder

    built = []

    def factory():
        built.append(1)
        return lambda texts: texts

    for _ in range(3):
        held_encoder("one", factory)
    assert len(built) == 1
    held_encoder("two", factory)
    assert len(built) == 2
