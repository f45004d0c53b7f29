"""Hybrid search of job chunks for a table of requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.functions.matching import (
    lexical_score, mentions_all, mentions_any, query_keywords, scores_kept, search_terms,
    searchable, searchable_chunk, split_words,
)
from careerlake.functions.text import clip, normalize_query
from careerlake.functions.vectors import cosine_distance_to
from careerlake.model import Star
from careerlake.operators.embed import embed_hashed
from careerlake.operators.nearest import BRANCH_SIZE, CHUNK, candidates, mentioned_marks, term_mark
from careerlake.operators.ranking import average_rank_in_window, fused_score, top_k
from careerlake.session import checkpointed

# Results per request, attachment characters in the search text, rank
# constant, and place names shown to the user.
RESULTS = 10
ATTACHMENT_CHARACTERS = 500
RANK_CONSTANT = 60
PLACES_SHOWN = 2

INTENT_SCHEMA = "job_title string, locations array<string>"

# What a search document has: one row per vectorized job.
DOCUMENT_COLUMNS = [
    "job_id", "job_title", "company_name", "salary_text", "job_url", "chunk_text", "embedding",
]


def search_documents(star: Star, vectors: DataFrame) -> DataFrame:
    """Vectorized jobs with what a search shows of them.

    Company names join narrow fact rows; vectors and texts move once, by job.
    """
    owners = star.fact_job_postings.select("job_id", "company_id").join(
        star.dim_companies.select("company_id", "company_name"), "company_id")
    shown = star.dim_job_details.select("job_id", "job_title", "salary_text", "job_url")
    rows = vectors.join(shown, "job_id").join(owners, "job_id")
    return rows.select(*DOCUMENT_COLUMNS)


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_intent(c: Column) -> Column:
    """Wanted title and place names out of JSON text; unreadable text wants nothing."""
    intent = F.from_json(c, INTENT_SCHEMA, {"mode": "PERMISSIVE"})
    title = F.coalesce(F.lower(strip_space(intent["job_title"])), F.lit(""))
    return F.struct(title.alias("job_title"), place_terms(intent["locations"]).alias("locations"))


def place_terms(locations: Column) -> Column:
    """Lower-case place names without blanks."""
    listed = F.coalesce(locations, F.array().cast("array<string>"))
    low = F.transform(F.filter(listed, lambda p: p.isNotNull()),
                      lambda p: F.lower(strip_space(p)))
    return F.filter(low, lambda p: p != "")


def requested_label(places: Column) -> Column:
    """The first place names in one line."""
    return F.array_join(F.slice(places, 1, PLACES_SHOWN), ", ")


def search_text(wanted: Column, query: Column, attachment: Column) -> Column:
    """Text to embed: wanted title, query, and the start of the attachment."""
    start = F.regexp_replace(clip(attachment, ATTACHMENT_CHARACTERS), r"(?U)\s+", " ")
    tail = F.when(F.coalesce(attachment, F.lit("")) != "",
                  F.concat(F.lit(" "), F.trim(start))).otherwise(F.lit(""))
    return F.concat(wanted, F.lit(" "), F.coalesce(query, F.lit("")), tail)


def prepare_requests(requests: DataFrame,
                     embed: Callable[[DataFrame, str], DataFrame] | None = None,
                     segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """Requests with their terms, and with a vector where they bring none.

    ``embed`` and ``segment`` must be those that made the vectors of the documents.

    Input: ``query_id``, ``user_query``, ``cv_text``, ``job_title``, ``locations`` and
    perhaps ``embedding``.
    """
    wanted = F.coalesce(F.lower(strip_space(F.col("job_title"))), F.lit(""))
    ready = requests.withColumns({
        "wanted": wanted,
        "places": place_terms(F.col("locations")),
    }).withColumns({
        "title_words": split_words(F.col("wanted")),
        "keywords": query_keywords(F.col("user_query"), F.col("places")),
        "requested_location": requested_label(F.col("places")),
        "search_text": normalize_query(
            search_text(F.col("wanted"), F.col("user_query"), F.col("cv_text")), segment=segment),
    })
    if "embedding" in requests.columns:
        return ready
    return embed(ready, "search_text") if embed else embed_hashed(ready, "search_text")


def keyword_search(docs: DataFrame, title_words: Sequence[str], places: Sequence[str] = (),
                   n: int = BRANCH_SIZE) -> DataFrame:
    """Jobs of one request whose title has all words, lowest ids first."""
    texts = [F.translate("chunk_text", "_", " "), F.col("company_name"), F.col("job_title")]
    found = docs.filter(mentions_any(places, texts) & mentions_all(title_words, F.col("job_title")))
    return found.orderBy("job_id").limit(n).withColumn("vector_distance", F.lit(0.0))


def vector_search(docs: DataFrame, vector: Sequence[float], places: Sequence[str] = (),
                  n: int = BRANCH_SIZE) -> DataFrame:
    """Jobs of one request nearest to its vector."""
    texts = [F.translate("chunk_text", "_", " "), F.col("company_name"), F.col("job_title")]
    near = docs.filter(mentions_any(places, texts)).withColumn(
        "vector_distance", cosine_distance_to(F.col("embedding"), list(map(float, vector))))
    return near.orderBy(F.asc_nulls_last("vector_distance"), "job_id").limit(n)


@dataclass(frozen=True)
class SearchResult:
    """Ranked rows, and one row per request saying where the search had to look."""

    rows: DataFrame
    scopes: DataFrame


def search_forms(docs: DataFrame) -> DataFrame:
    """Documents with the forms a search reads: padded title, company and chunk."""
    return docs.select(
        "*", searchable(F.col("job_title")).alias("title_form"),
        searchable(F.col("company_name")).alias("company_form"),
        searchable_chunk(F.col("chunk_text")).alias("chunk_form"))


def marked_documents(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Search forms with the marks of the requests' places and title words that each job mentions.

    All texts are read once, whatever the number of requests.
    """
    forms = search_forms(docs)
    title, everywhere = F.col("title_form"), [F.col("chunk_form"), F.col("company_form"), F.col("title_form")]
    places = requests.select(F.explode("places").alias("term"))
    words = requests.select(F.explode("title_words").alias("term"))
    return forms.withColumns({
        "places": mentioned_marks(places, everywhere), "words": mentioned_marks(words, [title])})


def _chosen_candidates(docs: DataFrame, requests: DataFrame, n: int, chunk: int) -> DataFrame:
    """Candidates of each request, nearby ones if there are any.

    A request has at most ``4 n`` candidate rows, so a window per request is bounded.
    """
    asked = requests.select("query_id", "embedding", *[
        F.array_distinct(F.transform(terms, term_mark)).alias(name)
        for name, terms in (("places", "places"), ("words", "title_words"))])
    found = candidates(docs, asked, n, chunk)
    merged = found.groupBy("query_id", "scope", "job_id").agg(
        F.min("vector_distance").alias("vector_distance"))
    any_near = F.max((F.col("scope") == "near").cast("int")).over(Window.partitionBy("query_id"))
    kept = merged.withColumn("_any_near", any_near).filter(
        (F.col("scope") == "near") | (F.col("_any_near") == 0))
    return checkpointed(kept.select(
        "query_id", "job_id", "vector_distance", (F.col("scope") == "wide").alias("is_fallback")))


def candidate_texts(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents among the candidates, without their vectors; scoring and the final rows need them."""
    return checkpointed(docs.drop("embedding", "company_form", "places", "words").join(
        found.select("job_id").distinct(), "job_id", "left_semi"))


def score_candidates(found: DataFrame, texts: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates with their lexical score; unrelated ones are dropped.

    Terms are prepared once per request and texts once per document. Pairs carry only
    terms into the join, so each text is shuffled once, and none leaves it.
    """
    terms = requests.select(
        "query_id", "wanted",
        search_terms(F.col("title_words")).alias("words"),
        search_terms(F.col("keywords")).alias("terms"))
    forms = texts.select("job_id", F.col("title_form").alias("title"), F.col("chunk_form").alias("chunk"))
    # Scoring costs time rather than bytes: keep all partitions instead of letting the
    # small rows be gathered into a few.
    spread = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = found.join(terms, "query_id").repartition(spread, "job_id")
    pairs = asked.join(forms, "job_id")
    score = lexical_score(
        F.col("title"), F.col("chunk"), F.col("wanted"), F.col("words"), F.col("terms"))
    asks_nothing = (F.col("wanted") == "") & (F.size("terms") == 0)
    return pairs.select(
        "query_id", "job_id", "vector_distance", "is_fallback",
        scores_kept(score, asks_nothing).alias("lexical_score"),
    ).filter(F.col("lexical_score").isNotNull())


def rank_candidates(scored: DataFrame, k: int = RESULTS) -> DataFrame:
    """Rank fusion of distance and lexical score, best ``k`` per request."""
    ranked = scored.withColumns({
        "vector_rank": average_rank_in_window(F.col("vector_distance"), ["query_id"]),
        "lexical_rank": average_rank_in_window(F.col("lexical_score"), ["query_id"], False),
    }).withColumn(
        "rrf_score", fused_score(F.col("vector_rank"), F.col("lexical_rank"), RANK_CONSTANT))
    order = [F.desc_nulls_last("rrf_score"), F.col("job_id")]
    return top_k(ranked, ["query_id"], order, k, "rank")


def hybrid_search(requests: DataFrame, docs: DataFrame, k: int = RESULTS,
                  branch_size: int = BRANCH_SIZE, chunk: int = CHUNK) -> SearchResult:
    """Vector and keyword candidates, scored and fused, for every request.

    ``requests`` come from ``prepare_requests``. The documents are joined, brought into their search
    forms and searched for all terms once, and written down with the terms they mention. All requests
    are then compared with them in one pass, and each candidate's text is read once.
    """
    # Requests are read for terms, marks, scores and scopes; embed them once.
    requests = checkpointed(requests)
    docs = checkpointed(marked_documents(docs.select(*DOCUMENT_COLUMNS), requests))
    found = _chosen_candidates(docs, requests, branch_size, chunk)
    texts = candidate_texts(found, docs)
    best = rank_candidates(score_candidates(found, texts, requests), k)
    rows = best.join(texts.drop("title_form", "chunk_form"), "job_id").join(
        requests.select("query_id", "requested_location"), "query_id")
    near = found.filter(~F.col("is_fallback")).select("query_id").distinct()
    far = requests.filter(F.size("places") > 0).join(near, "query_id", "left_anti").select(
        "query_id", F.lit(True).alias("is_fallback"))
    scopes = requests.select("query_id", "requested_location").join(
        far, "query_id", "left").withColumn("is_fallback", F.coalesce("is_fallback", F.lit(False)))
    return SearchResult(rows, scopes)
