"""Inverted index of titles, and keyword search of a whole request table through it.

A title's grams are its words and its distinct three-character pieces. A search term of up to three
characters must be whole words of the title, longer terms may stand anywhere in it, so a title that
mentions a term holds all grams of the term. A request looks only at the titles that hold its rarest
gram, and those are then checked by the exact rule. Requests are rows: any number of them is one join.

Postings of one gram are dealt over ``SLICES`` parts by job, to which requests are copied, so a gram
that most titles hold is no single task. They are kept by hash buckets of the gram, and a search reads
the buckets it asks for. New documents append to the index.

Requests that ask the same are one question. Titles and terms travel with the postings and the
questions, so a title is checked where it meets a question: what only shares a gram is neither moved
nor written, and of questions without places each task passes on the ``n`` lowest jobs at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.functions.matching import SHORT_TERM, mentions, once, search_terms, searchable, searchable_chunk
from careerlake.operators.nearest import BRANCH_SIZE
from careerlake.operators.ranking import top_k
from careerlake.session import checkpointed

PIECE = 3
SLICES = 16
BUCKETS = 64
ANY = ""  # the gram that every title has


@dataclass(frozen=True)
class TitleIndex:
    """``postings(bucket, gram, slice, job_id)`` and ``counts(gram, titles)``."""

    postings: DataFrame
    counts: DataFrame

    def append(self, path: str) -> None:
        self.postings.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
        self.counts.write.mode("append").parquet(f"{path}/counts")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "TitleIndex":
        return cls(
            spark.read.schema("gram string, slice int, job_id bigint, bucket int").parquet(f"{path}/postings"),
            spark.read.schema("gram string, titles bigint").parquet(f"{path}/counts"),
        )


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _pieces(low: Column) -> Column:
    """Distinct pieces of three characters."""
    last = F.length(low) - PIECE + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(PIECE))))


def _words(low: Column) -> Column:
    """Distinct short words, marked so that they differ from pieces."""
    words = F.filter(F.split(low, r"(?U)\W+"), lambda w: (w != "") & (F.length(w) <= SHORT_TERM))
    return F.transform(F.array_distinct(words), lambda w: F.concat(F.lit("="), w))


def index_titles(docs: DataFrame) -> TitleIndex:
    """The index of ``docs(job_id, job_title)``; ids must differ."""
    low = F.coalesce(F.lower("job_title"), F.lit(""))
    grams = once(low, lambda t: F.concat(F.array(F.lit(ANY)), _pieces(t), _words(t)))
    rows = docs.select("job_id", F.explode(grams).alias("gram"))
    postings = rows.select(
        _bucket(F.col("gram")).alias("bucket"), "gram",
        F.pmod(F.xxhash64("job_id"), F.lit(SLICES)).cast("int").alias("slice"), "job_id")
    return TitleIndex(postings, rows.groupBy("gram").agg(F.count(F.lit(1)).alias("titles")))


def _term_grams(term: Column) -> Column:
    """Grams that a title must have to mention a term."""
    return F.when(F.length(term) <= SHORT_TERM, _words(term)).otherwise(_pieces(term))


def rarest_grams(requests: DataFrame, index: TitleIndex) -> DataFrame:
    """``query_id, gram``: the gram of each request that the fewest titles have.

    A request that needs a gram which no title has is left out.
    """
    needed = requests.filter(F.size("title_words") > 0).select("query_id", F.explode(F.concat(
        F.array(F.lit(ANY)), F.array_distinct(F.flatten(F.transform("title_words", _term_grams))))).alias("gram"))
    # Postings of several loads: their counts add up.
    wanted = needed.select("gram").distinct()
    counts = index.counts.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.sum("titles").alias("titles"))
    known = needed.join(counts, "gram", "left")
    return known.groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("rarest")
    ).filter("rarest.titles > 0").select("query_id", "rarest.gram")


def _titled(requests: DataFrame, docs: DataFrame, index: TitleIndex) -> DataFrame:
    """``query_id, job_id`` of all titles that mention all words of a request (F8)."""
    terms = requests.select("query_id", search_terms(F.col("title_words")).alias("terms"))
    asked = rarest_grams(requests, index).join(terms, "query_id").select(
        "query_id", "terms", "gram", _bucket(F.col("gram")).alias("bucket"),
        F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    wanted = asked.select("bucket", "gram").distinct()
    titles = docs.select("job_id", searchable(F.col("job_title")).alias("title"))
    held = index.postings.join(wanted, ["bucket", "gram"], "left_semi").join(titles, "job_id")
    return held.join(asked, ["bucket", "gram", "slice"]).filter(
        F.forall("terms", lambda t: mentions(F.col("title"), t))).select("query_id", "job_id")


def _placed(pairs: DataFrame, requests: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose job mentions a place of the request.

    Texts are read for jobs that a request has found, and checked once per place.
    """
    asked = checkpointed(pairs.join(requests, "query_id").select(
        "query_id", "job_id", F.explode(F.array_distinct("places")).alias("place")))
    terms = asked.select("job_id", "place").distinct().withColumn(
        "term", F.element_at(search_terms(F.array("place")), 1))
    forms = docs.join(asked.select("job_id").distinct(), "job_id", "left_semi").select(
        "job_id", searchable(F.col("job_title")).alias("t"), searchable(F.col("company_name")).alias("c"),
        searchable_chunk(F.col("chunk_text")).alias("k"))
    here = terms.join(forms, "job_id").filter(
        mentions(F.col("t"), F.col("term")) | mentions(F.col("c"), F.col("term")) | mentions(F.col("k"), F.col("term"))
    ).select("job_id", "place")
    return asked.join(here, ["job_id", "place"], "left_semi").select("query_id", "job_id").distinct()


def _questions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query_id, question`` of all requests, and ``query_id, title_words, places`` of the questions.

    Rows that share a query id are one question of several rows, each as often as it is there.
    """
    alike = requests.filter("query_id IS NOT NULL").groupBy("query_id", "title_words", "places").agg(F.count(F.lit(1)).alias("times"))
    said = alike.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("title_words", "places", "times"))).alias("rows")
    ).withColumn("said", F.to_json("rows"))
    numbers = checkpointed(said.groupBy("said").agg(F.any_value("rows").alias("rows")).withColumn("question", F.monotonically_increasing_id()))
    rows = numbers.select(F.col("question").alias("query_id"), F.inline("rows"))
    listed = rows.select("query_id", "title_words", "places", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")
    return said.select("query_id", "said").join(numbers.select("said", "question"), "said").drop("said"), listed


def keyword_table(requests: DataFrame, docs: DataFrame, index: TitleIndex, n: int = BRANCH_SIZE) -> DataFrame:
    """``query_id, job_id, vector_distance, rank``: for each request the ``n`` lowest job ids whose
    title has all its words, in jobs that mention one of its places.

    ``requests(query_id, title_words, places)`` hold lower-case words; a request without title words
    has no keyword results. ``docs`` have the columns of search documents, and ``index`` their titles.
    """
    ids, asked = _questions(requests.select("query_id", "title_words", "places"))
    placed = asked.filter(F.size("places") > 0).select("query_id", "places")
    found = _titled(asked, docs, index)
    bound = found.join(placed.select("query_id").distinct(), "query_id", "left_semi")
    free = found.join(placed.select("query_id"), "query_id", "left_anti")
    order = [F.col("job_id")]
    ranked = top_k(free, ["query_id"], order, n).unionByName(top_k(_placed(bound, placed, docs), ["query_id"], order, n))
    # At most n jobs for a question.
    answers = ranked.groupBy(F.col("query_id").alias("question")).agg(F.collect_list(F.struct("job_id", "rank")).alias("jobs"))
    return ids.join(answers, "question").select("query_id", F.inline("jobs")).withColumn("vector_distance", F.lit(0.0))
