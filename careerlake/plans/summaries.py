"""Mergeable summaries of the star, and dashboard reports that read nothing else.

A summary holds sets of jobs as bitmaps: one for every value of a dimension and every 32,768 job
ids, so rows grow with the values times the id range and not with the jobs. Numbers are kept as bit
slices, bitmaps of the jobs whose number has a certain bit, from which sums come out exact. Reports
intersect the bitmaps of the chosen filters and of their groups, and count bits: distinct jobs, as
every job is one bit. Companies are one narrow row per posting, found from the bits of the jobs.

Each load appends the summary of its own jobs; bitmaps of several loads are united on reading. So
a job may be added twice, but a job whose values have changed needs its summary made anew.

Bitmaps are built from 64-bit words: the entries of a bucket come together as narrow rows, words are
an ordinary hash aggregate of them, and a group has at most 512. So no bitmap is made for the few bits
that one task sees of a group, and tasks hold words of their own buckets only.

Names that are null form a group of their own, as in the reports over the star. Job ids must not be
null, and a posting without company counts for none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.functions import display
from careerlake.functions.text import cloud_tokens
from careerlake.model import Star
from careerlake.plans import dashboard
from careerlake.plans.star import ALL, Filters, matching_jobs, with_category_count
from careerlake.session import checkpointed

_NUMBERS = ["salary_numeric", "years_of_experience"]
_CELL = ["level", "category", "industry", "location"]
_OWN = ["level", "industry"]  # filters that a posting's own row answers; the others go by job
_WORDS, _WORD = 512, 64  # words of a bitmap, and bits of a word


@dataclass(frozen=True)
class Summaries:
    """``jobs(dimension, value, bucket, bits)`` and ``companies(level, industry, bucket, position, company_id)``."""

    jobs: DataFrame
    companies: DataFrame

    def append(self, path: str) -> None:
        """Add to the summaries kept at a path."""
        self.jobs.write.mode("append").partitionBy("dimension").parquet(f"{path}/jobs")
        self.companies.write.mode("append").parquet(f"{path}/companies")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Summaries":
        return cls(
            spark.read.schema("value string, bucket bigint, bits binary, dimension string").parquet(f"{path}/jobs"),
            spark.read.parquet(f"{path}/companies"),
        )


def _bits(rows: DataFrame) -> DataFrame:
    """Bitmaps of the jobs of each entry, from ``job_id, entries``.

    The bits of a word are numbered so that its hexadecimal digits are its bytes in the bitmap.
    """
    placed = rows.select(F.bitmap_bucket_number("job_id").alias("bucket"), F.bitmap_bit_position("job_id").alias("position"), "entries")
    position = F.col("position")
    shift = (56 - F.floor(position % _WORD / 8) * 8 + position % 8).cast("int")
    words = placed.repartition("bucket").select(
        "bucket", F.floor(position / _WORD).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("bit"),
        F.inline("entries")).groupBy("bucket", "dimension", "value", "word").agg(F.bit_or("bit").alias("ones"))
    listed = words.groupBy("bucket", "dimension", "value").agg(F.array_sort(F.collect_list(F.struct("word", "ones"))).alias("words"))

    def piece(entry: Column, at: Column) -> Column:
        before = F.when(at > 0, F.get("words", at - 1)["word"]).otherwise(-1)
        return F.concat(F.repeat(F.lit("0" * 16), entry["word"] - before - 1), F.lpad(F.hex(entry["ones"]), 16, "0"))

    digits = F.array_join(F.transform("words", piece), "")
    return listed.select("dimension", "value", "bucket", F.unhex(F.rpad(digits, 16 * _WORDS, "0")).alias("bits"))


def _slices(name: str, number: Column) -> Column:
    """One entry for each bit that is set in a positive number."""
    size = F.coalesce(F.greatest(number.cast("bigint"), F.lit(0)), F.lit(0))
    ones = F.filter(F.sequence(F.lit(0), F.length(F.bin(size)) - 1), lambda k: F.call_function("shiftright", size, k).bitwiseAND(F.lit(1)) == 1)
    return F.transform(ones, lambda k: F.struct(F.lit(name).alias("dimension"), k.cast("string").alias("value")))


def summarize(star: Star) -> Summaries:
    """The summary of all jobs of a star, such as those of one load."""
    details = matching_jobs(star, Filters(), ["job_level", *_NUMBERS])
    industries = star.dim_industries.select("industry_id", F.col("industry_name").alias("industry"))
    jobs = checkpointed(
        with_category_count(star, details, Filters()).join(industries, "industry_id", "left")
        .withColumnRenamed("job_level", "level"))
    salary, years = (F.col(n) for n in _NUMBERS)

    def entry(dimension: str, value: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.cast("string").alias("value"))

    own = F.concat(
        F.array(entry("job", F.lit("")), entry("level", F.col("level")), entry("industry", F.col("industry")),
                entry("copies", F.col("copies"))),
        F.when(salary.isNotNull() & (salary != 0), F.array(entry("paid", F.signum(salary).cast("int")))).otherwise(F.array()),
        F.when(years.isNotNull(), F.array(entry("years", years))).otherwise(F.array()),
        _slices("salary", salary), _slices("loss", -salary),
    )
    ids = jobs.select("job_id")

    def listed(dimension: str, table: DataFrame, name: str) -> DataFrame:
        return table.join(ids, "job_id", "left_semi").select("job_id", F.array(entry(dimension, F.col(name))).alias("entries"))

    bridges = [("skill", star.dim_skills, "skill_name"), ("category", star.dim_categories, "category_name"),
               ("location", star.dim_locations, "location_name")]
    rows = reduce(DataFrame.unionByName, [listed(*b) for b in bridges], jobs.select("job_id", own.alias("entries")))
    employers = jobs.filter("company_id IS NOT NULL").select(
        *_OWN, F.bitmap_bucket_number("job_id").alias("bucket"), F.bitmap_bit_position("job_id").cast("int").alias("position"), "company_id")
    return Summaries(_bits(rows), employers)


def _chosen(filters: Filters) -> dict[str, str]:
    return {name: value for name in _CELL if (value := getattr(filters, name)) != ALL}


def _values(summary: Summaries, *dimensions: str) -> DataFrame:
    """The bitmaps of these dimensions over all loads."""
    return summary.jobs.filter(F.col("dimension").isin(*dimensions)).groupBy("dimension", "value", "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"))


def _selected(summary: Summaries, chosen: dict[str, str]) -> DataFrame:
    """Bitmaps of the jobs that have the chosen values."""
    asked = reduce(
        lambda a, b: a | b,
        [(F.col("dimension") == name) & (F.col("value") == value) for name, value in chosen.items()],
        F.col("dimension") == "job")
    met = _values(summary, "job", *chosen).filter(asked).groupBy("bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met"))
    return met.filter(F.col("met") == 1 + len(chosen)).drop("met")


def _meet(groups: DataFrame, other: DataFrame, labels: Sequence[str]) -> DataFrame:
    """What each group has in common with ``other`` in the same bucket; empty sets go.

    Columns that tell apart rows of one bucket must all be among the labels.
    """
    both = groups.join(other.withColumnRenamed("bits", "_other"), "bucket")
    met = both.select(*labels, "bucket", F.explode(F.array("bits", "_other")).alias("bits")).groupBy(*labels, "bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"))
    return met.filter(F.bitmap_count("bits") > 0)


def _positions(sets: DataFrame) -> DataFrame:
    """``bucket, position`` of every bit of the sets."""
    octets = sets.select("bucket", F.posexplode(F.split(F.regexp_replace(F.hex("bits"), "(..)", "$1,"), ",")).alias("octet", "digits"))
    held = octets.filter(~F.col("digits").isin("", "00")).withColumn("ones", F.conv("digits", 16, 10).cast("int"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.call_function("shiftright", F.col("ones"), k).bitwiseAND(F.lit(1)) == 1)
    return held.select("bucket", "octet", F.explode(bits).alias("k")).select("bucket", (F.col("octet") * 8 + F.col("k")).alias("position"))


def _companies(summary: Summaries, filters: Filters) -> DataFrame:
    """Distinct companies of the postings that pass the filters, as ``total_companies``."""
    chosen = _chosen(filters)
    rows = summary.companies
    for name in set(chosen) & set(_OWN):
        rows = rows.filter(F.col(name) == chosen[name])
    by_job = {name: value for name, value in chosen.items() if name not in _OWN}
    if by_job:
        rows = rows.join(_positions(_selected(summary, by_job)), ["bucket", "position"], "left_semi")
    return rows.agg(F.count_distinct("company_id").alias("total_companies"))


def _named(summary: Summaries, dimension: str, name: str) -> DataFrame:
    return _values(summary, dimension).select(F.col("value").alias(name), "bucket", "bits")


def _paid(summary: Summaries, losses: bool) -> DataFrame:
    """Bitmaps of the jobs with a salary other than 0, or above it."""
    signs = ["1", "-1"] if losses else ["1"]
    return summary.jobs.filter((F.col("dimension") == "paid") & F.col("value").isin(signs)).groupBy("bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"))


def _jobs(groups: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Distinct jobs of each group; without labels one row, 0 if there are none."""
    return groups.groupBy(*labels).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("jobs"))


def _amounts(summary: Summaries, groups: DataFrame, labels: Sequence[str], losses: bool) -> DataFrame:
    """Sum of the salaries of each group, as ``amount``."""
    kinds = ["salary", "loss"] if losses else ["salary"]
    slices = _values(summary, *kinds).select("dimension", F.col("value").alias("bit"), "bucket", "bits")
    met = _jobs(_meet(groups, slices, [*labels, "dimension", "bit"]), [*labels, "dimension", "bit"])
    worth = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").cast("int")).cast("decimal(38,0)")
    signed = F.when(F.col("dimension") == "loss", -worth).otherwise(worth)
    return met.groupBy(*labels).agg(F.sum(signed * F.col("jobs")).alias("amount"))


def _weighted(summary: Summaries, filters: Filters, groups: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Groups by how often a job counts in means: once for each of its categories."""
    if filters.category != ALL:
        return groups.withColumn("copies", F.lit("1"))
    return _meet(groups, _named(summary, "copies", "copies"), [*labels, "copies"])


def kpi(summary: Summaries, filters: Filters = Filters()) -> DataFrame:
    """Jobs, companies, mean non-zero salary and mean years, as one row."""
    selected = checkpointed(_selected(summary, _chosen(filters)))
    groups = checkpointed(_weighted(summary, filters, selected, []))
    copies = F.col("copies").cast("int")
    paid = _jobs(_meet(groups, _paid(summary, True), ["copies"]), ["copies"])
    earned = _amounts(summary, groups, ["copies"], losses=True)
    years = _jobs(_meet(groups, _named(summary, "years", "years"), ["copies", "years"]), ["copies", "years"])
    tables = [
        _jobs(selected, []).select(F.col("jobs").alias("total_jobs")),
        _companies(summary, filters),
        paid.agg(F.sum(copies * F.col("jobs")).alias("_paid")),
        earned.agg(F.sum(copies * F.col("amount")).alias("_earned")),
        years.agg((F.sum(copies * F.col("jobs") * F.col("years").cast("int")) / F.sum(copies * F.col("jobs"))).alias("avg_experience")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = [t.columns[0] for t in tables]
    row = stacked.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return row.select(
        "total_jobs", "total_companies",
        (F.col("_earned").cast("double") / F.nullif(F.col("_paid"), F.lit(0))).alias("avg_salary"), "avg_experience")


def _counted(summary: Summaries, filters: Filters, dimension: str, name: str) -> DataFrame:
    return _jobs(_meet(_named(summary, dimension, name), _selected(summary, _chosen(filters)), [name]), [name])


def top_skills(summary: Summaries, filters: Filters = Filters(), n: int = dashboard.TOP_SKILLS) -> DataFrame:
    """Skills with the most jobs (R2)."""
    return dashboard.largest(_counted(summary, filters, "skill", "skill_name"), "skill_name", n)


def level_distribution(summary: Summaries, filters: Filters = Filters()) -> DataFrame:
    """Jobs per level."""
    return dashboard.largest(_counted(summary, filters, "level", "job_level"), "job_level")


def category_salaries(summary: Summaries, filters: Filters = Filters(), n: int = dashboard.TOP_CATEGORIES) -> DataFrame:
    """Categories with the highest mean salary."""
    name = ["category_name"]
    listed = _named(summary, "category", "category_name").filter("category_name IS NOT NULL")
    if filters.category != ALL:
        listed = listed.filter(F.col("category_name") == filters.category)
    paid = _paid(summary, False)
    groups = checkpointed(_meet(_meet(listed, _selected(summary, _chosen(filters)), name), paid, name))
    means = _jobs(groups, name).join(_amounts(summary, groups, name, losses=False), name).select(
        *name, (F.col("amount").cast("double") / F.col("jobs")).alias("avg_salary"))
    return means.orderBy(F.desc("avg_salary"), F.asc("category_name")).limit(n).withColumn(
        "avg_salary_millions", display.millions(F.col("avg_salary")))


def salary_by_experience(summary: Summaries, filters: Filters = Filters(), most_years: int = dashboard.MOST_YEARS) -> DataFrame:
    """Mean salary and jobs per year of experience (R6); means are category-weighted."""
    labels = ["years_of_experience"]
    listed = _named(summary, "years", labels[0]).filter(F.col(labels[0]).cast("int") <= most_years)
    paid = _paid(summary, False)
    groups = _meet(_meet(listed, _selected(summary, _chosen(filters)), labels), paid, labels)
    weighted = checkpointed(_weighted(summary, filters, groups, labels))
    labels.append("copies")
    copies = F.col("copies").cast("int")
    per_year = _jobs(weighted, labels).join(_amounts(summary, weighted, labels, losses=False), labels).groupBy(
        F.col("years_of_experience").cast("int").alias("years_of_experience")).agg(
        (F.sum(F.col("amount") * copies).cast("double") / F.sum(F.col("jobs") * copies)).alias("avg_salary"),
        F.sum("jobs").alias("jobs"))
    return per_year.withColumn("avg_salary_millions", display.millions(F.col("avg_salary"))).orderBy(F.asc("years_of_experience"))


def treemap(summary: Summaries, filters: Filters = Filters(), industries: int = dashboard.TOP_INDUSTRIES,
            categories: int = dashboard.TREEMAP_CATEGORIES) -> DataFrame:
    """Largest categories of the largest industries (R7), with their shade."""
    listed = _named(summary, "category", "category_name").filter("category_name IS NOT NULL")
    if filters.category != ALL:
        listed = listed.filter(F.col("category_name") == filters.category)
    here = _meet(_named(summary, "industry", "industry_name").filter("industry_name IS NOT NULL"),
                 _selected(summary, _chosen(filters)), ["industry_name"])
    labels = ["industry_name", "category_name"]
    return dashboard.shaded(_jobs(_meet(here, listed, labels), labels), industries, categories)


def top_locations(summary: Summaries, filters: Filters = Filters(), n: int = dashboard.TOP_LOCATIONS) -> DataFrame:
    """Locations with the most jobs and their share among those shown."""
    counts = _counted(summary, filters, "location", "location_name").filter("location_name IS NOT NULL")
    return dashboard.shares(counts, n)


def word_sketch(texts: DataFrame, column: str, stop_words: Sequence[str], tracked: int = 100_000) -> DataFrame:
    """``state, total``: one row that stands for the words of a load.

    The state is a frequent-items sketch of at most ``tracked`` words; rows of several loads are
    kept side by side and combined on request.
    """
    words = texts.filter(F.col(column).isNotNull()).select(F.explode(cloud_tokens(F.col(column), stop_words)).alias("word"))
    return words.agg(
        F.expr(f"approx_top_k_accumulate(word, {int(tracked)})").alias("state"), F.count(F.lit(1)).alias("total"))


def top_words(sketches: DataFrame, n: int = dashboard.CLOUD_WORDS) -> DataFrame:
    """``word, n, most_error`` of the ``n`` most common words of all loads together.

    A count may be too high by ``most_error`` at most; it is exact while the loads together have
    fewer different words than the sketch tracks.
    """
    # A sketch of so many items has a table of the next power of two above 4/3 of them, and errs by
    # 3.5 parts of all words over its size at most.
    combined = sketches.agg(F.expr("approx_top_k_combine(state)").alias("state"), F.sum("total").alias("total"))
    size = F.pow(F.lit(2), F.ceil(F.log2(F.col("state.maxItemsTracked") / F.lit(0.75))))
    listed = combined.select(
        # More than asked for, so that words with equal counts can be told apart by name.
        F.explode(F.expr(f"approx_top_k_estimate(state, {10 * int(n)})")).alias("e"),
        F.ceil(F.lit(3.5) * F.col("total") / size).alias("most_error"))
    return listed.select(F.col("e.item").alias("word"), F.col("e.count").alias("n"), "most_error").orderBy(F.desc("n"), "word").limit(n)
