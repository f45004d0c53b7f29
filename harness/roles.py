"""The given tables as star schema, documents, requests and messages.

Each role exists twice: as a DataFrame and as an SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from careerlake.model import Star
from careerlake.plans import search

BASE_URL = "https://jobs.example.com"

# Salary, date and years texts given to the jobs in turn.
SALARY_TEXTS = [
    "Thương lượng", "Thương lượng 10 triệu", "10 - 20 triệu", "10 triệu", "12.5 triệu",
    "15tr-20tr", "$1,000 - $2,000", "Từ 500 USD", "Up to 2000 USD",
    "15,000,000 - 20,000,000 VND", "15.000.000 - 20.000.000", "Trên 15,000,000 VND",
    "240 triệu/năm", "1000 - 2000 (Ẩn)", "Từ 15", "7 - 8", "600000000", "500000000",
    "500000", "499999", "abc", "", None,
]
YEARS_TEXTS = ["Không yêu cầu", "3 năm", "1 - 3 năm", "abc", None, "", "12 years"]

# What these texts mean, worked by hand in the same order (fixed values): the amount read, the amount
# kept, and the years. Of the oddities, 12.5 has 5 as its second number, dots part 15.000.000 into 15.000
# and 000, "Trên" holds the sign of millions, and all digits of a text make its years.
SALARY_AMOUNTS = [
    0, 0, 15_000_000, 10_000_000, 8_750_000, 17_500_000, 37_500_000, 12_500_000, 50_000_000,
    17_500_000, 8, 15_000_000_000_000, 20_000_000, 1_500, 15, 8, 600_000_000, 500_000_000,
    500_000, 499_999, 0, 0, 0,
]
SALARIES_KEPT = [
    0, 0, 15_000_000, 10_000_000, 8_750_000, 17_500_000, 37_500_000, 12_500_000, 50_000_000,
    17_500_000, 8_000_000, 0, 20_000_000, 0, 15_000_000, 8_000_000, 0, 500_000_000,
    500_000, 0, 0, 0, 0,
]
YEARS = [0, 3, 13, 0, 0, 0, 12]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once, not in every query."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def pick(texts: list, key: Column) -> Column:
    """The text at position ``key`` modulo the number of texts."""
    values = F.array(*[F.lit(t).cast("string") for t in texts])
    return F.element_at(values, (key % len(texts) + 1).cast("int"))


def sql_pick(texts: list, key: str) -> str:
    listed = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts)
    return f"([{listed}])[CAST({key} % {len(texts)} + 1 AS INT)]"


def sql_number(values: list[int], key: str, kind: str) -> str:
    return f"CAST({values}[CAST({key} % {len(values)} + 1 AS INT)] AS {kind})"


# --- star -------------------------------------------------------------------------


def fact(spark, sf) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"),
        F.col("c_nationkey").cast("bigint").alias("industry_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("crawled_at"))


def details(spark, sf, texts: bool = False, expiry: bool = False, titles: bool = False
            ) -> DataFrame:
    """Job details; titles, long texts and expiry dates only where a query asks for them."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.alias("job_id"), F.col("o_orderpriority").alias("job_level"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0))
        .otherwise(F.round("o_totalprice").cast("bigint")).alias("salary_numeric"),
        (key % 16).cast("int").alias("years_of_experience"),
        F.col("o_orderdate").cast("date").alias("posted_date"),
        pick(SALARY_TEXTS, key).alias("salary_text"),
        F.concat(F.lit(BASE_URL + "/"), key.cast("string"), F.lit("-jv")).alias("job_url"),
        F.lit(None).cast("string").alias("job_description"),
        F.lit("").alias("job_benefits"))
    if expiry:
        shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
            F.max("l_shipdate").cast("date").alias("expiry_date"))
        rows = rows.join(shipped, "job_id", "left")
    else:
        rows = rows.withColumn("expiry_date", F.lit(None).cast("date"))
    empty = F.lit(None).cast("string")
    if titles or texts:
        part = table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), "p_name")
        rows = rows.join(part, "job_id", "left").withColumn(
            "job_title", F.coalesce("p_name", "job_level")).drop("p_name")
    else:
        rows = rows.withColumn("job_title", empty)
    if not texts:
        return rows.withColumn("job_requirements", empty)
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("job_requirements"))
    return rows.join(documents, "job_id", "left")


def _items(spark, sf, name: str, out: str) -> DataFrame:
    items = table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select(F.col("l_orderkey").alias("job_id"), F.col(name).alias(out)).distinct()


def locations(spark, sf) -> DataFrame:
    places = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return table(spark, sf, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("job_id"), F.col("n_name").alias("location_name")).distinct()


def star(spark, sf, texts: bool = False, expiry: bool = False, titles: bool = False) -> Star:
    empty = F.lit(None).cast("string")
    return Star(
        fact_job_postings=fact(spark, sf),
        dim_job_details=details(spark, sf, texts, expiry, titles),
        dim_companies=table(spark, sf, "customer").select(
            F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"),
            F.col("c_mktsegment").alias("description"), empty.alias("logo_url"),
            empty.alias("profile_url")),
        dim_industries=table(spark, sf, "nation").select(
            F.col("n_nationkey").cast("bigint").alias("industry_id"),
            F.col("n_name").alias("industry_name")),
        dim_locations=locations(spark, sf),
        dim_skills=_items(spark, sf, "p_brand", "skill_name"),
        dim_categories=_items(spark, sf, "p_type", "category_name"),
    )


CTES = {
    "fact": """SELECT o_orderkey AS job_id, o_custkey AS company_id,
        CAST(c_nationkey AS BIGINT) AS industry_id, o_orderdate AS crawled_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "jd": f"""SELECT o_orderkey AS job_id, o_orderpriority AS job_level,
        CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) END
          AS salary_numeric,
        CAST(o_orderkey % 16 AS INT) AS years_of_experience,
        CAST(o_orderdate AS DATE) AS posted_date, e.expiry_date,
        coalesce(p_name, o_orderpriority) AS job_title,
        {sql_pick(SALARY_TEXTS, 'o_orderkey')} AS salary_text,
        '{BASE_URL}/' || o_orderkey || '-jv' AS job_url,
        CAST(NULL AS VARCHAR) AS job_description, text AS job_requirements,
        '' AS job_benefits
        FROM orders
        LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS expiry_date
                   FROM lineitem GROUP BY 1) e ON o_orderkey = l_orderkey
        LEFT JOIN part ON p_partkey = o_orderkey
        LEFT JOIN documents ON doc_id = o_orderkey""",
    "co": "SELECT c_custkey AS company_id, c_name AS company_name FROM customer",
    "ind": "SELECT CAST(n_nationkey AS BIGINT) AS industry_id, n_name AS industry_name FROM nation",
    "sk": """SELECT DISTINCT l_orderkey AS job_id, p_brand AS skill_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cat": """SELECT DISTINCT l_orderkey AS job_id, p_type AS category_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "loc": """SELECT DISTINCT l_orderkey AS job_id, n_name AS location_name
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "base": """SELECT f.job_id, f.company_id, d.*  EXCLUDE (job_id), i.industry_name, c.category_name
        FROM fact f JOIN jd d ON f.job_id = d.job_id
        LEFT JOIN ind i ON f.industry_id = i.industry_id
        LEFT JOIN cat c ON f.job_id = c.job_id""",
}


def with_star(body: str) -> str:
    """An SQL statement over the star's common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in CTES.items()) + "\n" + body


# --- job documents ----------------------------------------------------------------


def _benefit(local: Column, name: Column, value: Column) -> Column:
    return F.struct(local.alias("benefitNameVI"), name.alias("benefitName"),
                    value.alias("benefitValue"))


def job_documents(spark, sf) -> DataFrame:
    """Every order as a nested posting."""
    key = F.col("o_orderkey")
    head = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    text = key.cast("string")
    items = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("place_key"), F.col("n_name").alias("place")),
            F.col("s_nationkey") == F.col("place_key"))
        .groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.collect_list(F.struct("p_brand", "place", "p_type")).alias("items"))
    )
    # Each item is moved once, without the fixed texts of its entries.
    skills = F.transform("items", lambda x: F.struct(x["p_brand"].alias("skillName")))
    places = F.transform("items", lambda x: F.struct(
        x["place"].alias("cityNameVI"), F.lit("address").alias("address")))
    children = F.transform("items", lambda x: F.struct(
        F.lit("").alias("nameVI"), x["p_type"].alias("name")))
    parent = F.when(key % 9 != 0, F.col("n_name"))
    return head.join(items, "o_orderkey", "left").select(
        text.alias("jobId"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "https://other.example.com/x")
        .otherwise(F.concat(F.lit("/jobs/"), text)).alias("jobUrl"),
        F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("-"))).alias("alias"),
        F.col("o_orderpriority").alias("jobTitle"),
        F.col("o_custkey").alias("companyId"), F.col("c_name").alias("companyName"),
        F.col("c_mktsegment").alias("companyProfile"),
        F.lit(None).cast("string").alias("companyLogo"),
        F.lit("").alias("salary"),
        pick(["", "Thương lượng", "10 - 20 triệu", None], key).alias("prettySalaryVI"),
        pick(["Negotiable", "", "", "", ""], key).alias("prettySalary"),
        F.when(key % 7 < 3, key).otherwise(F.lit(0)).alias("salaryMin"),
        F.when(key % 11 < 5, key * 2).alias("salaryMax"),
        F.when(key % 6 == 0, False).when(key % 6 > 1, True).alias("isSalaryVisible"),
        F.col("o_orderstatus").alias("jobLevelVI"),
        F.concat(F.lit("<p>"), "c_mktsegment", F.lit("</p>")).alias("jobDescription"),
        F.lit(None).cast("string").alias("jobRequirement"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("approvedOn"),
        F.lit("").alias("expiredOn"),
        (key % 16).cast("int").alias("yearsOfExperience"),
        F.array(
            _benefit(F.col("o_orderstatus"), F.lit(""), F.col("o_orderpriority")),
            _benefit(F.lit(""), F.col("c_mktsegment"), F.lit("")),
            _benefit(F.lit(""), F.lit(""), F.lit("unnamed")),
        ).alias("benefits"),
        skills.alias("skills"), places.alias("workingLocations"),
        F.struct(parent.alias("parentNameVI"), F.lit("").alias("parentName"),
                 children.alias("children")).alias("jobFunction"),
    )


# --- search -----------------------------------------------------------------------


def search_documents(spark, sf) -> DataFrame:
    """Every document that has a vector, as a vectorized job."""
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("chunk_text"))
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")
    return search.search_documents(star(spark, sf, titles=True), documents.join(stored, "job_id"))


def centroids(spark, sf) -> DataFrame:
    """Mean vector of each label."""
    values = table(spark, sf, "embeddings").select("label", F.posexplode("embedding"))
    means = values.groupBy("label", "pos").agg(F.avg("col").alias("mean"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"])
        .alias("embedding"))


def requests(spark, sf) -> DataFrame:
    """Every benchmark item as a search request; places and titles vary by item."""
    key = F.col("item_id")
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    items = table(spark, sf, "benchmark").join(titles, "item_id").withColumn(
        "label", (key % 10).cast(table(spark, sf, "embeddings").schema["label"].dataType))
    first_word = F.substring_index("p_name", " ", 1)
    return items.join(centroids(spark, sf), "label").select(
        key.alias("query_id"), F.col("text").alias("user_query"), F.lit("").alias("cv_text"),
        F.when(key % 5 == 4, F.lit("")).otherwise(F.col("p_name")).alias("job_title"),
        F.when(key % 4 == 1, F.array(first_word))
        .when(key % 4 == 2, F.array(F.lit("The")))
        .when(key % 4 == 3, F.array(F.lit(" Nowhere Land "), F.lit("nll")))
        .otherwise(F.array().cast("array<string>")).alias("locations"),
        "embedding")


SEARCH_CTES = {
    "docs": f"""SELECT d.doc_id AS job_id, p_name AS job_title, c_name AS company_name,
        {sql_pick(SALARY_TEXTS, 'd.doc_id')} AS salary_text,
        '{BASE_URL}/' || d.doc_id || '-jv' AS job_url, d.text AS chunk_text,
        CAST(e.embedding AS DOUBLE[]) AS embedding
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
        JOIN part ON p_partkey = d.doc_id JOIN orders ON o_orderkey = d.doc_id
        JOIN customer ON o_custkey = c_custkey""",
    "means": """SELECT label, i, avg(CAST(v AS DOUBLE)) AS mean FROM (
          SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i
          FROM embeddings) GROUP BY label, i""",
    "centroids": "SELECT label, list(mean ORDER BY i) AS embedding FROM means GROUP BY label",
    "requests": """SELECT item_id AS query_id, text AS user_query,
        CASE WHEN item_id % 5 = 4 THEN '' ELSE lower(p_name) END AS wanted,
        CASE item_id % 4 WHEN 1 THEN [lower(split_part(p_name, ' ', 1))] WHEN 2 THEN ['the']
             WHEN 3 THEN ['nowhere land', 'nll'] ELSE CAST([] AS VARCHAR[]) END AS places,
        c.embedding AS wanted_vector
        FROM benchmark JOIN part ON p_partkey = item_id
        JOIN centroids c ON c.label = item_id % 10""",
}


def with_search(body: str, more: dict[str, str] | None = None) -> str:
    ctes = SEARCH_CTES | (more or {})
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n" + body


# --- conversations ----------------------------------------------------------------


def messages(spark, sf) -> DataFrame:
    """Conversations; a system text serves as the attachment."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.when(F.col("role") == "system", F.col("text")).otherwise(F.lit("")).alias("cv_text"))


MESSAGES = """SELECT conv_id, turn, role, text AS content,
    CASE WHEN role = 'system' THEN text ELSE '' END AS cv_text FROM conversations"""
