"""Dedupe, write modes and quality rules over the given tables, with SQL checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlake.operators import merge, quality
from harness import roles
from harness.roles import table, with_star


def dedupe_latest(spark, sf):
    """One line per order and line number, the earliest shipped."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"),
        "l_partkey", "l_suppkey", "l_extendedprice")
    return merge.one_per_key(lines, ["l_orderkey", "l_linenumber"], [F.col("shipped")])


def _orders(spark, sf, note: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"),
        F.round("o_totalprice").cast("bigint").alias("salary_numeric"),
        F.lit(note).alias("note"))


def insert_if_absent(spark, sf):
    """Orders that are not open are known; the whole feed arrives twice."""
    current = _orders(spark, sf, "known").filter("status != 'O'")
    incoming = _orders(spark, sf, "first").unionByName(_orders(spark, sf, "second"))
    return merge.insert_if_absent(current, incoming, ["job_id"], [F.col("note")])


def partial_upsert(spark, sf):
    current = _orders(spark, sf, "known").filter("status != 'O'")
    incoming = _orders(spark, sf, "new").filter("status != 'F'").withColumn(
        "salary_numeric", F.col("salary_numeric") * 2)
    return merge.upsert_columns(current, incoming, ["job_id"], ["salary_numeric"])


def full_upsert(spark, sf):
    current = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("job_id"), F.lit("old").alias("chunk_text"))
    incoming = table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("chunk_text"))
    return merge.upsert_rows(current, incoming, ["job_id"])


def cascade_delete(spark, sf):
    """Delete the pending orders together with their lines."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    left = merge.delete_cascade(
        {"orders": orders, "lineitem": lines, "customer": table(spark, sf, "customer")},
        {"orders": "o_orderkey", "lineitem": "l_orderkey"},
        orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job_id")), "job_id")
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey"}
    return reduce(DataFrame.unionByName, [
        df.groupBy(F.col(keys[name]).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("table_name"), "key", "n") for name, df in left.items()])


def dq_report(spark, sf):
    star = roles.star(spark, sf, expiry=True)
    return quality.quality_report(star.fact_job_postings, star.dim_job_details, star.dim_companies)


def dq_repeats(spark, sf):
    """The uniqueness rule on order lines, which do hold surplus copies."""
    return quality.surplus_copies(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def dq_orphans(spark, sf):
    """The foreign-key rule: orders without any line."""
    return quality.orphan_rows(table(spark, sf, "orders"), "o_orderkey",
                               table(spark, sf, "lineitem"), "l_orderkey")


def dq_constraints(spark, sf):
    """All keys of the schema; of the stored vectors some have no job, and some repeat an id."""
    stored = table(spark, sf, "embeddings").select(
        (F.col("vec_id") - F.col("vec_id") % 5).alias("job_id"), F.lit("").alias("chunk_text"), "embedding")
    return quality.constraint_report(roles.star(spark, sf).tables() | {"dim_job_vectors": stored})


QUERIES = {
    "dedupe_latest": dedupe_latest,
    "insert_if_absent": insert_if_absent,
    "partial_upsert": partial_upsert,
    "full_upsert": full_upsert,
    "cascade_delete": cascade_delete,
    "dq_report": dq_report,
    "dq_repeats": dq_repeats,
    "dq_orphans": dq_orphans,
    "dq_constraints": dq_constraints,
}

_M = quality.RULES


def _no_key(name: str, keys: list[str], source: str) -> str:
    missing = " OR ".join(f"{k} IS NULL" for k in keys)
    cols = ", ".join(keys)
    return f"""SELECT '{name}.key_is_null' AS rule_id,
          CAST(count(*) FILTER ({missing}) AS BIGINT) AS fail_count FROM {source}
        UNION ALL SELECT '{name}.key_is_repeated',
          CAST(count(*) - count(DISTINCT ({cols})) AS BIGINT) FROM {source}"""


def _no_parent(name: str, key: str, child: str, parent: str) -> str:
    return f"""SELECT '{name}.{key}.no_parent', CAST(count(*) AS BIGINT) FROM {child} x
        WHERE NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{key} = x.{key})"""


_CONSTRAINTS = "\nUNION ALL\n".join([
    _no_key("fact_job_postings", ["job_id"], "fact"),
    _no_key("dim_job_details", ["job_id"], "jd"),
    _no_key("dim_companies", ["company_id"], "co"),
    _no_key("dim_industries", ["industry_id"], "ind"),
    _no_key("dim_locations", ["job_id", "location_name"], "loc"),
    _no_key("dim_skills", ["job_id", "skill_name"], "sk"),
    _no_key("dim_categories", ["job_id", "category_name"], "cat"),
    _no_parent("fact_job_postings", "job_id", "fact", "jd"),
    _no_parent("fact_job_postings", "company_id", "fact", "co"),
    _no_parent("fact_job_postings", "industry_id", "fact", "ind"),
    _no_parent("dim_locations", "job_id", "loc", "jd"),
    _no_parent("dim_skills", "job_id", "sk", "jd"),
    _no_parent("dim_categories", "job_id", "cat", "jd"),
    _no_key("dim_job_vectors", ["job_id"], "vec"),
    _no_parent("dim_job_vectors", "job_id", "vec", "jd"),
])

ORACLE = {
    "dedupe_latest": """SELECT l_orderkey, l_linenumber, shipped, l_partkey, l_suppkey, l_extendedprice
        FROM (SELECT *, CAST(l_shipdate AS DATE) AS shipped, row_number() OVER (
                PARTITION BY l_orderkey, l_linenumber
                ORDER BY CAST(l_shipdate AS DATE), l_partkey, l_suppkey, l_extendedprice) AS r
              FROM lineitem) WHERE r = 1""",
    "insert_if_absent": """SELECT o_orderkey AS job_id, o_orderstatus AS status,
        CAST(round(o_totalprice) AS BIGINT) AS salary_numeric,
        CASE WHEN o_orderstatus <> 'O' THEN 'known' ELSE 'first' END AS note FROM orders""",
    "partial_upsert": """SELECT o_orderkey AS job_id, o_orderstatus AS status,
        CAST(round(o_totalprice) AS BIGINT) * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END
          AS salary_numeric,
        CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'known' END AS note FROM orders""",
    "full_upsert": """SELECT coalesce(doc_id, vec_id) AS job_id, coalesce(text, 'old') AS chunk_text
        FROM embeddings FULL JOIN documents ON vec_id = doc_id""",
    "cascade_delete": """SELECT 'orders' AS table_name, o_orderkey AS key, count(*) AS n FROM orders
          WHERE o_orderstatus <> 'P' GROUP BY 2
        UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem
          WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 2
        UNION ALL SELECT 'customer', c_custkey, count(*) FROM customer GROUP BY 2""",
    "dq_report": with_star(f"""
        SELECT 'PK_NULL_CHECK' AS rule_id, '{_M['PK_NULL_CHECK']}' AS message,
          (SELECT count(*) FROM fact WHERE job_id IS NULL OR company_id IS NULL) AS fail_count
        UNION ALL SELECT 'DUPLICATE_JOB_CHECK', '{_M['DUPLICATE_JOB_CHECK']}',
          (SELECT count(job_id) - count(DISTINCT job_id) FROM jd)
        UNION ALL SELECT 'ORPHAN_COMPANY_CHECK', '{_M['ORPHAN_COMPANY_CHECK']}',
          (SELECT count(*) FROM fact LEFT JOIN co USING (company_id) WHERE co.company_id IS NULL)
        UNION ALL SELECT 'NEGATIVE_SALARY_CHECK', '{_M['NEGATIVE_SALARY_CHECK']}',
          (SELECT count(*) FROM jd WHERE salary_numeric < 0)
        UNION ALL SELECT 'LOGICAL_DATE_CHECK', '{_M['LOGICAL_DATE_CHECK']}',
          (SELECT count(*) FROM jd WHERE posted_date > expiry_date)"""),
    "dq_repeats": """SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT)
        AS fail_count FROM lineitem""",
    "dq_orphans": """SELECT count(*) AS fail_count FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "dq_constraints": with_star(_CONSTRAINTS.replace(
        "FROM vec", "FROM (SELECT vec_id - vec_id % 5 AS job_id FROM embeddings)")),
}
