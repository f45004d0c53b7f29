"""Parsers, text cleaning and flattening over the given tables, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from careerlake.functions import display, parsing, text
from careerlake.operators import flatten as flat_ops
from careerlake.operators.keys import new_keys
from careerlake.model import WAREHOUSE
from careerlake.plans.transform import rejected_keys
from careerlake.plans.vectorize import chunk_text, wide_rows
from careerlake.functions.wordlists import CHUNK_STOP_WORDS
from harness import roles
from harness.roles import (
    SALARIES_KEPT, SALARY_AMOUNTS, SALARY_TEXTS, YEARS, YEARS_TEXTS, pick, sql_number, sql_pick, table, with_star,
)

# --- staging parsers --------------------------------------------------------------


def _salaries(spark, sf):
    texts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), pick(SALARY_TEXTS, F.col("o_orderkey")).alias("t"))
    amount = parsing.salary_amount(F.col("t"))
    return texts.select("job_id", F.col("t").alias("salary_text"), amount.alias("amount"))


def salary_normalize(spark, sf):
    return _salaries(spark, sf).select(
        "job_id", parsing.plausible_salary(F.col("amount")).alias("salary_numeric"))


def experience_parse(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("job_id"),
        parsing.years_required(pick(YEARS_TEXTS, key)).alias("years_of_experience"))


def date_parse(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = (
        F.when(key % 5 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 5 == 1, F.date_format(day, "d/M/yyyy"))
        .when(key % 5 == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 3, F.lit("")).otherwise(F.lit("unknown")))
    loaded = F.when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit(""))
    return table(spark, sf, "orders").select(
        key.alias("job_id"), parsing.any_date(written).alias("posted_date"),
        parsing.timestamp_text(loaded).alias("crawled_at"))


_KEY_FORMS = ["{k}", "{k}.0", "", "x{k}", "nan", "null"]


def _key_texts(spark, sf):
    key = F.col("o_orderkey")
    forms = [F.replace(F.lit(f), F.lit("{k}"), key.cast("string")) for f in _KEY_FORMS]
    at = (key % len(forms) + 1).cast("int")
    raw = F.element_at(F.array(*forms), at)
    return table(spark, sf, "orders").select(text.scrub_null_tokens(raw).alias("job_id"))


def key_clean(spark, sf):
    kept = _key_texts(spark, sf).filter("job_id != ''").select(
        parsing.key_number(F.col("job_id")).alias("job_id"))
    return kept.dropna()


def key_rejects(spark, sf):
    return rejected_keys({"fact_job_postings": _key_texts(spark, sf)})


def html_strip(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.flat_line(text.strip_tags(F.col("html"))).alias("plain"))


def normalize_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("normalized"),
        F.length(text.normalize_query(F.col("text"))).cast("bigint").alias("query_length"))


def output_text(spark, sf):
    """Clipped, capitalized and defaulted values as reports show them."""
    return table(spark, sf, "documents").select(
        "doc_id", text.clip(F.col("text"), 800).alias("shown"),
        display.word_label(F.col("source")).alias("label"),
        display.blank(F.when(F.col("lang") != "en", F.col("lang"))).alias("other_lang"),
        text.session_title(F.col("text")).alias("title"))


# --- flattening -------------------------------------------------------------------

_FLAT = ["job_id", "title", "company", "salary", "level", "description", "requirements",
         "benefits", "posted_date", "expired_date", "industry", "exp", "comp_desc", "logo",
         "job_url", "profile_url"]


def flatten_docs(spark, sf):
    return flat_ops.flatten(roles.job_documents(spark, sf), roles.BASE_URL).select(*_FLAT)


def bridge_rows(spark, sf):
    flat = flat_ops.flatten(roles.job_documents(spark, sf), roles.BASE_URL)
    return flat_ops.bridges(flat, ["provinces", "skills", "categories"], "name")


def surrogate_keys(spark, sf):
    """Company keys in the order in which the newest-first feed mentions them."""
    seen = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("value"), F.unix_micros(F.col("o_orderdate").cast("timestamp"))
        .alias("at"), "o_orderkey")
    known = spark.createDataFrame([], WAREHOUSE["key_companies"])
    return new_keys(seen, known, [-F.col("at"), F.col("o_orderkey")])


def first_seen(spark, sf):
    """First posting of each company in feed order."""
    from careerlake.operators.merge import one_per_key

    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("job_id"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    return one_per_key(rows, ["company_id"], [-F.col("day"), F.col("job_id")]).select(
        "company_id", "job_id")


def newest_unseen(spark, sf):
    """Newest postings of the feed that are not among the shipped orders."""
    docs = flat_ops.flatten(roles.job_documents(spark, sf), roles.BASE_URL)
    known = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("job_id")).distinct()
    return flat_ops.unseen_postings(docs, known, 100).select("job_id", "posted_date")


def wide(spark, sf):
    rows = wide_rows(roles.star(spark, sf, texts=True, expiry=True))
    return rows.drop("job_description")


def chunks(spark, sf):
    rows = wide_rows(roles.star(spark, sf, texts=True))
    return rows.select("job_id", text.normalize(chunk_text()).alias("chunk_text"))


QUERIES = {
    "salary_parse": _salaries,
    "salary_normalize": salary_normalize,
    "experience_parse": experience_parse,
    "date_parse": date_parse,
    "key_clean": key_clean,
    "key_rejects": key_rejects,
    "html_strip": html_strip,
    "normalize_text": normalize_text,
    "output_text": output_text,
    "flatten_docs": flatten_docs,
    "bridge_rows": bridge_rows,
    "surrogate_keys": surrogate_keys,
    "first_seen": first_seen,
    "newest_unseen": newest_unseen,
    "wide_rows": wide,
    "chunk_text": chunks,
}

# --- SQL --------------------------------------------------------------------------

_KEYS = """SELECT CASE WHEN raw IN ('nan', 'None', 'null') THEN '' ELSE raw END AS raw FROM (
    SELECT CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || '' WHEN 1 THEN o_orderkey || '.0'
      WHEN 2 THEN '' WHEN 3 THEN 'x' || o_orderkey WHEN 4 THEN 'nan' ELSE 'null' END AS raw
    FROM orders)"""

_STOPS = ", ".join(f"'{w}'" for w in CHUNK_STOP_WORDS)


def sql_normalize(value: str) -> str:
    spaced = (f"trim(regexp_replace(regexp_replace(lower({value}), "
              f"'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
    return (f"array_to_string(list_filter(string_split({spaced}, ' '), "
            f"lambda w: w <> '' AND replace(w, '_', ' ') NOT IN ({_STOPS})), ' ')")


_DOCS = """SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o.*, c.*, n_name
    FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

_WIDE = """SELECT f.job_id, job_title, company_name, c_mktsegment AS company_description,
    industry_name, salary_text, job_level, years_of_experience, posted_date, expiry_date,
    job_requirements, job_benefits,
    coalesce((SELECT string_agg(location_name, ', ' ORDER BY location_name) FROM loc
              WHERE loc.job_id = f.job_id), 'Không xác định') AS locations,
    coalesce((SELECT string_agg(skill_name, ', ' ORDER BY skill_name) FROM sk
              WHERE sk.job_id = f.job_id), 'Không xác định') AS skills
    FROM fact f JOIN jd ON f.job_id = jd.job_id JOIN co ON f.company_id = co.company_id
    JOIN customer ON c_custkey = co.company_id JOIN ind ON f.industry_id = ind.industry_id"""

_CHUNK = """'vị trí ' || coalesce(job_title, 'None') || ' cấp bậc ' || coalesce(job_level, 'None')
    || ' công ty ' || coalesce(company_name, 'None') || ' địa điểm ' || locations
    || ' ngành nghề ' || coalesce(industry_name, 'None') || ' lương '
    || coalesce(salary_text, 'None') || ' kinh nghiệm ' || coalesce(years_of_experience || '', 'None')
    || ' kỹ năng ' || skills || ' phúc lợi ' || coalesce(job_benefits, 'None')
    || ' mô tả None yêu cầu ' || coalesce(job_requirements, 'None')"""

ORACLE = {
    "salary_parse": f"""SELECT o_orderkey AS job_id, {sql_pick(SALARY_TEXTS, 'o_orderkey')} AS salary_text,
        {sql_number(SALARY_AMOUNTS, 'o_orderkey', 'BIGINT')} AS amount FROM orders""",
    "salary_normalize": f"""SELECT o_orderkey AS job_id,
        {sql_number(SALARIES_KEPT, 'o_orderkey', 'BIGINT')} AS salary_numeric FROM orders""",
    "experience_parse": f"""SELECT o_orderkey AS job_id,
        {sql_number(YEARS, 'o_orderkey', 'INT')} AS years_of_experience FROM orders""",
    "date_parse": """SELECT o_orderkey AS job_id,
        CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS posted_date,
        CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) END
          AS crawled_at FROM orders""",
    "key_clean": f"""SELECT TRY_CAST(replace(raw, '.0', '') AS BIGINT) AS job_id FROM ({_KEYS})
        WHERE raw <> '' AND TRY_CAST(replace(raw, '.0', '') AS BIGINT) IS NOT NULL""",
    "key_rejects": f"""SELECT 'fact_job_postings' AS table_name, 'job_id' AS key_column, raw AS value
        FROM ({_KEYS}) WHERE raw <> '' AND TRY_CAST(replace(raw, '.0', '') AS BIGINT) IS NULL""",
    "html_strip": """SELECT page_id,
        replace(trim(regexp_replace(html, '<[^>]*>', ' ', 'g')), chr(10), ' ') AS plain FROM pages""",
    "normalize_text": f"""SELECT doc_id, {sql_normalize('text')} AS normalized,
        length({sql_normalize('text')}) AS query_length FROM documents""",
    "output_text": """SELECT doc_id, substr(text, 1, 800) AS shown,
        upper(source[1]) || lower(source[2:]) AS label,
        CASE WHEN lang <> 'en' THEN lang ELSE '' END AS other_lang,
        array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:6], ' ')
          || '...' AS title FROM documents""",
    "flatten_docs": f"""SELECT id AS job_id, o_orderpriority AS title, c_name AS company,
        CASE WHEN NOT visible AND shown <> 'Thương lượng' THEN shown || ' (Ẩn)' ELSE shown END AS salary,
        o_orderstatus AS level, '<p>' || c_mktsegment || '</p>' AS description, '' AS requirements,
        '- ' || o_orderstatus || ': ' || o_orderpriority || chr(10) || '- ' || c_mktsegment AS benefits,
        strftime(o_orderdate, '%Y-%m-%d') AS posted_date, '' AS expired_date,
        CASE WHEN k % 9 = 0 THEN 'Khác' ELSE n_name END AS industry,
        CASE WHEN k % 16 > 0 THEN (k % 16) || ' năm' ELSE 'Không yêu cầu' END AS exp,
        c_mktsegment AS comp_desc, '' AS logo,
        CASE k % 3 WHEN 1 THEN 'https://other.example.com/x'
          WHEN 0 THEN '{roles.BASE_URL}/' || lower(replace(o_orderpriority, ' ', '-')) || '-' || id || '-jv'
          ELSE '{roles.BASE_URL}/jobs/' || id END AS job_url,
        CASE WHEN o_custkey <> 0 THEN '{roles.BASE_URL}/nha-tuyen-dung/c' || o_custkey ELSE '' END
          AS profile_url
      FROM (SELECT *, k % 6 <> 0 AS visible, CASE
          WHEN k % 4 = 2 THEN '10 - 20 triệu'
          WHEN k % 7 < 3 AND k > 0 AND k % 11 < 5 THEN k || ' - ' || (k * 2)
          WHEN k % 7 < 3 AND k > 0 THEN 'Từ ' || k
          WHEN k % 11 < 5 AND k > 0 THEN 'Đến ' || (k * 2)
          ELSE 'Thương lượng' END AS shown FROM ({_DOCS}))""",
    "bridge_rows": """SELECT DISTINCT 'provinces' AS bridge, CAST(l_orderkey AS VARCHAR) AS job_id,
          n_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
          JOIN nation ON s_nationkey = n_nationkey JOIN orders ON o_orderkey = l_orderkey
        UNION ALL SELECT 'skills', CAST(l_orderkey AS VARCHAR), p_brand FROM lineitem
          JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
          JOIN orders ON o_orderkey = l_orderkey
        UNION ALL SELECT 'categories', CAST(l_orderkey AS VARCHAR), p_type FROM lineitem
          JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
          JOIN orders ON o_orderkey = l_orderkey""",
    "surrogate_keys": """SELECT c_name AS value, row_number() OVER (ORDER BY seen DESC, k) AS id FROM (
          SELECT c_name, o_orderdate AS seen, o_orderkey AS k, row_number() OVER (
            PARTITION BY c_name ORDER BY o_orderdate DESC, o_orderkey) AS r
          FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r = 1""",
    "first_seen": """SELECT company_id, job_id FROM (
          SELECT o_custkey AS company_id, o_orderkey AS job_id, row_number() OVER (
            PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS r
          FROM orders) WHERE r = 1""",
    "newest_unseen": """SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
          strftime(o_orderdate, '%Y-%m-%d') AS posted_date
        FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
        ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 100""",
    "wide_rows": with_star(_WIDE),
    "chunk_text": with_star(f"SELECT job_id, {sql_normalize(_CHUNK)} AS chunk_text FROM ({_WIDE})"),
}
