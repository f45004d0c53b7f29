"""Dashboard queries and their SQL checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from careerlake.plans import dashboard, summaries
from careerlake.plans.star import Filters
from careerlake.session import scratch_path
from harness import roles
from harness.roles import with_star

# Stop words of the checks: frequent words of the given texts.
STOP_WORDS = ["that", "with", "from", "this", "have", "were", "pour", "dans", "elle", "para"]

CHOSEN = Filters(industry="NATION_7", category="PROMO", level="2-HIGH", location="NATION_3")
_WHERE = """industry_name = 'NATION_7' AND category_name = 'PROMO' AND job_level = '2-HIGH'
    AND job_id IN (SELECT job_id FROM loc WHERE location_name = 'NATION_3')"""
_PLACE = Filters(location="NATION_3")
_KPI = """SELECT count(DISTINCT job_id) AS total_jobs, count(DISTINCT company_id) AS total_companies,
    avg(nullif(salary_numeric, 0)) AS avg_salary, avg(years_of_experience) AS avg_experience
    FROM base"""


def _report(function, **options):
    return lambda spark, sf: function(roles.star(spark, sf), **options)


def _labels(spark, sf):
    return dashboard.kpi_labels(dashboard.kpi(roles.star(spark, sf)))


def _sorted_options(spark, sf):
    return dashboard.sorted_options(dashboard.filter_options(roles.star(spark, sf)))


def _summary(report, **options):
    """A report over the summaries of two loads, the second of which brings half of the first again."""

    def query(spark, sf):
        star, path = roles.star(spark, sf), scratch_path(spark, "summaries")
        for jobs in (F.col("job_id") % 4 < 2, F.col("job_id") % 4 > 0):
            part = replace(star, fact_job_postings=star.fact_job_postings.filter(jobs))
            summaries.summarize(part).append(path)
        return report(summaries.Summaries.read(spark, path), **options)

    return query


def _top_words(spark, sf):
    """The most common words of all texts, out of the sketches of four loads."""
    docs, path = roles.table(spark, sf, "documents"), scratch_path(spark, "words")
    for load in range(4):
        part = docs.filter(F.col("doc_id") % 4 == load)
        summaries.word_sketch(part, "text", STOP_WORDS).write.mode("append").parquet(path)
    return summaries.top_words(spark.read.parquet(path)).select("word", "n")


QUERIES = {
    "top_words_sketch": _top_words,
    "kpi_summary": _summary(summaries.kpi),
    "kpi_summary_filtered": _summary(summaries.kpi, filters=CHOSEN),
    "top_skills_summary": _summary(summaries.top_skills, filters=_PLACE),
    "salaries_summary": _summary(summaries.salary_by_experience),
    "treemap_summary": _summary(summaries.treemap),
    "kpi": _report(dashboard.kpi),
    "kpi_unweighted": _report(dashboard.kpi, weighted=False),
    "kpi_filtered": _report(dashboard.kpi, filters=CHOSEN),
    "kpi_formatted": _labels,
    "top_skills": _report(dashboard.top_skills),
    "top_skills_by_location": _report(dashboard.top_skills, filters=_PLACE),
    "level_distribution": _report(dashboard.level_distribution),
    "top_companies": _report(dashboard.top_companies),
    "category_salaries": _report(dashboard.category_salaries),
    "salary_by_experience": _report(dashboard.salary_by_experience),
    "treemap": _report(dashboard.treemap),
    "top_locations_share": _report(dashboard.top_locations),
    "word_cloud": lambda spark, sf: dashboard.word_cloud(
        roles.star(spark, sf, texts=True), STOP_WORDS),
    "word_counts": lambda spark, sf: dashboard.word_counts(
        roles.table(spark, sf, "documents"), "text", STOP_WORDS),
    "latest_jobs": lambda spark, sf: dashboard.latest_jobs(roles.star(spark, sf, texts=True)),
    "filter_options": lambda spark, sf: dashboard.filter_options(roles.star(spark, sf)),
    "filter_options_sorted": _sorted_options,
    "dashboard_json": lambda spark, sf: dashboard.dashboard_json(
        roles.star(spark, sf, texts=True), STOP_WORDS),
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _words(text: str, weight: str, source: str) -> str:
    """Words split at non-word characters; those of 4 to 20 ASCII letters count."""
    return f"""SELECT word, CAST(sum(w) AS BIGINT) AS n FROM (
        SELECT unnest(string_split_regex(lower(regexp_replace({text}, '<[^>]+>', ' ', 'g')),
          '[^\\p{{L}}\\p{{N}}_]+')) AS word, {weight} AS w FROM {source})
        WHERE regexp_full_match(word, '[a-zA-Z_]{{4,20}}') AND word NOT IN ({_STOP})
        GROUP BY word"""


_TREEMAP = """
        SELECT industry_name, category_name, jobs, CAST(r - 1 AS INT) AS shade FROM (
          SELECT *, row_number() OVER (PARTITION BY industry_name
                                       ORDER BY jobs DESC, category_name) AS r
          FROM (SELECT industry_name, category_name, count(DISTINCT job_id) AS jobs FROM base
                WHERE industry_name IS NOT NULL AND category_name IS NOT NULL GROUP BY 1, 2)
          WHERE industry_name IN (
            SELECT industry_name FROM (
              SELECT industry_name, category_name, count(DISTINCT job_id) AS jobs FROM base
              WHERE industry_name IS NOT NULL AND category_name IS NOT NULL GROUP BY 1, 2)
            GROUP BY 1 ORDER BY sum(jobs) DESC, 1 LIMIT 5)) WHERE r <= 3"""

_JSON_PARTS = {
    "kpi": f"""SELECT {{'total_jobs': format('{{:,}}', total_jobs),
        'total_companies': format('{{:,}}', total_companies),
        'avg_salary': printf('%.1f', round(avg_salary / 1000000, 1)) || ' M',
        'avg_exp': printf('%.1f', round(avg_experience, 1)) || ' Years'}} FROM ({_KPI})""",
    "bar_skills": """SELECT {'labels': list(skill_name ORDER BY jobs DESC, skill_name),
          'data': list(jobs ORDER BY jobs DESC, skill_name)}
        FROM (SELECT skill_name, count(DISTINCT b.job_id) AS jobs FROM base b
              JOIN sk ON b.job_id = sk.job_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
    "pie_levels": """SELECT {'labels': list(job_level ORDER BY jobs DESC, job_level),
          'data': list(jobs ORDER BY jobs DESC, job_level)}
        FROM (SELECT job_level, count(DISTINCT job_id) AS jobs FROM base GROUP BY 1)""",
    "bar_companies": """SELECT {'labels': list(company_name ORDER BY jobs DESC, company_name),
          'data': list(jobs ORDER BY jobs DESC, company_name)}
        FROM (SELECT company_name, count(DISTINCT b.job_id) AS jobs
              FROM base b JOIN co ON b.company_id = co.company_id
              GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
    "bar_salaries": """SELECT {'labels': list(category_name ORDER BY s DESC, category_name),
          'data': list(round(s / 1000000, 1) ORDER BY s DESC, category_name)}
        FROM (SELECT category_name, avg(salary_numeric) AS s FROM base
              WHERE salary_numeric > 0 AND category_name IS NOT NULL
              GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
    "mix_exp": """SELECT {'labels': list(CAST(y AS VARCHAR) ORDER BY y), 'jobs': list(jobs ORDER BY y),
          'salary': list(round(s / 1000000, 1) ORDER BY y)}
        FROM (SELECT years_of_experience AS y, avg(salary_numeric) AS s,
                count(DISTINCT job_id) AS jobs
              FROM base WHERE salary_numeric > 0 AND years_of_experience <= 10 GROUP BY 1)""",
    "treemap": f"""SELECT list({{'industry': industry_name, 'category': category_name,
          'value': jobs}} ORDER BY industry_name, shade) FROM ({_TREEMAP})""",
    "pie_locations": """SELECT {'labels': list(location_name ORDER BY jobs DESC, location_name),
          'data': list(jobs ORDER BY jobs DESC, location_name)}
        FROM (SELECT location_name, count(DISTINCT b.job_id) AS jobs
          FROM base b JOIN loc ON b.job_id = loc.job_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""",
    "word_cloud": f"""SELECT list({{'key': upper(word[1]) || word[2:], 'value': n}}
          ORDER BY n DESC, word)
        FROM ({_words('job_requirements', '1', 'base WHERE job_requirements IS NOT NULL')}
              ORDER BY n DESC, word LIMIT 50)""",
    "table_data": """SELECT list({'title': title, 'salary': salary, 'company': company, 'desc': d,
          'req': req, 'ben': ben, 'url': url} ORDER BY posted DESC NULLS FIRST, job_id)
        FROM (SELECT f.job_id, max(posted_date) AS posted, coalesce(max(job_title), '') AS title,
            coalesce(max(salary_text), '') AS salary, coalesce(max(company_name), '') AS company,
            coalesce(max(job_description), '') AS d, coalesce(max(job_requirements), '') AS req,
            coalesce(max(job_benefits), '') AS ben, coalesce(max(job_url), '') AS url
          FROM fact f JOIN jd ON f.job_id = jd.job_id LEFT JOIN co ON f.company_id = co.company_id
          GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 100)""",
}

ORACLE = {
    "dashboard_json": with_star("SELECT CAST(to_json({" + ", ".join(
        f"'{name}': ({sql})" for name, sql in _JSON_PARTS.items()) + "}) AS VARCHAR) AS document"),
    "kpi": with_star(_KPI),
    "kpi_unweighted": with_star("""SELECT count(*) AS total_jobs,
        count(DISTINCT company_id) AS total_companies,
        avg(nullif(salary_numeric, 0)) AS avg_salary, avg(years_of_experience) AS avg_experience
        FROM fact JOIN jd USING (job_id)"""),
    "kpi_filtered": with_star(f"{_KPI} WHERE {_WHERE}"),
    "kpi_formatted": with_star(f"""SELECT format('{{:,}}', total_jobs) AS total_jobs,
        format('{{:,}}', total_companies) AS total_companies,
        CASE WHEN coalesce(avg_salary, 0) = 0 THEN 'N/A'
             ELSE printf('%.1f', round(avg_salary / 1000000, 1)) || ' M' END AS avg_salary,
        CASE WHEN avg_experience IS NULL THEN '0 Years'
             ELSE printf('%.1f', round(avg_experience, 1)) || ' Years' END AS avg_exp
        FROM ({_KPI})"""),
    "top_skills": with_star("""SELECT skill_name, count(DISTINCT b.job_id) AS jobs
        FROM base b JOIN sk ON b.job_id = sk.job_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "top_skills_by_location": with_star("""SELECT skill_name, count(DISTINCT b.job_id) AS jobs
        FROM base b JOIN sk ON b.job_id = sk.job_id
        WHERE b.job_id IN (SELECT job_id FROM loc WHERE location_name = 'NATION_3')
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "level_distribution": with_star("""SELECT job_level, count(DISTINCT job_id) AS jobs
        FROM base GROUP BY 1"""),
    "top_companies": with_star("""SELECT company_name, count(DISTINCT b.job_id) AS jobs
        FROM base b JOIN co ON b.company_id = co.company_id
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "category_salaries": with_star("""SELECT category_name,
        avg(nullif(salary_numeric, 0)) AS avg_salary,
        round(avg(nullif(salary_numeric, 0)) / 1000000, 1) AS avg_salary_millions
        FROM base WHERE salary_numeric > 0 AND category_name IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "salary_by_experience": with_star("""SELECT years_of_experience,
        avg(nullif(salary_numeric, 0)) AS avg_salary, count(DISTINCT job_id) AS jobs,
        round(avg(nullif(salary_numeric, 0)) / 1000000, 1) AS avg_salary_millions
        FROM base WHERE salary_numeric > 0 AND years_of_experience <= 10 GROUP BY 1"""),
    "treemap": with_star(_TREEMAP),
    "top_locations_share": with_star("""
        SELECT location_name, jobs, CAST(round(100.0 * jobs / sum(jobs) OVER ()) AS INT) AS share
        FROM (SELECT location_name, count(DISTINCT b.job_id) AS jobs
              FROM base b JOIN loc ON b.job_id = loc.job_id
              GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""),
    "word_cloud": with_star(f"""
        SELECT upper(word[1]) || word[2:] AS key, n AS value,
          CASE WHEN max(n) OVER () = min(n) OVER () THEN 40.0 ELSE
            36 + (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) * 44
          END AS size
        FROM ({_words('job_requirements', '1', 'base WHERE job_requirements IS NOT NULL')}
              ORDER BY n DESC, word LIMIT 50)"""),
    "word_counts": _words("text", "1", "documents"),
    "latest_jobs": with_star("""SELECT f.job_id, max(posted_date) AS posted_date,
        coalesce(max(job_title), '') AS title, coalesce(max(salary_text), '') AS salary,
        coalesce(max(company_name), '') AS company, coalesce(max(job_description), '') AS "desc",
        coalesce(max(job_requirements), '') AS req, coalesce(max(job_benefits), '') AS ben,
        coalesce(max(job_url), '') AS url
        FROM fact f JOIN jd ON f.job_id = jd.job_id LEFT JOIN co ON f.company_id = co.company_id
        GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 100"""),
    "filter_options": with_star("""
        SELECT 'industry' AS filter, 'All' AS choice UNION ALL SELECT 'category', 'All'
        UNION ALL SELECT 'level', 'All' UNION ALL SELECT 'location', 'All'
        UNION ALL SELECT DISTINCT 'industry', industry_name FROM ind
        UNION ALL SELECT DISTINCT 'category', category_name FROM cat
        UNION ALL SELECT DISTINCT 'level', job_level FROM jd
        UNION ALL SELECT DISTINCT 'location', location_name FROM loc"""),
    "filter_options_sorted": with_star("""SELECT filter, choice, row_number() OVER (
          PARTITION BY filter ORDER BY CASE WHEN choice = 'All' THEN 0 ELSE 1 END, choice) AS position
        FROM (SELECT 'industry' AS filter, 'All' AS choice UNION ALL SELECT 'category', 'All'
          UNION ALL SELECT 'level', 'All' UNION ALL SELECT 'location', 'All'
          UNION ALL SELECT DISTINCT 'industry', industry_name FROM ind
          UNION ALL SELECT DISTINCT 'category', category_name FROM cat
          UNION ALL SELECT DISTINCT 'level', job_level FROM jd
          UNION ALL SELECT DISTINCT 'location', location_name FROM loc)"""),
}

ORACLE["top_words_sketch"] = f"{_words('text', '1', 'documents')} ORDER BY n DESC, word LIMIT 50"
ORACLE |= {f"{name}_summary": ORACLE[name] for name in ("kpi", "treemap")} | {
    "kpi_summary_filtered": ORACLE["kpi_filtered"], "top_skills_summary": ORACLE["top_skills_by_location"],
    "salaries_summary": ORACLE["salary_by_experience"],
}
