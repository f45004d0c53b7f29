"""Prompt tables: search context, rules, history and question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.functions.text import clip, flat_line

# Characters of a chunk and of an attachment shown, and the context texts.
CHUNK_CHARACTERS = 800
ATTACHMENT_CHARACTERS = 1500
EMPTY_CONTEXT = "Trống."
CONTEXT_TITLE = "[DỮ LIỆU TỪ HỆ THỐNG]:"
ATTACHMENT_TITLE = "[CV ỨNG VIÊN]:"
FALLBACK_START = "⚠️ LỖI: HIỆN KHÔNG CÓ CÔNG VIỆC TẠI ("
FALLBACK_END = "). Các công việc ở trên nằm ở khu vực KHÁC."
LINE_LABELS = {
    "job_title": "- Tên Job: ",
    "company_name": " | Công ty: ",
    "salary_text": " | Lương: ",
    "job_url": " | Link: ",
}
DETAIL_LABEL = " | Chi tiết: "

MESSAGE = "struct<role: string, content: string>"


def context_line() -> Column:
    """One search result as a line of the context."""
    parts: list[Column] = []
    for name, label in LINE_LABELS.items():
        parts += [F.lit(label), F.coalesce(F.col(name).cast("string"), F.lit("None"))]
    detail = clip(flat_line(F.coalesce("chunk_text", F.lit("None"))), CHUNK_CHARACTERS)
    return F.concat(*parts, F.lit(DETAIL_LABEL), detail, F.lit("...\n\n"))


def search_context(results: DataFrame) -> DataFrame:
    """Ranked results of each request folded into one text.

    A request has at most its top-k results, so the folded list is short.
    """
    lines = results.select("query_id", F.struct("rank", context_line().alias("line")).alias("_l"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "").alias("context"))


def system_text(introduction: str, rules: str, context: Column, is_fallback: Column,
                place: Column, attachment: Column) -> Column:
    """The system message: introduction, data, place warning, rules and attachment."""
    warning = F.when(is_fallback, F.concat(
        F.lit("\n" + FALLBACK_START), F.upper(place), F.lit(FALLBACK_END + "\n")))
    shown = F.coalesce(attachment, F.lit(""))
    appended = F.when(shown != "", F.concat(
        F.lit("\n" + ATTACHMENT_TITLE + "\n"), clip(shown, ATTACHMENT_CHARACTERS), F.lit("\n")))
    return F.concat(
        F.lit(introduction + "\n" + CONTEXT_TITLE + "\n"),
        F.coalesce(context, F.lit(EMPTY_CONTEXT)), F.lit("\n"),
        F.coalesce(warning, F.lit("")), F.lit(rules), F.coalesce(appended, F.lit("")))


def message_list(system: Column, history: Column, question: Column) -> Column:
    """System message, recent turns, and the question."""

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    recent = F.coalesce(history, F.array().cast(f"array<{MESSAGE}>"))
    return F.concat(message("system", system), recent, message("user", question))


def prompt_table(requests: DataFrame, results: DataFrame, scopes: DataFrame,
                 introduction: str, rules: str) -> DataFrame:
    """One prompt per request.

    ``requests`` has ``query_id``, ``user_query``, ``cv_text`` and ``history``;
    ``results`` and ``scopes`` come from the search.
    """
    asked = requests.select("query_id", "user_query", "cv_text", "history")
    rows = asked.join(search_context(results), "query_id", "left").join(
        scopes.select("query_id", "requested_location", "is_fallback"), "query_id", "left")
    system = system_text(
        introduction, rules, F.col("context"), F.coalesce("is_fallback", F.lit(False)),
        F.coalesce("requested_location", F.lit("")), F.col("cv_text"))
    return rows.select(
        "query_id", message_list(system, F.col("history"), F.col("user_query")).alias("messages"))
