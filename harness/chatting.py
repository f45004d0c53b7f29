"""Conversation history over the given tables, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from careerlake.operators import history
from careerlake.plans import prompts
from harness import roles
from harness.roles import MESSAGES


def last_turns(spark, sf):
    rows = history.last_turns(roles.messages(spark, sf))
    return rows.select("conv_id", "turn", "role", "content", F.col("position").cast("bigint").alias("position"))


def carry_forward(spark, sf):
    rows = history.with_carried_attachment(roles.messages(spark, sf))
    return rows.select("conv_id", "turn", history.effective_attachment(
        F.col("cv_text"), F.col("carried_cv")).alias("cv_text"))


def prompt_messages(spark, sf):
    """The message list of every user turn: system text, six turns before it, question."""
    rows = history.with_recent_turns(history.with_carried_attachment(roles.messages(spark, sf)))
    asked = rows.filter("role = 'user'")
    system = prompts.system_text(
        "Hello.", "Be kind.\n", F.lit(None).cast("string"), F.lit(False), F.lit(""),
        history.effective_attachment(F.col("cv_text"), F.col("carried_cv")))
    listed = prompts.message_list(system, F.col("history"), F.col("content"))
    return asked.select("conv_id", "turn", F.array_join(F.transform(
        listed, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


def session_summary(spark, sf):
    return history.session_summary(roles.messages(spark, sf))


def session_list(spark, sf):
    """Conversations by last activity; an event gives the time of a message."""
    times = roles.table(spark, sf, "events").select("event_id", "ts")
    timed = roles.messages(spark, sf).withColumn("event_id", F.col("conv_id") * 7 + F.col("turn")).join(
        times, "event_id", "left").drop("event_id")
    ordered = history.session_summary(timed, "ts")
    return ordered.select("conv_id", "title", "updated_at", "messages")


QUERIES = {
    "session_list": session_list,
    "last_turns": last_turns,
    "carry_forward": carry_forward,
    "prompt_messages": prompt_messages,
    "session_summary": session_summary,
}

_CARRIED = f"""SELECT *, last_value(nullif(cv_text, '') IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried
    FROM ({MESSAGES})"""

ORACLE = {
    "session_list": f"""SELECT conv_id,
          array_to_string(list_filter(string_split_regex(
            arg_min(content, turn) FILTER (role = 'user'), '\\s+'), lambda w: w <> '')[1:6], ' ')
            || '...' AS title, max(ts) AS updated_at, count(*) AS messages
        FROM ({MESSAGES}) LEFT JOIN events ON event_id = conv_id * 7 + turn GROUP BY conv_id""",
    "last_turns": f"""SELECT conv_id, turn, role, content, row_number() OVER (
          PARTITION BY conv_id ORDER BY turn) AS position
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
              FROM ({MESSAGES})) WHERE r <= 6""",
    "carry_forward": f"""SELECT conv_id, turn, coalesce(nullif(cv_text, ''), carried, '') AS cv_text
        FROM ({_CARRIED})""",
    "prompt_messages": f"""SELECT conv_id, turn, 'system: Hello.' || chr(10)
          || '[DỮ LIỆU TỪ HỆ THỐNG]:' || chr(10) || 'Trống.' || chr(10) || 'Be kind.' || chr(10)
          || CASE WHEN coalesce(nullif(cv_text, ''), carried, '') = '' THEN '' ELSE chr(10)
               || '[CV ỨNG VIÊN]:' || chr(10)
               || substr(coalesce(nullif(cv_text, ''), carried), 1, 1500) || chr(10) END
          || chr(10) || coalesce(past || chr(10), '') || 'user: ' || content AS messages
        FROM (SELECT *, string_agg(role || ': ' || content, chr(10)) OVER (PARTITION BY conv_id
                ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS past FROM ({_CARRIED}))
        WHERE role = 'user'""",
    "session_summary": f"""SELECT conv_id,
          array_to_string(list_filter(string_split_regex(
            arg_min(content, turn) FILTER (role = 'user'), '\\s+'), lambda w: w <> '')[1:6], ' ')
            || '...' AS title,
          max(turn) AS last_turn, count(*) AS messages FROM ({MESSAGES}) GROUP BY conv_id""",
}
