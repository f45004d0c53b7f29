"""Conversation history: last turns, and attachments carried forward.

Messages have ``conv_id``, ``turn``, ``role``, ``content`` and ``cv_text``; ``turn``
orders and identifies the messages of a conversation. A conversation of any length is
cut into stretches of ``STRETCH`` turns, so no task sorts more than one stretch; what a
stretch needs from earlier ones travels as a summary row per stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.functions.text import filled, session_title
from careerlake.operators.ranking import top_k

# Fixed value: turns of history a prompt shows.
HISTORY_TURNS = 6

STRETCH = 4096


def last_turns(messages: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """Last ``n`` messages of each conversation, numbered oldest first."""
    kept = top_k(messages, ["conv_id"], [F.desc("turn")], n, "_back")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return kept.withColumn("position", place).drop("_back")


def _stretched(messages: DataFrame, stretch: int) -> DataFrame:
    return messages.withColumn("_stretch", F.floor(F.col("turn") / stretch))


def _tail(listed: Column, n: int) -> Column:
    return F.slice(listed, F.greatest(F.size(listed) - n + 1, F.lit(1)), F.lit(n))


def with_recent_turns(messages: DataFrame, n: int = HISTORY_TURNS, out: str = "history",
                      stretch: int = STRETCH) -> DataFrame:
    """Each message with the up to ``n`` messages before it, oldest first."""
    cut = _stretched(messages, stretch)
    entry = F.struct("turn", "role", "content")
    here = Window.partitionBy("conv_id", "_stretch").orderBy("turn").rowsBetween(-n, -1)
    local = cut.withColumn("_local", F.collect_list(entry).over(here))

    ends = top_k(cut.select("conv_id", "_stretch", "turn", "role", "content"),
                 ["conv_id", "_stretch"], [F.desc("turn")], n, "_back")
    per_stretch = ends.groupBy("conv_id", "_stretch").agg(
        F.array_sort(F.collect_list(entry)).alias("_end"))
    earlier = Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(-n, -1)
    before = per_stretch.select(
        "conv_id", "_stretch", F.flatten(F.collect_list("_end").over(earlier)).alias("_before"))

    joined = local.join(before, ["conv_id", "_stretch"])
    history = F.transform(
        _tail(F.concat("_before", "_local"), n),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return joined.withColumn(out, history).drop("_stretch", "_local", "_before")


def with_carried_attachment(messages: DataFrame, out: str = "carried_cv",
                            stretch: int = STRETCH) -> DataFrame:
    """Each message with the latest non-empty attachment before it."""
    cut = _stretched(messages, stretch)
    attachment = filled(F.col("cv_text"))
    here = (
        Window.partitionBy("conv_id", "_stretch").orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("_local", F.last(attachment, ignorenulls=True).over(here))

    per_stretch = cut.groupBy("conv_id", "_stretch").agg(
        F.max_by(attachment, F.when(attachment.isNotNull(), F.col("turn"))).alias("_end"))
    earlier = (
        Window.partitionBy("conv_id").orderBy("_stretch")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = per_stretch.select(
        "conv_id", "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    joined = local.join(before, ["conv_id", "_stretch"])
    return joined.withColumn(out, F.coalesce("_local", "_before")).drop(
        "_stretch", "_local", "_before")


def effective_attachment(own: Column, carried: Column) -> Column:
    """A message's own attachment, else the carried one, else an empty text."""
    return F.coalesce(filled(own), carried, F.lit(""))


def session_summary(messages: DataFrame, time: str | None = None) -> DataFrame:
    """Title and last activity per conversation, most recent first.

    ``time`` names the column with a message's time; conversations without any time come
    last, and turns settle ties. Without such a column only turns are known. The opening
    user message gives the title. All aggregates combine before the shuffle.
    """
    opening = F.when(F.col("role") == "user", F.col("turn"))
    when = [F.max(time).alias("updated_at")] if time else []
    return (
        messages.groupBy("conv_id")
        .agg(
            F.min_by("content", opening).alias("title"),
            F.max("turn").alias("last_turn"),
            F.count(F.lit(1)).alias("messages"),
            *when,
        )
        .withColumn("title", session_title(F.col("title")))
        .orderBy(*[F.desc_nulls_last("updated_at")] * bool(time), F.desc("last_turn"), F.asc("conv_id"))
    )


def conversation(messages: DataFrame, conv_id) -> DataFrame:
    """Messages of one conversation in order."""
    return messages.filter(F.col("conv_id") == conv_id).orderBy("turn")
