import pytest
from pyspark.sql import functions as F

from careerlake.operators import history
from careerlake.plans.prompts import message_list, search_context, system_text


def messages(spark):
    rows = []
    for conv, turns in (("long", 23), ("short", 3), ("single", 1)):
        for turn in range(turns):
            cv = f"{conv}-cv{turn}" if turn in (2, 11) else ("" if turn % 2 else None)
            rows.append((conv, turn * 3, "user" if turn % 2 == 0 else "assistant", f"m{turn}", cv))
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, content string, cv_text string")
    return df, rows


@pytest.mark.parametrize("stretch", [1, 4, 10, 4096])
def test_history_and_attachments_equal_brute_force(spark, stretch):
    df, rows = messages(spark)
    got = history.with_carried_attachment(history.with_recent_turns(df, 6, stretch=stretch), stretch=stretch)
    for row in got.collect():
        before = [r for r in rows if r[0] == row.conv_id and r[1] < row.turn]
        assert [(m.role, m.content) for m in row.history] == [(r[2], r[3]) for r in before[-6:]]
        carried = [r[4] for r in before if r[4]]
        assert row.carried_cv == (carried[-1] if carried else None)
    assert got.count() == len(rows)


def test_last_turns(spark):
    df, _ = messages(spark)
    rows = history.last_turns(df, 2).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.content, r.position) for r in rows] == [
        ("long", "m21", 1), ("long", "m22", 2), ("short", "m1", 1), ("short", "m2", 2), ("single", "m0", 1)]


def test_summary_and_conversation(spark):
    df, _ = messages(spark)
    rows = history.session_summary(df).collect()
    assert [(r.conv_id, r.title, r.last_turn, r.messages) for r in rows] == [
        ("long", "m0...", 66, 23), ("short", "m0...", 6, 3), ("single", "m0...", 0, 1)]
    times = {"short": 5, "long": 3}
    timed = df.withColumn("at", F.when(F.col("conv_id") == "short", 5).when(F.col("conv_id") == "long", 3))
    assert [(r.conv_id, r.updated_at) for r in history.session_summary(timed, "at").collect()] == [
        ("short", times["short"]), ("long", times["long"]), ("single", None)]
    assert [r.content for r in history.conversation(df, "short").collect()] == ["m0", "m1", "m2"]


def test_prompt_parts(spark):
    results = spark.createDataFrame(
        [(1, 2, "b", "B", None, "u2", "c\nd" + "x" * 900), (1, 1, "a", "A", "s", "u1", "k")],
        "query_id int, rank int, job_title string, company_name string, salary_text string, "
        "job_url string, chunk_text string")
    text = search_context(results).first().context
    assert text.startswith("- Tên Job: a | Công ty: A | Lương: s | Link: u1 | Chi tiết: k...\n\n- Tên Job: b")
    assert "Lương: None" in text and "c d" + "x" * 797 + "...\n\n" in text
    row = spark.range(1).select(
        system_text("Hi.", "Rules\n", F.lit(None).cast("string"), F.lit(True), F.lit("huế, đà nẵng"),
                    F.lit("c" * 2000)).alias("s"))
    system = row.first().s
    assert "Trống." in system and "(HUẾ, ĐÀ NẴNG)" in system and system.endswith("c" * 1500 + "\n")
    listed = row.select(message_list(F.col("s"), F.lit(None).cast(
        "array<struct<role: string, content: string>>"), F.lit("q")).alias("m")).first().m
    assert [m.role for m in listed] == ["system", "user"]
