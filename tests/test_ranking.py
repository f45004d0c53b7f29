import random

import pandas as pd
from pyspark.sql import functions as F

from careerlake.operators import merge
from careerlake.operators.ranking import average_rank, average_rank_in_window, fused_score, number_rows, top_k


def hot_rows(n=3000):
    """Groups and values of which one holds a third of all rows."""
    rng = random.Random(5)
    return [(i, "hot" if rng.random() < 0.34 else f"g{rng.randrange(40)}",
             7 if rng.random() < 0.34 else rng.randrange(200)) for i in range(n)]


def test_average_rank_equals_pandas(spark):
    rows = hot_rows() + [(90001, "hot", None), (90002, "g1", None)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    for ascending in (True, False):
        grouped = average_rank(df, "v", ["g"], ascending, "r", slices=7).toPandas().set_index("id")["r"]
        expected = pdf.groupby("g")["v"].rank(ascending=ascending).set_axis(pdf["id"])
        pd.testing.assert_series_equal(grouped.sort_index(), expected.sort_index(), check_names=False, check_index_type=False)
        overall = average_rank(df, "v", (), ascending, "r", slices=7).toPandas().set_index("id")["r"]
        expected = pdf["v"].rank(ascending=ascending).set_axis(pdf["id"])
        pd.testing.assert_series_equal(overall.sort_index(), expected.sort_index(), check_names=False, check_index_type=False)


def test_average_rank_in_window(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.3,), (0.1,)], "v double").withColumn("g", F.lit(1))
    up = df.select("v", average_rank_in_window(F.col("v"), ["g"]).alias("r"))
    assert sorted(map(tuple, up.collect())) == [(0.0, 1.5), (0.0, 1.5), (0.1, 3.0), (0.3, 4.0)]
    down = df.select("v", average_rank_in_window(F.col("v"), ["g"], False).alias("r"))
    assert sorted(map(tuple, down.collect())) == [(0.0, 3.5), (0.0, 3.5), (0.1, 2.0), (0.3, 1.0)]


def test_unknown_distance_has_no_rank(spark):
    df = spark.createDataFrame([(float("nan"),), (0.5,)], "v double").withColumn("g", F.lit(1))
    ranks = {str(r.v): r.r for r in df.select("v", average_rank_in_window(F.col("v"), ["g"]).alias("r")).collect()}
    assert ranks == {"nan": None, "0.5": 1.0}


def test_fused_score_falls_with_either_rank(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)], "a double, b double")
    scores = [r[0] for r in df.select(fused_score(F.col("a"), F.col("b"))).collect()]
    assert scores[0] == 2 / 61 and scores == sorted(scores, reverse=True)


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(v,) for v in random.Random(1).sample(range(10**6), 5000)], "v int")
    rows = number_rows(df, [F.col("v")], "n", slices=9).orderBy("v").collect()
    assert [r.n for r in rows] == list(range(1, 5001))


def test_top_k_of_a_hot_group(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = top_k(df, ["g"], [F.desc("v"), F.col("id")], 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).sort_values(["v", "id"], ascending=[False, True])
    expected = sorted(pdf.groupby("g").head(3)["id"])
    assert sorted(r.id for r in got.collect()) == expected


def test_one_per_key_with_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = merge.one_per_key(df, ["g"], [F.col("v")])
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).sort_values(["v", "id"]).groupby("g").first()
    assert {r.g: (r.id, r.v) for r in got.collect()} == {g: (r.id, r.v) for g, r in pdf.iterrows()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_one_per_key_of_key_only_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, s string")
    assert merge.one_per_key(df, ["k", "s"]).count() == 2


def test_merge_twice_changes_nothing(spark):
    current = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, n int")
    incoming = spark.createDataFrame([(2, "x", 60), (3, "c", 70), (3, "d", 80)], "k int, s string, n int")
    once = merge.upsert_columns(current, incoming, ["k"], ["n"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5), (2, "b", 60), (3, "c", 70)]
    twice = merge.upsert_columns(once, incoming, ["k"], ["n"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    rows = merge.upsert_rows(current, incoming, ["k"])
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 5), (2, "x", 60), (3, "c", 70)]


def test_updated_value_may_become_null(spark):
    current = spark.createDataFrame([(1, 5)], "k int, n int")
    incoming = spark.createDataFrame([(1, None)], "k int, n int")
    assert merge.upsert_columns(current, incoming, ["k"], ["n"]).first().n is None


def test_merges_read_each_side_at_most_twice(spark, tmp_path):
    rows = spark.range(20).selectExpr("id AS k", "id AS n", "string(id) AS t")
    rows.write.parquet(str(tmp_path / "current"))
    rows.write.parquet(str(tmp_path / "incoming"))
    current, incoming = (spark.read.parquet(str(tmp_path / n)) for n in ("current", "incoming"))
    for merged in (merge.insert_if_absent(current, incoming, ["k"]), merge.upsert_columns(current, incoming, ["k"], ["n"])):
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 3, plan
    plan = merge.upsert_columns(current, incoming, ["k"], ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_top_k_of_large_groups_goes_in_parts(spark):
    df = spark.range(5000).selectExpr("id % 2 AS g", "id AS v")
    rows = top_k(df, ["g"], [F.desc("v")], 1500).collect()
    assert len(rows) == 3000 and min(r.v for r in rows) == 2000
    assert {(r.g, r["rank"]) for r in rows} == {(g, i) for g in (0, 1) for i in range(1, 1501)}
