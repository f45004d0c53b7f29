"""Hard negatives against all pairs, with ties, hot vectors, odd rows and small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from careerlake.llm import hardneg

SCHEMA = "id long, label string, vector array<long>, extra int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    least = {}
    for i, label, vector, _ in rows:
        if i is not None and label is not None and vector is not None and None not in vector:
            least[i] = min(least.get(i, (label, vector)), (label, vector))
    out = []
    for a, (own, v) in least.items():
        if a % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, (label, w) in least.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == own][:positives]:
            inside = [(t, i) for t, i, label in scored if label != own and -low * s <= -100 * t <= -high * s]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(inside[:negatives])]
    return sorted(out)


def made(n, dims, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [rng.randint(-90, 90) for _ in range(dims)]
        if rng.random() < 0.3:
            vector = [7 * d - 20 for d in range(dims)]  # a vector that many rows have
        rows.append((i, rng.choice("aaabc"), vector, 0))
    return rows


def mined(spark, rows, **kw):
    df = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 5 == 0, **kw)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("dims", [1, 7, 24])
def test_equals_all_pairs(spark, monkeypatch, dims):
    monkeypatch.setattr(hardneg, "BLOCK", 37)
    monkeypatch.setattr(hardneg, "CHUNK", 5)
    rows = made(200, dims, dims)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_other_sizes_of_windows_and_lists(spark):
    rows = made(120, 6, 9)
    assert mined(spark, rows, positives=2, negatives=7, low=10, high=120) == brute(rows, 2, 7, 10, 120)


def test_odd_rows(spark):
    rows = made(60, 4, 2) + [
        (None, "a", [1, 2, 3, 4], 0), (100, None, [1, 2, 3, 4], 0), (105, "a", None, 0), (110, "a", [1, None, 3, 4], 0),
        (115, "a", [], 0), (120, "b", [50], 0), (125, "a", [9, 9, 9, 9, 9, 9], 0),
        (10, "c", [80, 80, 80, 80], 1), (10, "c", [80, 80, 80, 80], 1),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(5, "a", [1], 0)]) == []
    assert mined(spark, [(5, "a", [1], 0), (6, "a", [1], 0)]) == []


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans, written = [], hardneg.written

    def planned(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def noted(df, label):
        plans.append(planned(df))
        return written(df, label)

    monkeypatch.setattr(hardneg, "written", noted)
    rows = spark.createDataFrame(made(60, 4, 2), SCHEMA)
    plans.append(planned(hardneg.hard_negatives(rows, F.col("id") % 5 == 0)))
    assert sum(p.count("Join") for p in plans) == 4 and not any("Broadcast" in p for p in plans)


def test_copies_of_the_anchors_are_bounded_by_stripes():
    assert [hardneg._stripes(n) for n in (0, 1, 100, 256, 4000)] == [1, 1, 100, 256, 256]
    assert hardneg._stripes(100_000) == 100_000 / hardneg.STRIPE


def test_bounds_leave_few_candidates_to_the_last_columns():
    import numpy as np

    rng = np.random.default_rng(1)
    block = hardneg.Columns(np.arange(2000), rng.integers(-9, 10, (64, 2000)))
    anchor = np.where(np.arange(64) < 6, 200, rng.integers(-3, 4, 64))
    left = []
    keep = hardneg._leaders(3)

    def counted(partial, low, high):
        good = keep(partial, low, high)
        left.append(int(good.sum()))
        return good

    alive, scores = block.narrowed(anchor, np.arange(2000), counted)
    assert left[0] < 500 and left[-1] < 50
    exact = anchor @ block.columns
    assert set(np.sort(exact)[-3:]) == set(np.sort(scores)[-3:]) and (exact[alive] == scores).all()
