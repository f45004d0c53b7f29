"""Shards: exact sizes, whole contents, and uniformity."""

import math
from collections import Counter

import numpy as np
import pytest

from careerlake.llm import sharding


def test_matrix_has_exact_margins():
    rng = np.random.default_rng(0)
    for _ in range(50):
        rows = rng.integers(0, 400, rng.integers(1, 12)).tolist()
        shards = int(rng.integers(1, 20))
        sent = sharding.matrix(rows, shards, int(rng.integers(1000)))
        assert sent.sum(axis=1).tolist() == rows and (sent >= 0).all()
        sizes = sent.sum(axis=0)
        assert sizes.max() - sizes.min() <= 1
    assert sharding.matrix([], 4).shape == (0, 4)


def test_matrix_is_hypergeometric():
    counts = np.array([sharding.matrix([40, 60, 100], 4, seed)[0, 0] for seed in range(3000)])
    assert abs(counts.mean() - 10) < 0.2  # 40 rows, a quarter of the places
    assert abs(counts.var() - 40 * 0.25 * 0.75 * 160 / 199) < 0.5


def test_large_populations_keep_exact_sums():
    rows = [3_000_000_000, 1, 0, 7_000_000_001]
    sent = sharding.matrix(rows, 3, 5)
    assert sent.sum(axis=1).tolist() == rows
    assert sent.sum(axis=0).max() - sent.sum(axis=0).min() <= 1
    assert abs(sent[0, 0] - 1e9) < 1e6


def test_draws_follow_the_exact_chances():
    rng = np.random.default_rng(4)
    for good, bad, drawn in ((5, 7, 6), (30, 2, 20), (1, 9, 9), (12, 12, 1)):
        want = np.array([math.comb(good, k) * math.comb(bad, drawn - k) for k in range(drawn + 1)], float)
        want /= want.sum()
        got = np.bincount([sharding._hypergeometric(rng, good, bad, drawn) for _ in range(6000)], minlength=drawn + 1) / 6000
        assert np.abs(got - want).max() < 0.03
    assert sharding._hypergeometric(rng, 0, 5, 3) == 0 and sharding._hypergeometric(rng, 4, 0, 3) == 3
    assert sharding._hypergeometric(rng, 9, 9, 0) == 0


def test_a_trillion_rows():
    rows = [100_000] * 40 + [10**12 - 4_000_000]
    draws = np.array([sharding.matrix(rows[:1] + [10**12 - 100_000], 16, seed)[0] for seed in range(400)])
    assert (draws.sum(axis=1) == 100_000).all()
    assert abs(draws[:, 0].mean() - 6250) < 16 and abs(draws[:, 0].var() - 5859) < 1500
    sent = sharding.matrix(rows, 16)
    assert sent.sum(axis=1).tolist() == rows and sent.sum(axis=0).max() - sent.sum(axis=0).min() <= 1


@pytest.mark.parametrize("cell", [50_000, 7])
def test_shuffle(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    df = spark.range(1003).selectExpr("id", "if(id % 3 = 0, null, 'same text') AS text", "id AS slot", "1 AS _block")
    rows = sharding.shuffled(df, 16, block_rows=50).collect()
    assert sorted(r.id for r in rows) == list(range(1003))
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(size))
    order = [r.id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(1003))[0, 1]) < 0.15
    assert {r.text for r in rows} == {None, "same text"}


def test_a_row_may_go_anywhere(spark):
    df = spark.range(40).coalesce(2)
    seen = Counter()
    for seed in range(12):
        for r in sharding.shuffled(df, 4, seed=seed, block_rows=10).collect():
            seen[r.shard, r.id < 20] += 1
    assert all(abs(seen[s, half] - 60) < 32 for s in range(4) for half in (True, False))


def test_repeated_rows_and_empty_table(spark):
    same = spark.createDataFrame([(1, "a")] * 33, "doc_id long, text string")
    sizes = Counter(r.shard for r in sharding.shuffled(same, 16).collect())
    assert sorted(sizes.values()) == [2] * 15 + [3]
    assert sharding.shuffled(same.limit(0), 16).count() == 0
