"""The factorization machine: its slope, what it learns that weights alone cannot, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerlake.llm import queries, toxicity
from careerlake.llm.common import drawn
from careerlake.llm.toxicity import Machine


def test_logit_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    machine = Machine(0.3, np.arange(0, 60, 3), rng.normal(size=20), rng.normal(size=(20, 4)))
    found = np.array([0, 1, 3, 9, 10, 57, 99])
    at = [0, 1, 3, 19]
    want = 0.3 + machine.weights[at].sum() + sum(
        machine.factors[i] @ machine.factors[j] for i in at for j in at if i < j)
    assert machine.logit(found) == pytest.approx(want)
    assert machine.logit(np.zeros(0, np.int32)) == 0.3
    assert toxicity.fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)).logit(found) == pytest.approx(np.log(1 / 3))


def both(n, seed):
    """Insults and mentions of groups; a text is toxic if and only if it has one of each."""
    rng = random.Random(seed)
    insults, groups, plain = ["vile", "filthy", "rotten"], ["tribe", "nation", "creed"], [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 120))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += [rng.choice(insults)] * insult + [rng.choice(groups)] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_are_learned():
    rows = both(1500, 2)
    found = [toxicity.buckets_of(t) for _, t, _ in rows]
    labels = np.array([y for *_, y in rows])
    lengths = np.array([len(f) for f in found])
    machine = toxicity.fit(np.concatenate(found), lengths, labels)
    def right(m, data):
        return np.mean([(m.logit(toxicity.buckets_of(t)) >= 0) == y for _, t, y in data])

    fresh = both(1000, 3)
    assert right(machine, fresh) > 0.97
    pair, one = machine.logit(toxicity.buckets_of("vile tribe")), machine.logit(toxicity.buckets_of("vile"))
    other, none = machine.logit(toxicity.buckets_of("tribe")), machine.logit(toxicity.buckets_of("w1"))
    assert pair > 0 > max(one, other) and pair - one > other - none + 1  # more than the sum of both


def test_held_out_rows_and_odd_rows(spark):
    rows = both(1800, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in rows if i < 1500] + [(None, 1), (5000, 1), (1601, None), (1602, 7), (1, rows[1][2])],
        "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(7), labels.repartition(5))
    assert (machine.used == again.used).all() and np.allclose(machine.weights, again.weights)
    found = {r.doc_id: r.score for r in toxicity.scored(docs, machine).collect()}
    assert np.mean([(found[i] >= 0.5) == y for i, _, y in rows[1500:]]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "vile tribe"), (3, "vile tribe " * 50_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.scored(odd, machine).collect()}
    assert scores[1] == scores[2] < 0.5 < scores[None] == scores[3]
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(odd, nothing).collect()} == {0.25}
    assert toxicity.scored(odd.limit(0), machine).count() == 0


def test_draws_do_not_depend_on_the_layout(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    some = {r.k for r in drawn(df, F.col("k"), 1000, 10_000).collect()}
    assert 850 < len(some) < 1150 and some == {r.k for r in drawn(df.repartition(3), F.col("k"), 1000, 10_000).collect()}
    assert drawn(df, F.col("k"), 10_000, 10_000).count() == 10_000


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op12_toxicity(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.85
