"""Ordinal regression: its slope against differences, and held-out accuracy."""

import random

import numpy as np
import pytest

from careerlake.llm import grading
from careerlake.llm.common import table
from tests.conftest import SMALL


def test_thresholds_are_ordered_and_grades_are_learned():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 4, 800)
    index = [np.unique(np.concatenate(([g], rng.integers(10, 400, 20)))) for g in grades]
    lengths = np.array([len(i) for i in index])
    model = grading.fit(np.concatenate(index), lengths, grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([model.weights[i].sum() for i in index])
    assert np.mean((score[:, None] > model.thresholds).sum(axis=1) == grades) > 0.9
    assert model.weights[0] < model.weights[1] < model.weights[2] < model.weights[3]


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(4)
    good, bad, plain = ["theorem", "lemma", "proof"], ["buy", "cheap", "pills"], [f"w{i}" for i in range(200)]
    rows = []
    for i in range(900):
        grade = i % 3
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(good if grade == 2 else bad if grade == 0 else plain))
        rows.append((i, " ".join(words), grade))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_held_out_accuracy(spark, rated):
    model = grading.train(rated.drop("grade"), rated.filter("doc_id < 600").select("doc_id", "grade"), top=2)
    rows = grading.graded(rated.filter("doc_id >= 600"), model).collect()
    assert sum(round(r.expected_grade) == r.grade for r in rows) / len(rows) > 0.85
    for r in rows:
        assert 1 >= r.tail_1 >= r.tail_2 >= 0 and abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-9


def test_odd_rows(spark, rated):
    model = grading.train(rated, rated.select("doc_id", "grade"), top=2, sample=200)
    odd = spark.createDataFrame([(1, None, 1.5, "a"), (1, None, 1.5, "a"), (2, "", 0.0, "b"), (None, "w1 " * 200_000, 0.0, "c")],
                                "doc_id long, text string, tail_1 double, _score string")
    rows = grading.graded(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.expected_grade <= 2 for r in rows)
    assert rows[0] == rows[1] and rows[0]._score == "a"
    assert grading.graded(odd.limit(0), model).count() == 0
    blank = grading.train(rated, rated.select("doc_id", "grade").limit(0), top=2)
    assert not blank.weights.any()
    nulls = rated.selectExpr("doc_id", "cast(null AS int) AS grade")
    assert not grading.train(rated, nulls, top=2).weights.any()


def test_given_labels(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").selectExpr("doc_id", "IF(toxic = 1, 0, 1 + quality) AS grade")
    model = grading.train(docs, labels.filter("doc_id % 2 = 0"), top=2)
    rows = grading.graded(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), model).collect()
    right = sum((r.tail_2 > 0.5) == (r.grade == 2) for r in rows) / len(rows)
    assert right > 0.97, right


def test_the_sample_does_not_depend_on_the_layout(spark, rated):
    grades = rated.select("doc_id", "grade")
    models = [grading.train(rated.drop("grade").repartition(n), grades.repartition(n), top=2, sample=400) for n in (1, 16)]
    assert np.allclose(models[0].weights, models[1].weights) and np.allclose(models[0].thresholds, models[1].thresholds)
