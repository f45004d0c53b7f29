"""Search by cells against the search of all documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerlake.operators.cells import CellIndex, nearest_by_cells
from careerlake.operators.nearest import nearest
from careerlake.session import scratch_path

DIMENSIONS = 16


@pytest.fixture(scope="module")
def tables(spark):
    """Documents around forty directions, one of which a third of them share; some have no length."""
    rng = np.random.default_rng(3)
    directions = rng.normal(size=(40, DIMENSIONS))
    group = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    vectors = directions[group] + 0.25 * rng.normal(size=(3000, DIMENSIONS))
    vectors[[7, 70]] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None)]
    docs = spark.createDataFrame(rows, "job_id long, embedding array<double>")
    asked = directions[rng.integers(0, 40, 60)] + 0.3 * rng.normal(size=(60, DIMENSIONS))
    requests = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    return docs, requests, CellIndex.build(docs, scratch_path(spark, "cells"), cells=48)


def found(df):
    return {(r.query_id, r["rank"]): (r.job_id, r.vector_distance) for r in df.collect()}


def test_recall_and_share_of_documents_read(tables):
    docs, requests, index = tables
    want = {(q, job) for (q, _), (job, _) in found(nearest(docs, requests, 10)).items()}
    got = {(q, job) for (q, _), (job, _) in found(nearest_by_cells(index, requests, 10, probes=4)).items()}
    assert len(want & got) >= 0.9 * len(want)
    size = {r.cell: r.docs for r in index.cells}
    read = sum(size[r.stripe] for r in index.probes(requests, 4).collect())
    assert sum(size.values()) == 3000 and read < 0.35 * 60 * 3000


@pytest.mark.parametrize("k, probes", [(10, 2), (700, 1), (3000, 1)])
def test_the_exact_search_equals_that_of_all_documents(tables, k, probes):
    docs, requests, index = tables
    few = requests.filter("query_id < 12")
    want, got = found(nearest(docs, few, k)), found(nearest_by_cells(index, few, k, probes, exact=True))
    assert {a: b[0] for a, b in got.items()} == {a: b[0] for a, b in want.items()}


def test_empty_tables_and_vectors_without_length(spark, tables):
    docs, requests, index = tables
    assert nearest_by_cells(index, requests.limit(0), 5, exact=True).isEmpty()
    zero = requests.limit(1).withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    assert nearest_by_cells(index, zero, 3, exact=True).count() == 3
    none = CellIndex.build(docs.limit(0), scratch_path(spark, "cells"), cells=4)
    assert nearest_by_cells(none, requests, 5, exact=True).isEmpty()
