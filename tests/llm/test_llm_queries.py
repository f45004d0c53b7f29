"""Registered queries: SQL where there is one, and contracts over the smallest tables."""

import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry_point
from careerlake.llm import queries
from harness.compare import connect, rows_of
from tests.conftest import SMALL
from tests.llm.test_secrets import brute as secrets_brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    df = entry_point.queries()[name](spark, SMALL)
    result = connect(SMALL).execute(queries.ORACLE[name])
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry_point.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_point.queries()


def test_shards_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in queries.op7_shards(spark, SMALL).collect():
        data = (docs.pop(r.doc_id) or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert not docs and sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_secrets_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op4_secrets(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        kinds = [k for *_, k in secrets_brute(docs[r.doc_id])]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
