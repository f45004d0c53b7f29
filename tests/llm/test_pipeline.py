"""The pipeline against its stages in plain Python, on the smallest tables and on odd rows."""

import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from careerlake.llm import quality
from tests.conftest import SMALL
from tests.llm.test_contamination import brute as leaks
from tests.llm.test_pii import brute as personal
from tests.llm.test_similar import brute_groups


def masked(text):
    out, at = [], 0
    names = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>"]
    for start, kind, end in personal(text):
        if start >= at:
            out += [text[at:start], names[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def expected(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id: r.text for r in quality.accepted(docs).collect()}  # held against brute force of its own
    ids = sorted(kept)
    tops = brute_groups([kept[i] for i in ids])
    kept = {ids[i]: kept[ids[i]] for i in set(tops)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in leaks(list(kept.items()), items)}
    return {d: masked(t) for d, t in kept.items() if d not in leaked}


def test_run(spark):
    want = expected(spark, SMALL)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(rows) == set(want) and len(want) > 100
    for doc, text in want.items():
        assert rows[doc].ids == library.encode(text, add_special_tokens=False).ids
        assert rows[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes


def test_odd_rows(spark):
    text = " ".join(f"word{i} and" for i in range(40))
    docs = spark.createDataFrame(
        [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text + " more", None, None, None),
         (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, text[::-1] * 300, "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL)
        rows = [r.doc_id for r in now.collect()]
        assert rows.count(1) <= 1 and 2 not in rows and 4 not in rows and len(rows) <= 3
