"""Benchmark items in documents against plain Python."""

import random
import re

import pytest

from careerlake.llm import contamination


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs, items, share=0.8):
    hits = set()
    for d, text in docs:
        own = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(own & want) >= share * len(want) - 1e-9:
                hits.add((d, i, len(own & want), len(want)))
    return hits


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("the", "éa", "or", "Ti", "n9") for b in ("re", "sh", "ON", "a", "x", "ü")]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, prose(rng.randint(14, 60))) for i in range(30)]
    items += [(100, "only three words"), (101, None), (102, ""), (103, items[0][1]), (104, "one")]
    docs = []
    for d in range(120):
        words = prose(rng.choice([3, 50, 400, 4000])).split()
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items[:30])[1].split()
            if rng.random() < 0.5:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((d, (", " if d % 3 else "\n").join(words) if d % 2 else " ".join(words).upper()))
    docs += [(500, None), (501, ""), (502, "Only, three words!"), (503, "one"), (504, items[3][1]), (504, items[3][1])]
    return docs, items


def test_hits_equal_all_pairs(spark, data):
    docs, items = data
    got = contamination.find(
        spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, item_id int, key string"),
        spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string"),
    ).collect()
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got} == brute(docs, items)
    assert sum(r.doc_id == 504 and r.item_id == 3 for r in got) == 2


def test_clean_keeps_the_rest_whole(spark, data):
    docs, items = data
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, _row_key int")
    kept = contamination.clean(table, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == table.columns
    hit = {d for d, *_ in brute(docs, items)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in hit)


def test_empty_tables(spark, data):
    docs, items = (spark.createDataFrame(x, f"{n} long, text string") for x, n in zip(data, ("doc_id", "item_id")))
    assert contamination.find(docs.limit(0), items).count() == 0
    assert contamination.find(docs, items.limit(0)).count() == 0
    assert contamination.clean(docs, items.limit(0)).count() == len(data[0])


def test_signature_has_the_least_hash_of_each_bin(spark):
    import pyspark.sql.functions as F

    values = [random.Random(4).getrandbits(64) - (1 << 63) for _ in range(100)]
    got = spark.createDataFrame([(values,)], "h array<long>").select(contamination._signature(F.col("h"))).first()[0]
    bins = {}
    for v in values:
        bins[v >> 57] = min(v, bins.get(v >> 57, v))
    assert sorted(got) == sorted(bins.values())
