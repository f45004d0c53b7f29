"""SimHash groups against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from careerlake.llm import simhash
from careerlake.llm.components import components


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, reach=3):
    """Component of each value, as the set of places, by comparing all pairs."""
    at = list(range(len(values)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= reach:
                at[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered(rng, clusters, members, flips):
    made = []
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(members):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                value ^= 1 << bit
            made.append(value)
    return made


def test_fingerprints():
    rng = random.Random(2)
    words = ["The", "a", "é", "日本", "ÀB", "x."]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\t"]) for _ in range(rng.randint(0, 30)))
        assert simhash._fingerprint(text) & (1 << 64) - 1 == brute_print(text)
    assert simhash._fingerprint(None) == simhash._fingerprint(" \n") == 0
    assert simhash._fingerprint("w " * 100_000) & (1 << 64) - 1 == brute_print("w w w")


@pytest.mark.parametrize("block", [4096, 16])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    values = list(dict.fromkeys(clustered(rng, 6, 60, 4) + clustered(rng, 200, 2, 3) + [0, 7, (1 << 64) - 1]))
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(prints)).collect()}
    want = groups(values)
    got = [roots.get(signed(v), signed(v)) for v in values]
    for i in range(len(values)):
        for j in range(i):
            assert (want[i] == want[j]) == (got[i] == got[j])


def test_a_long_chain_of_links_is_one_group(spark):
    values, now = [], 0
    for i in range(64):
        now ^= 1 << i
        values.append(now)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    assert components(simhash.links(prints)).select("root").distinct().count() == 1


def test_large_groups_are_folded_to_a_forest():
    rng = np.random.default_rng(1)
    centre = np.uint64(0x123456789ABCDEF0)
    fps = np.unique(centre ^ (np.uint64(1) << rng.integers(32, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(32, 64, 600).astype(np.uint64)))
    keys = np.zeros(len(fps), np.int64)
    u, v = simhash._links_of(keys, np.full(len(fps), len(fps)), fps)
    assert len(u) < len(fps)


def test_components_of_a_path_and_empty(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    rows = components(path).collect()
    assert {r.root for r in rows} == {0} and len(rows) == 201 and len({r.node for r in rows}) == 201
    assert components(path.limit(0)).count() == 0


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w299", "other")
    rows = [(5, base), (3, near), (9, base), (9, base), (None, base), (7, None), (8, ""), (1, "all other words here")]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    tops = groups(prints)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if tops[j] == tops[i] and rows[j][0] is not None]
        want.append((doc, min(ids)))
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
