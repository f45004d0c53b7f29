"""Periodic runs against a search over all periods."""

import hashlib
import random
import time
import zlib

from careerlake.llm import periodic, queries
from tests.conftest import SMALL


def brute(parts, least=12):
    spans, out = [], []
    for q in range(1, len(parts) // 2 + 1):
        i = 0
        while i < len(parts) - q:
            j = i
            while j < len(parts) - q and parts[j] == parts[j + q]:
                j += 1
            if j - i >= q:
                begin, end = i, j + q
                if not any(b <= begin and end <= e for b, e in spans):
                    spans.append((begin, end))
                    out.append((begin, end - begin, q))
            i = j + 1
    return sorted((r for r in out if r[1] >= least), key=lambda r: (r[0], r[2]))


def collapsed(parts, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(p for i, p in enumerate(parts) if i not in gone)


def made(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 90))]
    if kind == 1:
        return [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))] * rng.randint(1, 3)
    if kind == 2:
        a, b = ["a"], ["a", "b"]  # runs of Fibonacci words overlap
        for _ in range(rng.randint(3, 8)):
            a, b = b, b + a
        return b
    parts = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 80))]
    for _ in range(3):
        at = rng.randrange(len(parts) + 1)
        some = parts[at : at + rng.randint(1, 9)]
        parts[at:at] = some * rng.randint(1, 6)
    return parts


def test_runs_are_those_of_all_periods():
    rng, met = random.Random(5), 0
    for _ in range(400):
        parts = made(rng)
        want = brute(parts)
        data = [p.encode() for p in parts]
        assert periodic.runs(data) == want
        assert periodic.collapsed(data, want).decode() == collapsed(parts, want)
        met += len(want)
    assert met > 300


def test_the_automaton_finds_short_runs_too():
    rng = random.Random(6)
    for _ in range(300):
        parts = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert sorted(periodic.runs_of(parts), key=lambda r: (r[0], r[2])) == brute(parts, 0)


def test_long_texts_take_time_nearly_in_proportion():
    for parts in ([b"a"] * 200_000, [b"%d" % (i % 1000) for i in range(200_000)], [b"%d" % i for i in range(200_000)]):
        start = time.perf_counter()
        periodic.runs(parts)
        assert time.perf_counter() - start < 20


def test_odd_rows(spark):
    twelve = " ".join(["x"] * 12)
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, twelve, 1), (4, twelve, 1), (None, "x " * 11, 1), (5, "x x " * 12, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = {r.doc_id: r for r in periodic.with_runs(docs).collect()}
    assert [found[i].runs for i in (1, 2, 3, None)] == [[]] * 4 and found[1].collapsed == found[3].collapsed == ""
    assert [tuple(r) for r in found[4].runs] == [(0, 12, 1)] and found[4].collapsed == "x"
    assert [tuple(r) for r in found[5].runs] == [(0, 12, 1)] and found[5].collapsed == "x x"
    assert found[None].collapsed == " ".join("x" * 11)
    assert periodic.with_runs(docs.limit(0)).count() == 0


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op11_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    planted = 0
    for doc in docs:
        parts = [w.decode() for w in (doc.text or "").encode().split()]
        n, h = len(parts), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            parts = parts[:a] + [parts[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        if n > 3000:
            continue
        want, row = brute(parts), rows[doc.doc_id]
        best = max(want, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert row.n_runs == len(want)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(parts, want).encode()).hexdigest()
    assert planted > 5
