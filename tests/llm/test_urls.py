"""URL parts and rules against plain Python; the trees on held-out URLs."""

import random

import pytest
from pyspark.sql import functions as F

from careerlake.llm import urls

CASES = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://www.Example.org/es/1?x=1#y",
    "http://example.org/en/17", "http://a.example.org/en/27#t", "https://shop.com/fr/x", "https://shop.com/de/x",
    "ftp://com/fr/", "http://xcom/de/", "http://notexample.org/es/", "a://b://c/d", "http://org?x=/es/", "://h/p?q",
    "http://h.com/de", "HTTP://É.Com/de/ü", "http://example.org/es/\nx?y", "x" * 5000 + "://y.org/" + "z" * 50_000,
    "http://u:p@example.org:80/es/", "http://example.net/de/",
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, where, start in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
                                  ("allow", "com", "/fr/"), ("block", "com", "/de/")):
        if (host == where or host.endswith("." + where)) and path.startswith(start):
            if best is None or len(where + start) > len(best[0]):
                best = (where + start, verdict)
    return host, path, *(best or (None, None))


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "k", 1.0) for i, u in enumerate(CASES + CASES[:3])],
                                  "page_id long, url string, host string, url_depth double")
    rows = urls.judged(pages).collect()
    assert len(rows) == len(CASES) + 3
    for row in rows:
        host, path, rule, verdict = brute(row.url)
        assert (row.host, row.path, row.rule) == (host, path, rule), row.url
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")


def test_without_labels_and_with_one_kind(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judged(pages).collect()} == {"allow"}
    blocked = pages.unionByName(spark.createDataFrame([(3, "http://x.com/de/1")], "page_id long, url string"))
    assert {r.verdict for r in urls.judged(blocked).collect()} == {"block"}
    assert urls.judged(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        bad = i % 2
        if bad:
            host = rng.choice(["win", "pills", "x"]) + str(rng.randint(10_000, 99_999)) + "-" + rng.choice("abc") + ".biz"
            path = "/".join(str(rng.getrandbits(40)) for _ in range(rng.randint(3, 6))) + "?a=1&b=2&c=3"
        else:
            host = rng.choice(["news", "blog", "wiki"]) + rng.choice([".info", ".net"])
            path = "/".join(rng.choice(["story", "about", "green", "tea"]) for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.03:
            bad = 1 - bad
        rows.append((i, f"http://{host}/{path}", bad))
    return spark.createDataFrame(rows, "page_id long, url string, label int")


def test_held_out_accuracy(spark, labelled):
    model = urls.train(labelled.filter("page_id < 1000"), sample=800)
    rest = labelled.filter("page_id >= 1000").withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    judged, chance = model.block_chance(rest, "url", "host", "path")
    rows = judged.collect()
    assert judged.columns == [*rest.columns, chance]
    assert sum((r[chance] > 0.5) == (r.label == 1) for r in rows) / len(rows) > 0.93


def test_entropy_and_counts(spark):
    row = spark.createDataFrame([("aabb",), ("",)], "t string").select(urls._entropy(F.col("t")).alias("e")).collect()
    assert [r.e for r in row] == [1.0, 0.0]
    wide = urls.features(
        spark.createDataFrame([("https://a.b-1.com/x/Y/2?k=1&l=2#f",)], "url string")
        .withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url"))),
        "url", "host", "path", "f_",
    ).first()
    assert (wide.f_depth, wide.f_labels, wide.f_parameters, wide.f_fragment, wide.f_secure) == (3, 2, 2, 1, 1)


def test_chances_do_not_depend_on_the_layout(spark, labelled):
    rest = labelled.limit(200).withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))

    def chances(parts):
        judged, chance = urls.train(labelled.repartition(parts), sample=700).block_chance(rest, "url", "host", "path")
        return {r.page_id: r[chance] for r in judged.collect()}

    assert chances(1) == pytest.approx(chances(16))
