"""Personal data against plain Python, and the corpus statistics on a small corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

from careerlake.llm import pii

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (
                k == 2 and (not 12 <= len(d) <= 19 or luhn)) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def spans_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    rows = df.select("i", "text", pii.base_spans(F.col("text")).alias("s")).collect()
    return [(r.text, [(s.start, s.kind, s.end) for s in r.s]) for r in rows]


def test_base_spans(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "x.y+z@q-1.example.com", "@", ".", "1.2.3.4", "300.1.1.1", "000255.1.1.1", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "+1 (555) 010-9999", "+49", " ", "é", "𝄞", "_d@e.f", "-", "7", "5500005555555559", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1" * 30, "+1" + "(" * 50 + "2"]
    for text, got in spans_of(spark, texts):
        assert got == brute(text), text


def test_long_runs_stay_linear(spark):
    many = "1." * 20_000
    cases = [("a" * 300_000, []), ("7 " * 100_000, []), ("+1" * 50_000, []), ("." * 200_000 + "@x.y", [(0, 0, 200_004)]),
             (many, [(8 * i, 1, 8 * i + 7) for i in range(5000)])]
    for (text, got), (_, want) in zip(spans_of(spark, [text for text, _ in cases]), cases):
        assert got == want, text[:20]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    common = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"]

    def prose(n):
        return " ".join(rng.choice(common) for _ in range(n))

    rows = [(i, prose(80)) for i in range(200)]
    for i in range(6):  # one person, named beside the address in different surroundings
        rows.append((300 + i, f"{prose(10)} Zwetschgenberger mail zz@mail.example {prose(10)}"))
    copy = f"{prose(10)} Kohlrabizüchter mail yy@mail.example {prose(10)}"
    rows += [(400 + i, copy) for i in range(8)]  # copies of one passage are no evidence
    rows += [(500, None), (501, ""), (300, rows[200][1])]
    return spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, key string, added int")


def test_disclosing_terms(spark, corpus):
    base, added = pii.detect(corpus)
    rows = base.join(added, "key", "left").select(
        "doc_id", pii.described(pii.merged(F.col("base"), F.col("added"))).alias("spans")).collect()
    assert len(rows) == corpus.count()
    found = {r.doc_id: r.spans for r in rows}
    for i in range(6):
        assert found[300 + i].count("remove:") >= 1 and "email:" in found[300 + i]
    texts = {r.doc_id: r.text for r in corpus.collect()}
    name = texts[301].index("Zwetschgenberger")
    assert f"remove:{name}:{name + 16}" in found[301]
    assert all("remove" not in found[400 + i] and "general" not in found[400 + i] for i in range(8))
    assert found[500] == found[501] == found[0] == ""


def test_sanitised_text(spark, corpus):
    clean = pii.sanitised(corpus)
    assert clean.columns == corpus.columns and clean.count() == corpus.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    before = {r.doc_id: r.text for r in corpus.collect()}
    assert "Zwetschgenberger" not in texts[301] and "zz@" not in texts[301] and "<EMAIL>" in texts[301]
    assert "Kohlrabizüchter" in texts[400] and "<EMAIL>" in texts[400]
    assert texts[500] is None and texts[501] == "" and texts[0] == before[0]
    assert pii.sanitised(corpus.limit(0)).count() == 0


def test_masks(spark):
    text = "call +1 555 010 9999 or a@b.c, 1.2.3.4"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitised(df).first().text == "call <PHONE> or <EMAIL>, <IP>"
