"""Quality rules against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from careerlake.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for starts in places.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(5)
    words = ["a", "bé", "c#", "|", "日本", "word", "𝄞x"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randint(0, 120)))
            for _ in range(80)]
    return [None, "", " \n\t", "one", "x " * 9000, "line\n" * 50, "a b c d e f g h " * 2, *made]


def test_measurements(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    judged, name = quality.ledger(docs)
    for row in judged.collect():
        m = row[name].measured
        got = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
        assert got == brute(row.text), row.text


@pytest.mark.parametrize("text, bit", [
    ("few words only", 0), ("one two three four five six seven eight " * 5, 1), ("dollar$$$ sign### star*** " * 10, 2),
    ("same line here\n" * 10, 3), ("a b c d e f g h i j " * 3, 4), ("LOUD WORDS " * 15, 5), ("ha " * 40, 6),
])
def test_each_rule_fails_its_text(spark, text, bit):
    bits = spark.createDataFrame([(text,)], "text string").select(quality.entry_of(F.col("text")).bits).first()[0]
    assert bits >> bit & 1


def test_clean_text_passes_and_columns_stay(spark):
    clean = " ".join(f"word{i} and" for i in range(40))
    docs = spark.createDataFrame([(1, clean, "x", 5), (1, clean, "x", 5), (2, None, "y", 6)],
                                 "doc_id long, text string, _ledger string, kept int")
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1, 1]
    assert "_ledger" in quality.ledger(docs)[0].columns


def test_ablations(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "bits long")
    rows = {r.rule: r for r in quality.ablations(ledger, quality.STANDARD).collect()}
    assert rows["few_words"].docs == 6 and rows["few_words"].kept == 1
    assert (rows["few_words"].failing, rows["few_words"].only_this) == (3, 2)
    assert (rows["repeated_windows"].failing, rows["repeated_windows"].only_this) == (1, 0)
    base = quality.ablations(ledger, quality.BASE).first()
    assert base.kept == 3 and base.policy == "base-1"
    empty = quality.ablations(ledger.limit(0), quality.STANDARD).first()
    assert (empty.docs, empty.kept, empty.failing) == (0, 0, 0)


def test_empty_table(spark):
    assert quality.accepted(spark.createDataFrame([], "doc_id long, text string")).count() == 0
