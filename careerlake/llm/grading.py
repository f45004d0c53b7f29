"""Graded quality by ordinal cumulative-link regression on hashed texts.

One weight per hash bucket is shared by all grades, and ordered thresholds cut the score:

    P(grade <= k | text) = 1 / (1 + exp(score - threshold[k]))

A text's buckets are those of its distinct lower-cased words and of a few coarse measures (length,
shares of symbols, capitals, different words and repeats), each counted once. Fitting minimises
the likelihood with an L2 penalty, over buckets whose documents differ from the rest in mean grade:
most words tell nothing, and their weights would only learn the sample by heart. Fitting takes a
sample of about ``SAMPLE`` labelled rows, drawn by a hash of their ids; every document is scored, in Arrow batches and
without a shuffle.

Null and empty texts have the buckets of their measures alone. Labels without a document, or
without a grade, are not used; without any label all weights are zero and thresholds are 0, 1, ...
Repeated rows get the same grade each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from careerlake.llm.common import drawn, fresh, written

BUCKETS = 1 << 18
SAMPLE = 6000  # rated documents
ROUNDS = 200
PENALTY = 1e-4
LEAST_DOCS = 5  # of the sample; buckets in fewer have no weight
SCREEN = 5.0  # standard errors by which a bucket's mean grade must differ to have a weight


_WORD = re.compile(r"[^\W_]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_CAPITALS = re.compile(r"[A-ZÀ-Þ]+")


def buckets_of(text: str | None) -> np.ndarray:
    """Distinct hash buckets of a text's words and measures, in order."""
    text = text or ""
    parts = text.split()
    n, size = max(len(parts), 1), max(len(text), 1)
    marks = {
        "length": n.bit_length(),
        "symbols": 10 * len(_SYMBOLS.findall(text)) // n,
        "capitals": 10 * sum(map(len, _CAPITALS.findall(text))) // size,
        "different": 10 * len(set(parts)) // n,
        "repeats": 10 * sum(map(str.__eq__, parts, parts[1:])) // n,
    }
    terms = set(_WORD.findall(text.lower())) | {f"{name} {min(value, 20)}" for name, value in marks.items()}
    return np.unique(np.array([xxhash.xxh32_intdigest(t) % BUCKETS for t in terms], np.int32))


@F.pandas_udf(ArrayType(IntegerType()))
def buckets(texts: pd.Series) -> pd.Series:
    return pd.Series([buckets_of(t) for t in texts])


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights, and thresholds in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: Column) -> Column:
        weights = self.weights

        @F.pandas_udf(DoubleType())
        def total(texts: pd.Series) -> pd.Series:
            return pd.Series([weights[buckets_of(t)].sum() for t in texts], dtype="float64")

        return total(text)

    def tails(self, score: Column) -> list[Column]:
        """P(grade > k) for k = 0 .. K - 1."""
        return [F.lit(1.0) / (F.exp(F.lit(float(t)) - score) + 1.0) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(index: np.ndarray, lengths: np.ndarray, grades: np.ndarray, top: int) -> OrdinalModel:
    """Full-batch Adam on the penalised likelihood; thresholds are a first one and positive gaps."""
    n = len(grades)
    rows = np.repeat(np.arange(n), lengths)
    docs = np.bincount(index, minlength=BUCKETS)
    excess = np.bincount(index, weights=(grades - grades.mean())[rows], minlength=BUCKETS)
    errors = np.abs(excess) / np.sqrt(np.maximum(docs, 1) * max(grades.var(), 1e-9))
    telling = (docs >= LEAST_DOCS) & (errors >= SCREEN)
    buckets_in_use = np.flatnonzero(telling)
    rows, index = rows[telling[index]], np.searchsorted(buckets_in_use, index[telling[index]])
    width = len(buckets_in_use)
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / n, 0.02, 0.98)
    cuts = np.log(shares / (1 - shares))
    params = np.concatenate((np.zeros(width), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))))

    def ordered(free: np.ndarray) -> np.ndarray:
        return np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))

    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, ROUNDS + 1):
        weights, free = params[:width], params[width:]
        score = np.bincount(rows, weights=weights[index], minlength=n)
        edges = np.concatenate(([-np.inf], ordered(free), [np.inf]))
        upper, lower = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        chance = np.maximum(upper - lower, 1e-9)
        slope_up, slope_low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_score = slope_up - slope_low  # of the negative log likelihood
        d_cut = np.bincount(np.minimum(grades, top - 1), np.where(grades < top, -slope_up, 0), top)
        d_cut += np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, slope_low, 0), top)
        tail_sums = np.cumsum(d_cut[::-1])[::-1] / n
        slope = np.concatenate((
            np.bincount(index, weights=d_score[rows], minlength=width) / n + PENALTY * weights,
            tail_sums[:1], tail_sums[1:] * np.exp(free[1:]),
        ))
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        rate = 0.1 * (1 - step / (ROUNDS + 1))
        params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[buckets_in_use] = params[:width]
    return OrdinalModel(weights, ordered(params[width:]))


def train(
    docs: DataFrame, grades: DataFrame, top: int, doc_id: str = "doc_id", text: str = "text",
    grade: str = "grade", sample: int = SAMPLE,
) -> OrdinalModel:
    """Fit on graded documents, grades 0 .. ``top``.

    The sample is taken from the narrow table of grades, so only its documents' texts are read on,
    and the planner can broadcast it.
    """
    known = grades.select(F.col(doc_id).alias("doc_id"), F.col(grade).cast("int").alias("grade")).filter(
        F.col("grade").between(0, top) & F.col("doc_id").isNotNull()
    ).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = written(drawn(known, F.col("doc_id"), sample, known.count()), "graded")
    # One row per id, however often it repeats; texts are looked at after that.
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id").groupBy(
        "doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    rows = texts.select("doc_id", "grade", buckets(F.col("text")).alias("found")).orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return OrdinalModel(np.zeros(BUCKETS), np.arange(top, dtype=float))
    found = rows.column("found").combine_chunks()
    lengths = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return fit(found.flatten().to_numpy(zero_copy_only=False), lengths, rows.column("grade").to_numpy().astype(np.int64), top)


def graded(docs: DataFrame, model: OrdinalModel, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_1`` .. ``tail_K``, the chances of reaching a grade;
    columns of those names are replaced."""
    score = fresh(docs, "score")
    scored = docs.withColumn(score, model.score(docs[text]))
    tails = model.tails(F.col(score))
    expected = tails[0]
    for tail in tails[1:]:
        expected = expected + tail
    made = {f"{prefix}tail_{k + 1}": tail for k, tail in enumerate(tails)}
    return scored.withColumns(made | {f"{prefix}expected_grade": expected}).drop(score)
