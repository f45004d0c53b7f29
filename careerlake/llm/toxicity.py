"""Toxicity by a factorization machine over hashed terms.

    logit P(toxic | text) = bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

over the hash buckets of a text, each counted once. The factors v let two terms weigh more, or
less, together than each does alone: an insult that meets the mention of a group, where neither is
toxic by itself. The pair sum takes one pass over the buckets, as it is half the difference between
the squared sum of the factors and the sum of their squares.

A text's terms are its distinct lower-cased words and the first four and five letters of longer
ones, which stand for words of one stem. Fitting takes a sample of about ``SAMPLE`` labelled
documents, drawn by a hash of their ids, so neither the layout of the files nor the number of
tasks matters; their whole texts count. Buckets in at least ``LEAST_DOCS`` of them whose share of
toxic documents differs by ``SCREEN`` standard errors take part; the others would only learn the
sample by heart. All documents are scored, in Arrow batches and without a shuffle.

Null and empty texts have no terms and get the chance of the bias. Labels that are null, neither
0 nor 1, or without a document are not used; of labels or texts that repeat an id the least counts.
Without labels every chance is 0.25. Repeated rows get the same score each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from careerlake.llm.common import drawn, written

BUCKETS = 1 << 20
FACTORS = 8
SAMPLE = 10_000  # labelled documents
LEAST_DOCS = 5
SCREEN = 3.0
ROUNDS = 200
PENALTY = 1e-4

_WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def _terms(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    parts = [word] + [f"{word[:n]}-" for n in (4, 5) if len(word) >= n]
    return tuple(xxhash.xxh32_intdigest(part) % BUCKETS for part in parts)


def buckets_of(text: str | None) -> np.ndarray:
    """Distinct buckets of a text, in order."""
    found = set(chain.from_iterable(map(_terms, set(_WORD.findall((text or "").lower())))))
    return np.sort(np.fromiter(found, np.int32, len(found)))


@F.arrow_udf(ArrayType(IntegerType()))
def buckets(texts: pa.Array) -> pa.Array:
    return pa.array([buckets_of(t.as_py()) for t in texts], pa.list_(pa.int32()))


def _chance(logit):
    return 0.5 * (1 + np.tanh(0.5 * logit))


@dataclass(frozen=True)
class Machine:
    """Weights and factors of the buckets in use, which are in ascending order."""

    bias: float
    used: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.used, found)
        at = at[at < len(self.used)] if not len(self.used) else at[self.used[np.minimum(at, len(self.used) - 1)] == found]
        factors = self.factors[at]
        pairs = 0.5 * ((factors.sum(axis=0) ** 2).sum() - (factors**2).sum())
        return float(self.bias + self.weights[at].sum() + pairs)

    def score(self, text: Column) -> Column:
        """The chance that a text is toxic."""
        machine = self

        @F.arrow_udf(DoubleType())
        def chance(texts: pa.Array) -> pa.Array:
            return pa.array([float(_chance(machine.logit(buckets_of(t.as_py())))) for t in texts], pa.float64())

        return chance(text)


def fit(index: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> Machine:
    """Full-batch Adam on the penalised likelihood of 0/1 labels; ``index`` lists each document's buckets."""
    n, toxic = len(labels), int(labels.sum())
    share = (toxic + 0.5) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    rows = np.repeat(np.arange(n), lengths)
    used, at, docs = np.unique(index, return_inverse=True, return_counts=True)
    if 0 < toxic < n:
        mean = toxic / n
        excess = np.bincount(at, weights=labels[rows] - mean, minlength=len(used))
        telling = (docs >= LEAST_DOCS) & (np.abs(excess) >= SCREEN * np.sqrt(docs * mean * (1 - mean)))
    else:
        telling = np.zeros(len(used), bool)
    rows, at = rows[telling[at]], (np.cumsum(telling) - 1)[at[telling[at]]]
    used = used[telling]
    width = len(used)
    start = np.random.default_rng(12).normal(0, 0.05, (width, FACTORS))
    params = np.concatenate((np.zeros(width), start.ravel(), [bias]))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, ROUNDS + 1):
        weights, factors = params[:width], params[width:-1].reshape(width, FACTORS)
        here = factors[at]
        sums = np.stack([np.bincount(rows, here[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(rows, (here**2).sum(axis=1), n)
        logit = params[-1] + np.bincount(rows, weights[at], n) + 0.5 * ((sums**2).sum(axis=1) - squares)
        error = (_chance(logit) - labels) / n
        pull = error[rows][:, None] * (sums[rows] - here)
        slope = np.concatenate((
            np.bincount(at, error[rows], width) + PENALTY * weights,
            (np.stack([np.bincount(at, pull[:, f], width) for f in range(FACTORS)], axis=1) + PENALTY * factors).ravel(),
            [error.sum()],
        ))
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        rate = 0.05 * (1 - step / (ROUNDS + 1))
        params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[-1]), used, params[:width], params[width:-1].reshape(width, FACTORS))


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE,
) -> Machine:
    """Fit on labelled documents; only the texts of the sample are read on."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()
    ).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = written(drawn(known, F.col("doc_id"), sample, known.count()), "labelled")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id").groupBy(
        "doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    rows = texts.select("doc_id", "label", buckets(F.col("text")).alias("found")).orderBy("doc_id").toArrow()
    found = rows.column("found").combine_chunks()
    lengths = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return fit(found.flatten().to_numpy(zero_copy_only=False), lengths, rows.column("label").to_numpy().astype(np.int64))


def scored(docs: DataFrame, machine: Machine, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the chance of each text; a column of that name is replaced."""
    return docs.withColumn(score, machine.score(docs[text]))
