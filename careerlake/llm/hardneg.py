"""Hard negatives of anchor vectors, by a vertical scan that narrows down the candidates.

Rows are packed into blocks that hold one column per dimension, with the least and the greatest
component of each. A task reads a block's columns in the order of an anchor's component sizes,
largest first. After each few columns every candidate's score lies between its partial score plus
the least and plus the greatest that the remaining columns can add; candidates whose bounds leave
the wanted window, or fall behind enough others inside it, go. What is left at the end has exact
scores. This runs twice: for the best rows of an anchor's own label (its positives), and for the
best rows of other labels in a window below each positive's score.

Scores are integer inner products, so they are exact; products must stay within 63 bits. Every row
is compared with every anchor, block against block: chunks of anchors meet all blocks through an
equi-join on stripes of blocks, and a task returns only the first few rows of each anchor. No
group grows with the data: many rows with one vector or label are many blocks.

The joins are merges. The planner takes a packed row for a few bytes, so it would broadcast chunks
whose copies for the stripes grow with the product of anchors and rows, all through the driver.

Rows with a null id, label, vector or component take no part. Of rows that repeat an id the least by
label, then vector, counts. Vectors may differ in length; missing components are 0. Equal scores go
by the smaller id. Without anchors, positives or negatives there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.llm.common import written
from careerlake.operators.ranking import top_k

BLOCK = 4096  # rows packed together
CHUNK = 256  # anchors packed together
STRIPE = 16  # blocks that share one copy of the anchors
STRIPES = 256  # up to so many stripes, one block each will do
STEP = 8  # columns read between two looks at the bounds

_PACK = "ids array<long>, labels array<string>, scores array<array<long>>, kind string, data binary"
_ARROW = pa.schema([
    ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("scores", pa.list_(pa.list_(pa.int64()))),
    ("kind", pa.string()), ("data", pa.binary()),
])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, short ones filled with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(vectors), max(lengths.max(initial=0), 1)), np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found[np.repeat(np.arange(len(vectors)), lengths), at] = vectors.flatten().to_numpy(zero_copy_only=False)
    return found


def _packer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(rows: pa.Table) -> pa.RecordBatch:
        columns = _matrix(rows.column("vector").combine_chunks()).T
        kind = np.result_type(np.min_scalar_type(columns.min()), np.min_scalar_type(columns.max()), np.int8).name
        return pa.RecordBatch.from_pydict(
            {"ids": [rows.column("id").to_pylist()], "labels": [rows.column("label").to_pylist()],
             "scores": [rows.column("scores").to_pylist()], "kind": [kind],
             "data": [columns.astype(kind).tobytes()]}, schema=_ARROW)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield pack(pa.Table.from_batches(held))
                    held = []
        if held:
            yield pack(pa.Table.from_batches(held))

    return packed


class Columns:
    """A block's rows by dimension, with the range of each dimension."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        self.ids, self.columns = ids, columns
        self.least, self.most = columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)

    def narrowed(self, anchor: np.ndarray, alive: np.ndarray,
                 keep: Callable[[np.ndarray, int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that no bound ruled out, and their exact scores.

        ``keep`` says which partial scores may still count, given the least and the greatest sum
        that the columns to come can add.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        one, other = anchor * self.least, anchor * self.most
        least, most = np.minimum(one, other)[order], np.maximum(one, other)[order]
        rest_least, rest_most = least.sum(), most.sum()
        partial = np.zeros(len(alive), np.int64)
        for at in range(0, len(order), STEP):
            if not len(alive):
                break
            dims = order[at : at + STEP]
            partial = partial + anchor[dims] @ self.columns[np.ix_(dims, alive)].astype(np.int64)
            rest_least, rest_most = rest_least - least[at : at + STEP].sum(), rest_most - most[at : at + STEP].sum()
            good = keep(partial, int(rest_least), int(rest_most))
            alive, partial = alive[good], partial[good]
        return alive, partial

    def first(self, alive: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k``; equal scores by id."""
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[best]], scores[best]


def _at_least(partial: np.ndarray, rest_least: int, k: int) -> int | None:
    """A score that ``k`` candidates reach for sure."""
    return int(np.partition(partial, -k)[-k]) + rest_least if len(partial) >= k else None


def _leaders(k: int):
    """Keeps candidates that may be among the best ``k``."""
    def keep(partial: np.ndarray, rest_least: int, rest_most: int) -> np.ndarray:
        bound = _at_least(partial, rest_least, k)
        return np.ones(len(partial), bool) if bound is None else partial + rest_most >= bound

    return keep


def _within(windows: list[tuple[int, int]], k: int):
    """Keeps candidates that may be among the best ``k`` within one of the windows."""
    def keep(partial: np.ndarray, rest_least: int, rest_most: int) -> np.ndarray:
        low, high = partial + rest_least, partial + rest_most
        good = np.zeros(len(partial), bool)
        for floor, ceiling in windows:
            bound = _at_least(partial[(low >= floor) & (high <= ceiling)], rest_least, k)
            good |= (low <= ceiling) & (high >= (floor if bound is None else max(floor, bound)))
        return good

    return keep


def _unpacked(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(batch.column(f"{side}ids")[row].as_py(), np.int64)
    labels = np.array(batch.column(f"{side}labels")[row].as_py(), object)
    columns = np.frombuffer(batch.column(f"{side}data")[row].as_py(), batch.column(f"{side}kind")[row].as_py())
    return ids, labels, columns.reshape(-1, len(ids))


def _aligned(columns: np.ndarray, size: int) -> np.ndarray:
    return np.vstack((columns, np.zeros((size - len(columns), columns.shape[1]), columns.dtype)))


def _scan(search) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``search(block, own label?, anchor's id, vector and scores)`` for each anchor of each pair."""
    out = pa.schema([("anchor_id", pa.int64()), ("base", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, columns = _unpacked(batch, row, "")
                anchors, own, vectors = _unpacked(batch, row, "a_")
                size = max(len(columns), len(vectors))
                block, vectors = Columns(ids, _aligned(columns, size)), _aligned(vectors, size)
                same = {label: labels == label for label in set(own)}
                scores = batch.column("a_scores")[row].as_py()
                parts = [np.zeros((4, 0), np.int64)]
                for n, anchor in enumerate(anchors):
                    for base, found, score in search(block, same[own[n]], anchor, vectors[:, n].astype(np.int64), scores[n]):
                        parts.append(np.stack([np.full(len(found), anchor), np.full(len(found), base), found, score]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(parts, axis=1)], schema=out)

    return scan


def _stripes(blocks: int) -> int:
    """Stripes for so many blocks: one for each while they are few, then for ``STRIPE`` of them."""
    return max(min(blocks, STRIPES), -(-blocks // STRIPE), 1)


def _compared(anchors: DataFrame, blocks: DataFrame, stripes: int, search) -> DataFrame:
    """``anchor_id, base, found_id, score`` of every chunk of anchors against every block."""
    chunks = anchors.repartition("id").mapInArrow(_packer(CHUNK), _PACK)
    dealt = chunks.select(
        *(F.col(c).alias(f"a_{c}") for c in chunks.columns),
        F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"),
    )
    return dealt.join(blocks.hint("merge"), "stripe").mapInArrow(
        _scan(search), "anchor_id long, base long, found_id long, score long"
    )


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    row_id: str = "id", label: str = "label", vector: str = "vector",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` have an integer id, a label and a vector of integers; ``anchor`` marks the anchors. An
    anchor's positives are its best other rows of the same label. For each positive, the negatives
    are the best rows of other labels whose score lies between ``low`` and ``high`` percent of the
    positive's, numbered by ``rank``.
    """
    whole = rows.select(
        F.col(row_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<long>").alias("vector"), anchor.alias("anchor"),
    ).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull())
    )
    single = whole.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*")
    none = F.array().cast("array<long>")
    kept = written(single.withColumn("scores", none), "vectors")
    packed = written(kept.select("id", "label", "vector", "scores").mapInArrow(_packer(BLOCK), _PACK), "blocks")
    stripes = _stripes(packed.count())
    blocks = packed.drop("scores").withColumn("stripe", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(stripes)).cast("int"))
    anchors = kept.filter("anchor").select("id", "label", "vector", "scores")

    def own(block, same, anchor_id, vector_of, scores):
        alive = np.flatnonzero(same & (block.ids != anchor_id))
        yield 0, *block.first(*block.narrowed(vector_of, alive, _leaders(positives)), positives)

    order = [F.col("score").desc(), F.col("found_id")]
    best = written(
        top_k(_compared(anchors, blocks, stripes, own), ["anchor_id"], order, positives)
        .select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )

    def others(block, same, anchor_id, vector_of, scores):
        windows = {s: (-(-low * s // 100), high * s // 100) for s in scores}
        windows = {s: w for s, w in windows.items() if w[0] <= w[1]}
        if not windows:
            return
        alive, exact = block.narrowed(vector_of, np.flatnonzero(~same), _within(list(windows.values()), negatives))
        for base, (floor, ceiling) in windows.items():
            inside = (exact >= floor) & (exact <= ceiling)
            yield base, *block.first(alive[inside], exact[inside], negatives)

    wanted = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    found = top_k(
        _compared(anchors.drop("scores").join(wanted.hint("merge"), "id").select("id", "label", "vector", "scores"), blocks, stripes, others),
        ["anchor_id", "base"], order, negatives,
    ).select("anchor_id", F.col("base").alias("positive_score"), "rank", F.col("found_id").alias("negative_id"),
             F.col("score").alias("negative_score"))
    return best.join(found.hint("merge"), ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
