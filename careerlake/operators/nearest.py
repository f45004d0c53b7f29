"""Exact candidate search of any number of requests over any number of documents.

Documents are packed into blocks and requests into chunks. Every chunk meets every block through an
equi-join on stripes of blocks, so requests travel as rows, however many there are, and the documents
are read once. A task compares a block with a chunk as matrix products and keeps only the best few per
request, so it never emits request-document pairs. Search terms are looked up beforehand, all in one
pass over each text; texts do not take part in the comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from careerlake.functions.matching import search_terms
from careerlake.operators.ranking import top_k

# Fixed value: candidates each branch may give to the ranking.
BRANCH_SIZE = 300

BLOCK = 4096  # documents packed together
CHUNK = 512  # requests packed together
TERMS = 100_000  # terms of one automaton; more are looked up in several passes

NO_DISTANCE = 9.0  # stands for the missing distance to a vector without length; true ones are at most 2
_MARKS = T.ArrayType(T.LongType())


def term_mark(term: Column) -> Column:
    """The number that stands for a term."""
    return F.xxhash64(term)


def _automaton(words: Sequence[tuple[str, int]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, mark in words:
        found.add_word(word, mark)
    found.make_automaton()
    return found


def _looked_up(terms: list[Row], low: Column, padded: Column) -> Column:
    """Marks of a bounded list of terms that a text mentions; long terms anywhere, short ones as whole words."""
    anywhere = [(t.word, t.mark) for t in terms if t.whole is None and t.pattern is None]
    whole = [(t.whole, t.mark) for t in terms if t.whole is not None]
    held: list[ahocorasick.Automaton] = []  # built once per task

    @F.arrow_udf(_MARKS)
    def marks(lows: pa.Array, paddeds: pa.Array) -> pa.Array:
        if not held:
            held.extend([_automaton(anywhere), _automaton(whole)])
        rows = []
        for texts in zip(lows.to_pylist(), paddeds.to_pylist(), strict=True):
            found = set()
            for automaton, text in zip(held, texts, strict=True):
                if text and len(automaton):
                    found.update(mark for _, mark in automaton.iter(text))
            rows.append(sorted(found))
        return pa.array(rows, pa.list_(pa.int64()))

    # Short terms that hold other characters need the boundary rule of the pattern.
    others = [F.when(F.regexp_like(low, F.lit(t.pattern)), F.lit(t.mark)) for t in terms if t.pattern is not None]
    return F.concat(marks(low, padded), F.array_compact(F.array(*others))) if others else marks(low, padded)


def mentioned_marks(terms: DataFrame, texts: Sequence[Column]) -> Column:
    """Marks of the terms (column ``term``) that any of the searchable texts mentions.

    The terms are read to the driver ``TERMS`` at a time; each part is one automaton.
    """
    listed = terms.select("term").distinct()
    described = listed.select(
        F.element_at(search_terms(F.array("term")), 1).alias("t"), term_mark(F.col("term")).alias("mark")
    ).select("t.word", "t.whole", "t.pattern", "mark")
    rows = described.limit(TERMS + 1).collect()
    parts = [rows]
    if len(rows) > TERMS:
        count = 2 * (listed.count() // TERMS + 1)  # twice as many as needed, so that no part is too large
        parts = [described.filter(F.pmod("mark", F.lit(count)) == n).collect() for n in range(count)]
    low = F.concat_ws("\0", *[t["low"] for t in texts])
    padded = F.concat_ws("\0", *[t["padded"] for t in texts])
    return F.array_distinct(F.concat(*[_looked_up(p, low, padded) for p in parts if p] or [F.array().cast("array<bigint>")]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """Batches cut where column ``stripe`` changes, with its value; whole ones without that column."""
    for batch in batches:
        if "stripe" not in batch.schema.names:
            yield None, batch
        elif batch.num_rows:
            stripes = batch.column("stripe").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(stripes[1:] != stripes[:-1]) + 1).tolist(), len(stripes)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                yield int(stripes[begin]), batch.slice(begin, end - begin)


def _packer(size: int, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns up to ``size`` rows, of one stripe if they have any, into one; vectors are laid end to end."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = {}
        for name in names:
            column = pa.concat_arrays([batch.column(name) for batch in held])
            column = column.flatten() if name == "embedding" else column
            columns[name] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for stripe, batch in _runs(batches):
            if rows and stripe != last:
                yield pack(held)
                held, rows = [], 0
            last = stripe
            while batch.num_rows:
                held.append(batch.slice(0, size - rows))
                batch = batch.slice(size - rows)
                rows += held[-1].num_rows
                if rows == size:
                    yield pack(held)
                    held, rows = [], 0
        if rows:
            yield pack(held)

    return packed


def packed_rows(df: DataFrame, size: int, prefix: str = "") -> DataFrame:
    """Up to ``size`` rows of a task as one row of lists, their columns renamed by a prefix."""
    schema = ", ".join(
        f"{f.name} {'array<double>' if f.name == 'embedding' else f'array<{f.dataType.simpleString()}>'}" for f in df.schema)
    packed = df.mapInArrow(_packer(size, df.columns), schema)
    return packed.select(*(F.col(c).alias(f"{prefix}{c}") for c in packed.columns))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN, as its cosine is undefined."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / length


def _flags(lists: pa.ListArray, wanted: np.ndarray) -> np.ndarray:
    """Which rows of a list column hold which of the wanted marks, as a table of zeros and ones."""
    table = np.zeros((len(lists), len(wanted)), np.float32)
    marks = lists.flatten().to_numpy(zero_copy_only=False)
    if len(wanted) and len(marks):
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.minimum(np.searchsorted(wanted, marks), len(wanted) - 1)
        met = wanted[at] == marks
        table[rows[met], at[met]] = 1
    return table


def _best(distances: np.ndarray, allowed: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Request, document and distance of the best ``size`` documents of each request."""
    seen = distances if allowed is None else np.where(allowed, distances, np.inf)
    chosen = np.argsort(seen, axis=1, kind="stable")[:, :size]
    values = np.take_along_axis(seen, chosen, axis=1).ravel()
    rows, kept = np.repeat(np.arange(len(seen)), chosen.shape[1]), values < np.inf
    return rows[kept], chosen.ravel()[kept], values[kept]


def _compare(size: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cell(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        of = {name: batch.column(name)[row].values for name in batch.schema.names if name != "stripe"}
        ids = of["job_id"].to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")  # so that places among equals follow the ids
        units = unit_rows(of["embedding"].to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order])
        count = len(of["q_query_id"])
        wanted = unit_rows(of["q_embedding"].to_numpy(zero_copy_only=False).reshape(count, -1))
        # Rounding far below float precision makes equal vectors tie exactly.
        distances = np.nan_to_num(np.round(1.0 - wanted @ units.T, 12), nan=NO_DISTANCE)

        def out(scope: str, branch: str, some: np.ndarray, found) -> pa.RecordBatch:
            rows, places, values = found
            return pa.RecordBatch.from_arrays(
                [of["q_query_id"].take(pa.array(some[rows])), pa.array(ids[order[places]]),
                 pa.array([scope] * len(rows)), pa.array([branch] * len(rows)),
                 pa.array(np.where(values == NO_DISTANCE, np.nan, values))], schema=schema)

        everyone = np.arange(count)
        if "q_places" not in of:
            yield out("wide", "vector", everyone, _best(distances, None, size))
            return
        sizes = {side: of[f"q_{side}"].value_lengths().to_numpy(zero_copy_only=False) for side in ("places", "words")}
        met = {}
        for side in ("places", "words"):
            used = np.unique(of[f"q_{side}"].flatten().to_numpy(zero_copy_only=False))
            met[side] = _flags(of[f"q_{side}"], used) @ _flags(of[side].take(pa.array(order)), used).T
        near = (met["places"] > 0) | (sizes["places"] == 0)[:, None]
        titled = met["words"] == sizes["words"][:, None]
        placed, worded = sizes["places"] > 0, sizes["words"] > 0
        level = np.zeros_like(distances)
        for scope, some, mask in (("near", np.ones(count, bool), near), ("wide", placed, np.ones_like(near))):
            yield out(scope, "vector", everyone[some], _best(distances[some], mask[some], size))
            asked = some & worded
            yield out(scope, "keyword", everyone[asked], _best(level[asked], (mask & titled)[asked], size))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from cell(batch, row)

    return compared


def _against(docs: DataFrame, requests: DataFrame, size: int, chunk: int) -> DataFrame:
    """The best of each block for each request, scope and branch."""
    spark = docs.sparkSession
    stripes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = packed_rows(docs, BLOCK).withColumn("stripe", F.pmod(F.xxhash64(F.element_at("job_id", 1)), F.lit(stripes)))
    chunks = packed_rows(requests.repartition("query_id"), chunk, "q_").withColumn(
        "stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint"))))
    return compare_blocks(chunks.join(blocks, "stripe"), size, requests.schema["query_id"].dataType, docs.schema["job_id"].dataType)


def compare_blocks(pairs: DataFrame, size: int, query_id: T.DataType, job_id: T.DataType) -> DataFrame:
    """The best of each pair of a chunk and a block."""
    schema = pa.schema([
        ("query_id", to_arrow_type(query_id)), ("job_id", to_arrow_type(job_id)), ("scope", pa.string()),
        ("branch", pa.string()), ("vector_distance", pa.float64())])
    return pairs.mapInArrow(
        _compare(size, schema), f"query_id {query_id.simpleString()}, job_id {job_id.simpleString()}, "
                                "scope string, branch string, vector_distance double")


_VECTOR = "CAST(embedding AS array<double>) AS embedding"


def candidates(docs: DataFrame, requests: DataFrame, size: int = BRANCH_SIZE, chunk: int = CHUNK) -> DataFrame:
    """Best documents per request, scope and branch.

    ``docs(job_id, embedding, places, words)`` and ``requests(query_id, embedding, places, words)`` list
    marks of terms: those that a document mentions, in its texts and in its title, and those that a
    request asks for. Scope ``near`` honours the places, ``wide`` ignores them and exists only for
    requests that name places. Branch ``vector`` takes the smallest cosine distance, ``keyword`` the
    smallest ids among titles with all wanted words, at distance 0.
    """
    columns = [_VECTOR, "places", "words"]
    local = _against(docs.filter("embedding IS NOT NULL").selectExpr("job_id", *columns),
                     requests.selectExpr("query_id", *columns), size, chunk)
    return top_k(local, ["query_id", "scope", "branch"], [F.col("vector_distance"), F.col("job_id")], size, "branch_rank")


def nearest(docs: DataFrame, requests: DataFrame, k: int = BRANCH_SIZE, chunk: int = CHUNK) -> DataFrame:
    """Exact k nearest documents of each request by cosine distance.

    Documents without a vector are left out; one of length 0 has no distance and comes last.
    """
    local = _against(docs.filter("embedding IS NOT NULL").selectExpr("job_id", _VECTOR), requests.selectExpr("query_id", _VECTOR), k, chunk)
    ranked = top_k(local, ["query_id"], [F.col("vector_distance"), F.col("job_id")], k)
    return ranked.select(
        "query_id", "job_id", F.nullif("vector_distance", F.lit(float("nan"))).alias("vector_distance"), "rank")
