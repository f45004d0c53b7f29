"""SimHash near duplicates, found by pigeonring filtering.

A fingerprint's 64 bits form a ring of eight 8-bit segments. If two fingerprints differ in at
most three bits, then from some segment on every run of l consecutive segments differs in at
most 3 * l / 8 bits, rounded down: 0, 0, 1, 1, 1, 2, 2, 3. So the first two segments are equal
and the next three differ in one bit at most, that is in at most one of them. A key is a start
segment, the two segments there, and two of the next three: 24 keys of 32 bits for each
fingerprint. Pairs that share a key must keep the budgets of the longer runs before all 64 bits
are compared.

Exact copies and equal fingerprints are folded before any comparison. A key with many different
fingerprints is cut into blocks, and pairs of blocks go to different tasks. A task returns links
of small groups and, for larger ones, one link per member to the least of those it is connected
with there; so the output stays linear in the input, and components are exact.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows keep
their number. A null document id never names a component unless all ids of it are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from careerlake.llm.common import fresh, row_key, written
from careerlake.llm.components import components

SHINGLE = 3
SEED = 42
REACH = 3  # bits that may differ; the keys below are derived for it
SEGMENTS = 8
BLOCK = 4096  # fingerprints of a key that one task compares at a time
FEW = 32  # groups up to this size return their links as they are


def ascii_words(text: str | None) -> list[bytes]:
    """Words as the fingerprint's contract has them: only A-Z are lower-cased, only ASCII spaces part words."""
    return (text or "").encode().lower().split()


def shingle_hashes(text: str | None, width: int, split: Callable[[str | None], list[bytes]] = ascii_words) -> np.ndarray:
    """Hashes of a text's shingles of ``width`` words, in order; too few words make one, none none."""
    words = split(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _fingerprint(text: str | None) -> int:
    hashes = shingle_hashes(text, SHINGLE)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    value = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)
    return int(value[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """SimHash of a text's three-word shingles, as a signed long."""
    return pd.Series([_fingerprint(t) for t in texts], dtype="int64")


def hex_of(value: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: table number, then 32 bits of four segments."""
    segment = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        run = [segment[(start + k) % SEGMENTS] for k in range(5)]
        for masked in (2, 3, 4):
            key = F.lit((start * 3 + masked - 2) << 32).cast("long")
            for place, part in enumerate(run[:masked] + run[masked + 1 :]):
                key = key.bitwiseOR(F.shiftleft(part, 8 * place))
            keys.append(key)
    return F.array(*keys)


def _near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs keep the budgets; fingerprints are turned to start at the key's segment."""
    apart = one ^ other
    good = np.bitwise_count(apart & np.uint64((1 << 40) - 1)) <= 1
    good[good] = np.bitwise_count(apart[good] & np.uint64((1 << 56) - 1)) <= 2
    good[good] = np.bitwise_count(apart[good]) <= REACH
    return good


def _turned(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    by = ((keys >> 32) // 3 * 8).astype(np.uint64)
    return (fps >> by) | np.where(by > 0, fps << ((np.uint64(64) - by) & np.uint64(63)), np.uint64(0))


def _forest(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member connected with an earlier one: its place, and that of the first."""
    left = np.arange(len(turned))
    members, firsts = [], []
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            here = queue.pop()
            near = _near(turned[left], turned[here])
            found, left = left[near], left[~near]
            queue.extend(found.tolist())
            members.append(found)
            firsts.append(np.full(len(found), first))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *members]), np.concatenate([empty, *firsts])


def _links_of(keys: np.ndarray, group_ends: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of consecutive rows; ``group_ends`` has each row's end of group."""
    turned = _turned(keys, fps)
    row = np.arange(len(fps))
    starts = np.concatenate(([True], group_ends[1:] != group_ends[:-1])) if len(fps) else np.zeros(0, bool)
    sizes = group_ends - np.maximum.accumulate(np.where(starts, row, 0))
    one, other = [], []
    few = row[sizes <= FEW]
    for step in range(1, FEW):
        few = few[few + step < group_ends[few]]
        if not len(few):
            break
        near = few[_near(turned[few], turned[few + step])]
        one.append(near)
        other.append(near + step)
    for begin in row[starts & (sizes > FEW)]:
        member, first = _forest(turned[begin : group_ends[begin]])
        one.append(begin + member)
        other.append(begin + first)
    empty = np.zeros(0, np.int64)
    return fps[np.concatenate([empty, *one])], fps[np.concatenate([empty, *other])]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell of rows sorted by key and cell; a cell may span batches."""

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, low, high, fps = columns
        change = (keys[1:] != keys[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        ends = np.append(np.flatnonzero(change) + 1, len(keys))
        group_ends = ends[np.searchsorted(ends, np.arange(len(keys)), side="right")]
        u, v = _links_of(keys, group_ends, fps.astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "low", "high", "fp")]
        held = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(held[0]):
            continue
        same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield out([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if len(held[0]):
        yield out(held)


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links that connect the distinct fingerprints ``fp`` as those in reach do."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    heavy = written(
        keyed.groupBy("key").count().filter(F.col("count") > BLOCK)
        .select("key", F.ceil(F.col("count") / BLOCK).alias("blocks")),
        "heavy",
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    cells = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1),
            lambda o: F.struct(F.least(o, mine).alias("low"), F.greatest(o, mine).alias("high")),
        )
    )
    dealt = keyed.join(heavy, "key", "left").select("fp", "key", F.explode(cells).alias("c")).select("fp", "key", "c.*")
    return (
        dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(_link, "u long, v long").distinct()
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, doc_id, fp, root, component_id`` for every row of ``docs``.

    ``key`` names a row by id and text, ``root`` a group by one of its fingerprints. Texts are read
    once and never shuffled; the rest works on fingerprints.
    """
    marked = written(docs.select(
        row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"),
        fingerprint(F.col(text)).alias("fp"),
    ), "prints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(prints))
    linked = written(prints.join(roots, prints.fp == roots.node).select("fp", "root", "least_id"), "linked")
    named = written(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    named_prints = linked.join(named, "root").select("fp", "root", "component_id", F.lit(True).alias("linked"))
    resolved = written(
        prints.join(named_prints, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"),
            F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"),
        ),
        "resolved",
    )
    return marked.join(resolved, "fp").select("key", "doc_id", "fp", "root", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that with the least id, ids that are null last.

    The choice is an aggregate over narrow rows. Rows that repeat id and text are one.
    """
    found = near_duplicates(docs, doc_id, text)
    chosen = written(
        found.groupBy("root").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("first")
        ).select("first.key"),
        "chosen",
    )
    name = fresh(docs, "row_key")
    kept = docs.withColumn(name, row_key(docs[doc_id], docs[text])).join(
        chosen.withColumnRenamed("key", name), name, "left_semi"
    )
    return kept.dropDuplicates([name]).drop(name)
