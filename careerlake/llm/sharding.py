"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A uniform permutation of all rows, cut into shards, sends a random number of rows from each
block of input to each shard; those numbers are multivariate hypergeometric. So they are drawn
first: one matrix row per block, each from the places its predecessors have left, which makes all
shard sizes exact. Then each block is permuted locally and dealt out by its matrix row, rows are
exchanged, and each shard is permuted again.

Blocks are the files of a written table with a bounded number of rows, so a block's permutation
is small work, and a lost task repeats it alike. A shard is as large as the data asks, so its
permutation is a random number per row, cut into cells of bounded size that are ordered each on
its own; counts per cell give the places where cells begin.

Shards differ by one row at most, whatever the texts: equal texts, null and empty ones are rows
like others. Random numbers depend on the seed and a row's block and place, so rows that are
equal in all columns still get places of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.llm.common import fresh, keep_until_exit, written

BLOCK_ROWS = 100_000
CELL_ROWS = 50_000
SEED = 20


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good, for populations of any size.

    Inverts the distribution: chances next to each other have a simple ratio, so they follow from the
    likeliest number outwards, over twelve standard deviations and more; what lies beyond weighs less
    than the rounding of a double.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = (drawn + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(total - 1, 1)))
    reach = math.ceil(12 * spread) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(ratios)))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def matrix(block_rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows that each block sends to each shard: row sums are the blocks, column sums the shards."""
    rng = np.random.default_rng(seed)
    total = sum(block_rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    sent = np.zeros((len(block_rows), shards), np.int64)
    for b, rows in enumerate(block_rows):
        left, rest = rows, sum(room)
        for s in range(shards):
            rest -= room[s]
            sent[b, s] = _hypergeometric(rng, room[s], rest, left)
            left -= int(sent[b, s])
        room = [r - int(n) for r, n in zip(room, sent[b], strict=True)]
    return sent


def _random(seed: int, stage: int, block: Column, place: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(stage), block, place)


def shuffled(df: DataFrame, shards: int = 16, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    Columns of ``df`` with those names are replaced. All columns of ``df`` move once into shards.
    The driver holds one count per block and shard, never a row.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    block, place, rank, cut, draw, cell, base = (
        fresh(df, stem) for stem in ("block", "place", "rank", "cut", "draw", "cell", "base")
    )
    path = keep_until_exit(spark, "blocks")
    df.write.option("maxRecordsPerFile", block_rows).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias(block), F.col("_metadata.row_index").alias(place)
    )
    counts = stored.groupBy(block).agg(F.count(F.lit(1)).alias("n")).collect()
    # A file's name has its task and number before the random part, so this order is repeatable.
    blocks = sorted((r[block], r["n"]) for r in counts)
    sent = matrix([n for _, n in blocks], shards, seed)
    ends = [(name, i, np.cumsum(row).tolist()) for i, ((name, _), row) in enumerate(zip(blocks, sent, strict=True))]
    number = fresh(df, "number")
    dealt = spark.createDataFrame(ends, f"`{block}` string, `{number}` long, `{cut}` array<long>")

    # Permute each block and deal it out: the first rows of the new order go to shard 0, and so on.
    numbered = stored.join(written(dealt, "matrix"), block)
    local = Window.partitionBy(number).orderBy(_random(seed, 1, F.col(number), F.col(place)), place)
    sharded = numbered.withColumn(rank, F.row_number().over(local) - 1).withColumn(
        "shard", F.size(F.filter(cut, lambda end: end <= F.col(rank))).cast("int")
    ).drop(rank, cut)

    # Exchange by cells of shards, and permute each.
    total = sum(n for _, n in blocks)
    cells = max(1, math.ceil(total / shards / CELL_ROWS))
    moved = written(
        sharded.withColumn(draw, _random(seed, 2, F.col(number), F.col(place))).withColumn(
            cell, F.pmod(F.shiftrightunsigned(F.col(draw), 20), F.lit(cells))
        ),
        "sharded",
    )
    sizes = moved.groupBy("shard", cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        sizes.select("shard", cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base)), "starts"
    )
    inside = Window.partitionBy("shard", cell).orderBy(draw, number, place)
    return moved.join(starts, ["shard", cell]).withColumn(
        "slot", (F.col(base) + F.row_number().over(inside) - 1).cast("long")
    ).select(*df.columns, "shard", "slot")
