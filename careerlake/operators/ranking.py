"""Numbering, tie ranks and top-k that hold for tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.session import checkpointed


# Up to this many rows per group Spark limits groups below the exchange; beyond it, groups are
# limited in parts first.
GROUP_LIMIT = 1000
PARTS = 64


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          out: str = "rank") -> DataFrame:
    """First ``k`` rows of each group in the given order, numbered from 1.

    A filter on ``row_number`` is planned with a group limit below the exchange, so
    each task sends at most ``k`` rows of a group, however large the group is. For larger
    ``k`` a group is first cut into parts by a hash of its rows, and each gives ``k`` rows.
    """
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        inside = Window.partitionBy(*group, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_at", F.row_number().over(inside)).filter(
            F.col("_at") <= k).drop("_part", "_at")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def _ranged(df: DataFrame, order: Sequence[Column], slices: int | None) -> DataFrame:
    """Rows cut into ordered slices; the cut is written down, so it cannot change.

    Without a number given there are at most as many slices as shuffle partitions; AQE
    joins neighbouring small ones.
    """
    cut = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return checkpointed(cut.withColumn("_slice", F.spark_partition_id()))


def _running_total(df: DataFrame, order: Sequence[Column], weight: Column,
                   out: str, slices: int | None) -> DataFrame:
    """Sum of ``weight`` over all rows that come earlier in the order."""
    ranged = _ranged(df, order, slices).withColumn("_weight", weight.cast("bigint"))
    totals = ranged.groupBy("_slice").agg(F.sum("_weight").alias("_total"))
    # One row per slice, so as few rows as there are slices, whatever the table holds.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0).cast("bigint")).alias("_offset"),
    )
    inside = (
        Window.partitionBy("_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_weight").over(inside), F.lit(0).cast("bigint"))
    return (
        ranged.withColumn("_before", before)
        .join(F.broadcast(offsets), "_slice")
        .withColumn(out, F.col("_before") + F.col("_offset"))
        .drop("_slice", "_weight", "_before", "_offset")
    )


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "row_number",
                slices: int | None = None) -> DataFrame:
    """Dense numbers 1, 2, 3 ... over the whole table without a one-task window.

    The order should leave no ties among many rows, as equal rows share a slice.
    """
    numbered = _running_total(df, order, F.lit(1), out, slices)
    return numbered.withColumn(out, F.col(out) + 1)


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), ascending: bool = True,
                 out: str = "rank", slices: int | None = None) -> DataFrame:
    """Rank in which equal values share the mean of their positions.

    Rows are first counted per value, so neither a hot value nor a hot group is
    ever gathered in one task. A NULL value has no rank.
    """
    keys = list(by)
    direction = F.col(value).asc() if ascending else F.col(value).desc()
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    order = [F.col(k) for k in keys] + [direction]
    placed = _running_total(counts, order, F.col("_rows"), "_ahead", slices)
    if keys:
        starts = placed.groupBy(*keys).agg(F.min("_ahead").alias("_start"))
        placed = placed.join(starts, keys)
    else:
        placed = placed.withColumn("_start", F.lit(0))
    ranks = placed.select(
        *keys, value,
        (F.col("_ahead") - F.col("_start") + (F.col("_rows") + 1) / 2).alias(out),
    )
    return df.join(ranks, [*keys, value], "left")


def average_rank_in_window(value: Column, by: Sequence[str], ascending: bool = True) -> Column:
    """The same rank as a window expression, for groups of proven bounded size."""
    order = value.asc() if ascending else value.desc()
    ranked = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")),
                  ranked + (ties - 1) / F.lit(2))


def fused_score(first_rank: Column, second_rank: Column, constant: int = 60) -> Column:
    """Reciprocal rank fusion of two ranks."""
    return 1 / (F.lit(constant) + first_rank) + 1 / (F.lit(constant) + second_rank)
