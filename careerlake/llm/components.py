"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlake.llm.common import drop_written, written


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every larger neighbour moves to the least one, then every smaller one does.

    Least neighbours are aggregates, combined before the shuffle, and are written first, so the
    joins read plain tables and a node with very many edges is split by AQE.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = written(
        both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
        "large",
    )
    lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
    small = large.join(lower, "u").select(
        F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    ).select("e.*").filter("u <> v").distinct()
    done = written(small, "stars")
    for table in (least, large, lower):
        drop_written(table)
    return done


def _mark(edges: DataFrame):
    """Number of edges and an order-free digest of them."""
    return edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
    ).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``, root being the least node of its component.

    Edges go both ways and may repeat; self loops and nulls count as none. Each round halves the
    depth of the trees at least, so the number of rounds grows with the logarithm of a path's
    length; running out of rounds raises. No component is gathered in one place.
    """
    now = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(rounds):
        after = _stars(now)
        drop_written(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle within {rounds} rounds")
