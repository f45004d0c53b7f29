"""Nearest documents by cells: an approximate search that reads few of them, and an exact one.

Centroids are fitted on a bounded sample; every document lies in the cell of its nearest centroid. A
request looks into the cells whose centroids are nearest to it, which is the approximate search. The
exact search then looks into all other cells that may hold something nearer: a document of a cell is
at least as far from the request, as an angle, as the centroid less the cell's radius.

Cells are dealt out in blocks, so a cell with a third of all documents is many tasks. Documents
without vector length lie in a cell of their own, which only the exact search looks into.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerlake.operators.nearest import BLOCK, BRANCH_SIZE, CHUNK, compare_blocks, packed_rows, unit_rows
from careerlake.operators.ranking import top_k
from careerlake.session import checkpointed

SAMPLE = 20_000  # documents that centroids are fitted on
SLICES = 16  # parts that a cell is dealt over
NOWHERE = -1  # cell of vectors without length


def fit_centroids(docs: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """At most ``cells`` unit centroids of about ``sample`` documents, drawn by a hash of their ids."""
    known = docs.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    share = min(1.0, sample / max(known.count(), 1))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(seed), "job_id"), F.lit(1 << 30)) < share * (1 << 30))
    vectors = drawn.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if vectors.isEmpty():
        return np.zeros((0, 1))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(vectors)
    return unit_rows(np.array(model.clusterCenters()))


def _angles(column: pa.Array, centroids: np.ndarray) -> np.ndarray:
    """Angles between vectors and centroids; NaN for vectors without length."""
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.arccos(np.clip(unit_rows(vectors) @ centroids.T, -1, 1))


@dataclass(frozen=True)
class CellIndex:
    """``docs(job_id, embedding, cell)``, the centroids, and each cell's radius and size."""

    docs: DataFrame
    centroids: np.ndarray
    cells: list[Row]

    @classmethod
    def build(cls, docs: DataFrame, path: str, cells: int = 256, sample: int = SAMPLE) -> "CellIndex":
        """Lay out the documents by cell below a path."""
        centroids = fit_centroids(docs, cells, sample)

        @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
        def place(column: pa.Array) -> pa.Array:
            if not len(centroids):
                cell, angle = np.full(len(column), NOWHERE), np.full(len(column), np.pi)
            else:
                angles = _angles(column, centroids)
                bad = np.isnan(angles).any(axis=1)
                angles = np.where(bad[:, None], np.pi, angles)
                cell = np.where(bad, NOWHERE, angles.argmin(axis=1))
                angle = angles.min(axis=1)
            return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(angle)], ["cell", "angle"])

        placed = docs.filter("embedding IS NOT NULL").select("job_id", "embedding", place(F.col("embedding")).alias("p"))
        placed.select("job_id", "embedding", "p.angle", "p.cell").write.mode("error").partitionBy("cell").parquet(path)
        spark = docs.sparkSession
        kept = spark.read.schema(
            f"job_id {docs.schema['job_id'].dataType.simpleString()}, "
            f"embedding {docs.schema['embedding'].dataType.simpleString()}, angle double, cell int").parquet(path)
        # One row per cell, and there are as many cells as asked for.
        sizes = kept.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("docs")).collect()
        return cls(kept.select("job_id", "embedding", "cell"), centroids, sizes)

    def probes(self, requests: DataFrame, most: int) -> DataFrame:
        """``query_id, embedding, stripe``: the nearest filled cells of each request."""
        numbers = np.array(sorted(r.cell for r in self.cells if r.cell != NOWHERE), np.int64)
        centroids = self.centroids[numbers] if len(numbers) else self.centroids

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def nearest_cells(column: pa.Array) -> pa.Array:
            angles = np.nan_to_num(_angles(column, centroids), nan=np.pi)
            return pa.array(numbers[np.argsort(angles, axis=1, kind="stable")[:, :most]].tolist(), pa.list_(pa.int64()))

        if not len(numbers):
            return requests.select("query_id", "embedding", F.lit(0).cast("bigint").alias("stripe")).limit(0)
        return requests.select("query_id", "embedding", F.explode(nearest_cells(F.col("embedding"))).alias("stripe"))

    def open_cells(self, requests: DataFrame, found: DataFrame, k: int, seen: DataFrame) -> DataFrame:
        """Cells that a request has not looked into and that may hold something nearer than its k-th."""
        cells = sorted(self.cells, key=lambda r: r.cell)
        numbers = np.array([r.cell for r in cells], np.int64)
        radii = np.array([r.radius for r in cells])
        centroids = self.centroids[np.maximum(numbers, 0)] if len(self.centroids) else np.zeros((len(numbers), 1))

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def may_hold(column: pa.Array, reach: pa.Array) -> pa.Array:
            if len(self_centroids):
                angles = np.nan_to_num(_angles(column, centroids), nan=0.0)
            else:
                angles = np.zeros((len(column), len(numbers)))
            least = 1 - np.cos(np.maximum(angles - radii, 0))
            least[:, numbers == NOWHERE] = 2.5  # no distance comes after every distance
            limits = reach.to_numpy(zero_copy_only=False)
            return pa.array([numbers[row].tolist() for row in least <= limits[:, None] + 1e-9], pa.list_(pa.int64()))

        self_centroids = self.centroids
        kth = found.groupBy("query_id").agg(
            F.when(F.count("vector_distance") >= k, F.max("vector_distance")).otherwise(9.0).alias("reach"))
        asked = requests.join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("reach", F.lit(9.0)).alias("reach"))
        wanted = asked.select("query_id", "embedding", F.explode(may_hold(F.col("embedding"), F.col("reach"))).alias("stripe"))
        return wanted.join(seen.select("query_id", "stripe"), ["query_id", "stripe"], "left_anti").select("query_id", "embedding", "stripe")

    def look(self, probes: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each request in its cells."""
        part = F.pmod(F.xxhash64("job_id"), F.lit(SLICES))
        vector = F.col("embedding").cast("array<double>").alias("embedding")
        docs = self.docs.select("job_id", vector, F.col("cell").cast("bigint").alias("stripe"))
        wanted = docs.join(probes.select("stripe").distinct(), "stripe", "left_semi").select("job_id", "embedding", "stripe")
        blocks = packed_rows(wanted.repartition("stripe", part).sortWithinPartitions("stripe"), BLOCK)
        chunks = packed_rows(probes.select("query_id", vector, "stripe").repartition(
            "stripe", F.pmod(F.xxhash64("query_id"), F.lit(SLICES))).sortWithinPartitions("stripe"), CHUNK, "q_")
        one = F.element_at("stripe", 1)
        pairs = chunks.withColumn("q_stripe", F.element_at("q_stripe", 1)).withColumnRenamed("q_stripe", "stripe").join(
            blocks.withColumn("stripe", one), "stripe")
        local = compare_blocks(pairs, k, probes.schema["query_id"].dataType, self.docs.schema["job_id"].dataType)
        ranked = top_k(local, ["query_id"], [F.col("vector_distance"), F.col("job_id")], k)
        return ranked.select(
            "query_id", "job_id", F.nullif("vector_distance", F.lit(float("nan"))).alias("vector_distance"), "rank")


def nearest_by_cells(index: CellIndex, requests: DataFrame, k: int = BRANCH_SIZE, probes: int = 16, exact: bool = False) -> DataFrame:
    """``query_id, job_id, vector_distance, rank``: the ``k`` nearest documents in the ``probes`` nearest
    cells of each request; with ``exact`` the nearest of all."""
    asked = requests.select("query_id", "embedding")
    seen = checkpointed(index.probes(asked, probes))
    found = index.look(seen, k)
    if not exact:
        return found
    found = checkpointed(found)
    more = index.look(checkpointed(index.open_cells(asked, found, k, seen)), k)
    both = found.drop("rank").unionByName(more.drop("rank"))
    return top_k(both, ["query_id"], [F.asc_nulls_last("vector_distance"), F.col("job_id")], k).select(
        "query_id", "job_id", "vector_distance", "rank")
