"""Last activity per session, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from careerlake.session import Scratch
from careerlake.sources import files

BUCKET = "bucket"
BUCKETS = 16


def last_activity(messages: DataFrame, session: str, at: str) -> DataFrame:
    """Latest message time per session, for a table or a stream (I4)."""
    return messages.groupBy(session).agg(
        F.max(at).alias("updated_at"), F.count(F.lit(1)).alias("messages"))


def _latest(rows: DataFrame, session: str) -> DataFrame:
    """One row per session; both values only ever grow."""
    return rows.groupBy(session).agg(F.max("updated_at").alias("updated_at"), F.max("messages").alias("messages"))


def start_activity_table(stream: DataFrame, session: str, at: str, folder: str, checkpoint: str,
                         buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last activities below ``folder``, one row per session, in hash buckets.

    A batch folds its sessions into the buckets they lie in and writes only those anew, so the
    table stays as small as the sessions are many. A batch that is repeated changes nothing.
    """

    def keep(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        with Scratch(spark) as scratch:
            placed = scratch.written(
                changed.withColumn(BUCKET, F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")), "activity")
            touched = [row[0] for row in placed.select(BUCKET).distinct().collect()]
            if not touched:
                return
            rows = placed.drop(BUCKET)
            if files.exists(spark, folder):
                held = spark.read.schema(placed.schema).parquet(folder)
                rows = rows.unionByName(held.filter(F.col(BUCKET).isin(touched)).drop(BUCKET))
            folded = _latest(rows, session).withColumn(BUCKET, F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int"))
            folded.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)

    return (
        last_activity(stream, session, at).writeStream.outputMode("update")
        .foreachBatch(keep).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_activity(spark: SparkSession, session: str, folder: str) -> DataFrame:
    """Current state of every session."""
    return spark.read.parquet(folder).drop(BUCKET).select(session, "updated_at", "messages")
