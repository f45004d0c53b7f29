"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans count on. Hot join keys are split by AQE; the forced
# form lets it do so even where the split costs one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Narrow rows compress well, and a task holds them unpacked in its sorts and hash tables, often in
    # several at once. So exchanges are cut into many pieces, of which AQE joins up to this much for a task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Shuffle files go when the write or count that made them ends; else they stay until the driver happens to
    # collect its garbage, and a load of many steps holds those of all its steps.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Exchanges have at least so many pieces: a fixed few would grow with the tables.
LEAST_PIECES = 512

# Writes that run at the same time.
JOBS_AT_ONCE = 4


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    pieces = max(LEAST_PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(pieces))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder given by ``setCheckpointDir`` counts, too. A local session without either gets a
    temporary folder, removed at its end; a cluster session is refused, as a machine-local
    folder would lose data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="careerlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def at_once(spark: SparkSession, step: Callable[..., None], calls: Iterable[tuple]) -> None:
    """``step`` for every tuple of arguments, several at a time; small jobs do not fill a cluster."""
    run = inheritable_thread_target(spark)(step)
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        for done in [pool.submit(run, *call) for call in calls]:
            done.result()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; cuts its lineage.

    Its files go once nothing refers to it, if the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; without that setting they stay until
    the folder is cleaned.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables in the shared folder, removed when the work is done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> "Scratch":
        return self

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """Write a table and read it back: computed once, and safe against lost executors."""
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error) -> None:
        from careerlake.sources import files

        for path in self.paths:
            files.delete(self.spark, path)
