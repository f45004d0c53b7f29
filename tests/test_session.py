"""Session settings."""

import time
from pathlib import Path

from careerlake.session import LEAST_PIECES, tune


def test_exchanges_are_cut_into_many_pieces(spark):
    pieces = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(spark.conf.get(pieces)) == LEAST_PIECES and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2000")
    assert tune(session).conf.get(pieces) == "2000"
    assert session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_shuffle_files_go_when_their_query_ends(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for folder in manager.localDirs() for f in Path(folder.toString()).glob("*/shuffle_*")}

    before = files()
    rows = spark.range(10_000).repartition(3)
    rows.write.parquet(str(tmp_path / "rows"))
    until = time.monotonic() + 5
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - before and rows.count() == 10_000
