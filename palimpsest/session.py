"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The folder is the one of ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary one; on a cluster a missing setting is an error, because a folder of one machine is lost with it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df`` as a local table: only for rows that a limit or a fixed table bounds to a few hundred."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
