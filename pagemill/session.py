"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "pagemill") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("PAGEMILL_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # Pages grow many times over when they are cut up, so small shuffles must still fill all cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        # Plans here are large; recording the Python call site of every expression would cost seconds per plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which every executor can reach.

    It is the context's own, else the one the cluster names in ``spark.checkpoint.dir``. Only a session on one machine
    (``local[...]``) may do without and gets a temporary folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


#: Whether the files of a plan's shuffles go when its action has ended, rather than when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder, so that the rows survive the loss of the executors
    that computed them. What was shuffled for them goes from the disks at once."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is that of a plan's making
    finally:
        spark.conf.set(SHUFFLES_GO, before)
