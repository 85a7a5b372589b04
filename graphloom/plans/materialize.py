"""Cutting lineage and choosing broadcasts: what loops over DataFrames need."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of short strings that may be broadcast, counted before.
BROADCAST_ROWS = 500_000
#: Tasks for each core where files are parsed, so that a few long ones even out.
TASKS_A_CORE = 4


def shipped(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, whatever folder they were started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared checkpoint folder from now on.

    Without spark.checkpoint.dir a local folder does on a local master; elsewhere other machines couldn't read it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def offered(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has few rows (already counted); else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def dealt(files: DataFrame) -> DataFrame:
    """files dealt by path to some tasks for each core. Sources compress well, so sizes of a shuffle would make few tasks
    of what takes long to parse."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return files.repartition(n, "path")
