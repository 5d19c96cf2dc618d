"""Session helpers: a local session for tests and benches, and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = "barloom.rows.per.task"


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_per_task(spark: SparkSession) -> int:
    """How many rows of one group a single task may hold before the group is split."""
    return int(spark.conf.get(ROWS_PER_TASK, "1000000"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the cluster keeps checkpoints; a local one only when none is set."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return f"{base or _own_folder(spark)}/{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    """A local folder when all tasks run on this machine; elsewhere the cluster has to name one that its executors share."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="barloom-")


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once: written as Parquet to a new shared folder and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that iterative jobs survive executor loss.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder
    is chosen here only when none is set (single-machine tests).
    """
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoints(spark: SparkSession) -> None:
    """Give Spark its checkpoint folder unless it has one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or os.path.join(_own_folder(spark), "cut"))
