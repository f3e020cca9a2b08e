"""Session helpers shared by the operators: reliable checkpoints and size checks."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# A window partition at or below this many rows may be sorted by one task.
TASK_ROWS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session; a scratch folder is made up only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-checkpoint-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the checkpoint folder. Unlike a checkpoint its size is known to the planner, so joins
    with it are chosen by size; the order of rows is lost."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
