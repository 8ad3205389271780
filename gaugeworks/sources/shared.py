"""Cuts of lineage in the shared checkpoint folder, and rows dealt to tasks of one size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


SHARE = 500_000  # rows of a task that sorts what ``spread`` deals out


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: one of its own in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gaugeworks-")
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so what is read several times is computed once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(rows: DataFrame, *keys: str, share: int = SHARE) -> DataFrame:
    """Rows dealt by keys to as many tasks as give each about ``share`` rows, whatever number of partitions the session sets: so a
    task's memory doesn't grow with the input. The rows are counted for that."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share))
    return rows.repartition(tasks, *keys)
