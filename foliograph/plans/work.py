"""Steps written as tables, so that plans stay small and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A step of more rows is never sent whole to the driver and to every task, whatever its files' size says of it.
MOST = 50_000


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="foliograph-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_foliograph"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table and read again; joins of a large one are by shuffle.

    Spark takes a table for as small as its files. Those of steps hold few distinct values and shrink to a byte or two a row,
    so Spark would collect millions of rows on the driver and broadcast them.
    """
    path, counted = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept.hint("merge") if counted.get["n"] > MOST else kept


def together(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """What the steps return; they are planned and run beside each other, so that short jobs don't wait for one another."""
    with ThreadPoolExecutor(min(8, max(1, len(steps)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]
