"""Tables that several parts of one plan read, written once where every executor can reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the context's; a folder of this machine in local mode alone."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-taxflow-"))
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that it is computed once and Spark knows its size."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a catalogue (codes, rules, periods) that may be broadcast.
SMALL_ROWS = 100_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` for the small side of a join: broadcast if it has no more than ``rows`` rows, counted up to there, else joined by sort and merge."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df.hint("merge")


#: Rows that one task groups or sorts by key, at a few hundred bytes each.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as its counted rows need, so that one task's share doesn't grow with the table.

    Adaptive execution would size the tasks by the bytes that they read, which says little where rows become wider or more after that.
    """
    return df.repartition(max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism), *keys)
