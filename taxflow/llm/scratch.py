"""Places for intermediate tables that every executor can reach.

Lineage is cut by writing a Parquet table into the folder that the session
names in ``spark.checkpoint.dir`` or ``setCheckpointDir``; only in local mode, as
in tests, is a folder of this machine chosen where both are unset.  Reading the table back also gives Spark a true size
for its join planning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_unset: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the context's; a local one in local mode alone."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _unset:
            _unset[app] = "file://" + tempfile.mkdtemp(prefix="spark-taxflow-")
        found = _unset[app]
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run, below one folder of their own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read back."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


#: Rows of ids or keys that may be broadcast, some 30 MB.
NARROW_ROWS = 500_000


def narrow_side(written: DataFrame) -> DataFrame:
    """A written table of ids or keys, marked for broadcast if its counted rows are few, else for a shuffled join."""
    return F.broadcast(written) if written.count() <= NARROW_ROWS else written.hint("merge")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
