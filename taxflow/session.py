"""A local session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "taxflow", cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "6g") -> SparkSession:
    """UTC, adaptive execution and Arrow; on a cluster the submit command sets the rest."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
