"""The Spark session that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive execution, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("siftlog")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
