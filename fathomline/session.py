"""Session factory and the few settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "fathomline", cpus: str | int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with UTC, AQE and Arrow on; on a cluster the caller passes its own session instead."""
    n = cpus or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.driver.memory", os.environ.get("FATHOMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
