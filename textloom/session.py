"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it; on a cluster deploy it there or with --py-files."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def local(cores: int | str = "*", partitions: int = 8, app: str = "textloom") -> SparkSession:
    """A local session for tests and benchmarks."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000").getOrCreate())
