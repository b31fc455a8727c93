"""Session factory with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tessera", cores: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, and shuffle partitions sized to the cores.

    On a cluster the master and memory come from spark-submit; ``cores`` is for local runs.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app).master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
