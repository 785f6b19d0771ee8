"""A session for command line, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tallyweave")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
