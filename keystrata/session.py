"""A Spark session with the settings this library is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session in one JVM: UTC, adaptive plans, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(map={
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.python.filterPushdown.enabled": "true"} | more)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
