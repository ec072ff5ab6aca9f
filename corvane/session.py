"""Session factory with the settings every plan here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results or plan shapes; all are legal on a cluster as well.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests, the benchmark and interactive work; on a cluster use the one given."""
    builder = SparkSession.builder.master(master).appName("corvane")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
