"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One table of the folder; columns and filters are pruned into the scan by Catalyst. ``spread``
    is for work that is heavy in each row: a table of fewer parts than there are cores is dealt out
    by its first column. Tables of any size have more parts and are read where they lie."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, df.columns[0])
    return df
