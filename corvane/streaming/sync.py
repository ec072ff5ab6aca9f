"""Incremental input with Structured Streaming: late and repeated records, upserts of micro-batches,
and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.state import current, switch, upsert


def cursor_filter(df: DataFrame, column: str, cursor: str | None, pad_days: int = 0) -> DataFrame:
    """Records after the cursor, and from ``pad_days`` before it where history may have been
    rewritten; without cursor all."""
    if cursor is None:
        return df
    since = F.to_timestamp(F.lit(cursor)) - F.expr(f"INTERVAL {pad_days} DAYS")
    return df.filter(F.col(column) > since)


def next_cursor(df: DataFrame, column: str) -> DataFrame:
    """One row: the cursor after these records, a second after the newest; null without records."""
    return df.agg((F.max(column) + F.expr("INTERVAL 1 SECOND")).alias("cursor"))


def walk_cursor(cursors: DataFrame, resource: str, started: str) -> DataFrame:
    """Cursors (target_id, resource, cursor) after a walk of a resource that began at ``started``: the
    time of its begin, not that of the newest record, so what arrives during a walk is read by the
    next one. A cursor that is later already stays."""
    at = F.lit(started)
    return cursors.withColumn("cursor", F.when(F.col("resource") == resource, F.greatest("cursor", at)).otherwise(F.col("cursor")))


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """A stream without records whose key came within the allowed lateness before."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def activity(df: DataFrame, time: str, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and users of each window and type; an extension. Users are counted approximately in a
    stream and exactly in a table."""
    df = df.withWatermark(time, late) if late else df
    users = F.approx_count_distinct("user_id") if df.isStreaming else F.count_distinct("user_id")
    window = F.window(time, size, slide) if slide else F.window(time, size)
    rows = df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n_events"), users.alias("n_users"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events", "n_users")


def sessions(df: DataFrame, time: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, parted by gaps; an extension."""
    rows = df.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def bucket_of(keys: list[str], buckets: int):
    """The bucket of a row by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def sync_table(spark: SparkSession, stream: DataFrame, path: str, keys: list[str], checkpoint: str, seq: str | None = None, after: Callable[[DataFrame, int], None] | None = None, buckets: int = 16) -> StreamingQuery:
    """Upsert a stream into the table at ``path``, a micro-batch at a time, each the same if it is run
    again. The table is kept in ``buckets`` by key, each with versions of its own: a micro-batch reads
    and writes the buckets that its keys fall in, and no others. Runs until no input is left."""

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_bucket", bucket_of(keys, buckets)).persist()
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]
        for bucket in sorted(touched):
            part, place = batch.filter(F.col("_bucket") == bucket).drop("_bucket"), f"{path}/bucket={bucket}"
            old = spark.read.parquet(found) if (found := current(spark, place)) else part.limit(0)
            switch(spark, upsert(old, part, keys, seq=seq), place)
        if after and touched:
            after(batch.drop("_bucket"), number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def synced(spark: SparkSession, path: str, buckets: int = 16) -> DataFrame | None:
    """The table that sync_table keeps at ``path``; None if nothing came yet."""
    places = [found for k in range(buckets) if (found := current(spark, f"{path}/bucket={k}"))]
    return spark.read.parquet(*places) if places else None
