"""Hits: their attributes, copies made one, and fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.scalars import age_days, iso_timestamp
from corvane.runtime import unsent
from corvane.schema import DECAYING, RRF_K


def chunk_index(chunks: DataFrame) -> DataFrame:
    """chunk_id and chunk_idx, its number within the artifact in order of ids, from 1."""
    return chunks.select(F.col("id").alias("chunk_id"), F.row_number().over(W.partitionBy("artifact_id").orderBy("id")).alias("chunk_idx"))


def hit_keys(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """chunk_id with what is the same in copies of it under several targets: kind and external_id of
    the artifact and chunk_idx within it, and ``object``, a hash of these. Chunks without artifact are
    missing."""
    numbered = chunks.select(F.col("id").alias("chunk_id"), "artifact_id", F.row_number().over(W.partitionBy("artifact_id").orderBy("id")).alias("chunk_idx"))
    keys = numbered.join(artifacts.select(F.col("id").alias("artifact_id"), F.col("kind").alias("artifact_kind"), "external_id", "created_at"), "artifact_id")
    return keys.withColumn("object", F.xxhash64("artifact_kind", "external_id", "chunk_idx"))


def one_of_copies(hits: DataFrame, keys: DataFrame, k: int | None = None) -> DataFrame:
    """Of hits that are copies of each other the first; ranks are made anew, and the best k of each
    query stay. All copies are made one before the cut, so it never leaves fewer than there are."""
    keyed = hits.join(keys, "chunk_id")
    first = W.partitionBy("query_id", "artifact_kind", "external_id", "chunk_idx").orderBy("rank")
    kept = keyed.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1")
    kept = kept.withColumn("_rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).drop("rank", "_copy").withColumnRenamed("_rank", "rank")
    return kept if k is None else kept.filter(F.col("rank") <= k)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, keys: DataFrame, k: int | None, half_life_days: float | None = None, now: str | None = None) -> DataFrame:
    """Reciprocal rank fusion: a hit scores 1 / (RRF_K + rank) in each list it is in. With a half-life
    the score of aging kinds falls by half in that time; hits without a readable date keep it.
    query_id, chunk_id, score, distance (1 - score), vector_rank, keyword_rank, rank; ties by the
    rank among vectors, then among keywords, then chunk_id."""
    a = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    b = keyword_hits.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(1.0 / (F.lit(float(RRF_K)) + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1.0 / (F.lit(float(RRF_K)) + F.col("keyword_rank")), F.lit(0.0))
    both = both.withColumn("score", score)
    if half_life_days and half_life_days > 0:
        both = both.join(unsent(keys.select("chunk_id", "artifact_kind", "created_at")), "chunk_id", "left")
        then = iso_timestamp(F.col("created_at"))
        aged = F.col("score") * F.pow(F.lit(0.5), age_days(then, F.to_timestamp(F.lit(now))) / half_life_days)
        both = both.withColumn("score", F.when(F.col("artifact_kind").isin(*DECAYING) & then.isNotNull(), aged).otherwise(F.col("score")))
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), "chunk_id")
    ranked = both.select("query_id", "chunk_id", "score", (1 - F.col("score")).alias("distance"), "vector_rank", "keyword_rank", F.row_number().over(order).alias("rank"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def hit_rows(hits: DataFrame, chunks: DataFrame, artifacts: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits with the attributes of chunk, artifact and target, under names of their own."""
    c = chunks.select(F.col("id").alias("chunk_id"), "artifact_id", "text", "context_json", F.col("language").alias("chunk_language"), "node_kind", "symbol_name")
    a = artifacts.select(F.col("id").alias("artifact_id"), F.col("kind").alias("artifact_kind"), F.col("language").alias("artifact_language"), F.col("repo").alias("artifact_repo"), "source_url", "decision", "target_id", "meta_json")
    t = targets.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"))
    plain = hits.select(*[x for x in hits.columns if x not in ("artifact_id", "artifact_kind", "external_id", "chunk_idx", "created_at", "object")])
    return plain.join(c, "chunk_id").join(a, "artifact_id").join(t, "target_id")
