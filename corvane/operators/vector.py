"""Exact nearest neighbours of a set of query vectors.

Queries are a stated, small set; they meet all vectors in blocks of bounded size. A partition keeps
the best k of each query while it reads, so what is shuffled is queries x k rows a partition; vectors
that have what filters and copies are told by beside them (see tools.Corpus.stored) are never moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.schema import OVER_SCAN, TOP

#: Query vectors that are sent to the workers at once.
BLOCK = 1024


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance, at least 0; 1 if a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / norms))


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``vectors`` as they are; one of another length ends the job."""
    right = F.col(column).isNull() | (F.size(column) == dim)
    return vectors.withColumn(column, F.when(right, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a vector doesn't have {dim} numbers but "), F.size(column).cast("string"))).cast(vectors.schema[column].dataType)))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that aren't null, and their vectors."""
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    lists = column.take(pa.array(rows))
    if not len(rows):
        return rows, np.empty((0, 0))
    ends = np.diff(np.asarray(lists.offsets))
    if len(set(ends.tolist())) > 1:
        raise ValueError("vectors differ in length")
    return rows, np.asarray(lists.flatten(), dtype=np.float64).reshape(len(rows), -1)


def _nearest(distance: np.ndarray, chunk: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, one of each group; ties by chunk."""
    order = np.lexsort((chunk, np.round(distance, 9)))
    first = np.unique(group[order], return_index=True)[1]
    return order[np.sort(first)[:k]]


def _nearby(rough: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places that hold the k nearest groups for sure: those up to a distance within which there are
    k groups. Few need sorting then, also where many are copies of each other."""
    most = 2 * k + 8
    while most < len(rough):
        bound = np.partition(rough, most - 1)[most - 1]
        cols = np.flatnonzero(rough <= bound + 1e-6 * (1 + abs(bound)))
        if len(np.unique(group[cols])) >= k:
            return cols
        most *= 4
    return np.arange(len(rough))


def knn(vectors: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """query_id, chunk_id, distance (Euclidean) and rank of the k nearest of each query; ties by
    chunk_id. ``vectors``: chunk_id, embedding, and if there is a column ``object`` only the nearest
    of each object counts; ``queries``: query_id, embedding. Null vectors are no neighbours, null
    queries have none; vectors of another length end the job."""
    spark = vectors.sparkSession
    grouped = "object" in vectors.columns
    queries = queries.select(F.col("query_id").cast("long"), "embedding").filter("embedding is not null")
    # A set that fits one block takes one job.
    some = queries.limit(block + 1).collect()
    blocks = 1 if len(some) <= block else -(-queries.count() // block)
    out = None
    for number in range(blocks):
        rows = some if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            if not ids:
                return
            near = np.full((len(ids), k), np.inf)
            who = np.full((len(ids), k), np.iinfo(np.int64).max)
            what = np.zeros((len(ids), k), np.int64)
            for batch in batches:
                rows, v = _matrix(batch.column(1))
                if not len(rows):
                    continue
                if v.shape[1] != asked.shape[1]:
                    raise ValueError(f"vectors have {v.shape[1]} numbers, queries {asked.shape[1]}")
                chunk = np.asarray(batch.column(0))[rows].astype(np.int64)
                group = np.asarray(batch.column(2))[rows].astype(np.int64) if grouped else chunk
                rough = (v * v).sum(1)[None, :] - 2 * asked @ v.T
                for q in range(len(ids)):
                    cols = _nearby(rough[q], group, k)
                    have = np.isfinite(near[q])
                    d = np.concatenate((near[q][have], np.sqrt(((v[cols] - asked[q]) ** 2).sum(1))))
                    c, g = np.concatenate((who[q][have], chunk[cols])), np.concatenate((what[q][have], group[cols]))
                    best_of = _nearest(d, c, g, k)
                    n = len(best_of)
                    near[q, :n], who[q, :n], what[q, :n] = d[best_of], c[best_of], g[best_of]
            q, r = np.nonzero(np.isfinite(near))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[q]), pa.array(who[q, r]), pa.array(near[q, r])] + [pa.array(what[q, r])] * grouped, names=["query_id", "chunk_id", "distance"] + ["object"] * grouped)

        columns = [F.col("chunk_id").cast("long"), F.col("embedding")] + [F.col("object")] * grouped
        found = vectors.select(*columns).mapInArrow(best, "query_id long, chunk_id long, distance double" + ", object long" * grouped)
        out = found if out is None else out.unionByName(found)
    order = (F.round("distance", 9), F.col("chunk_id"))
    if grouped:
        out = out.withColumn("_no", F.row_number().over(W.partitionBy("query_id", "object").orderBy(*order))).filter("_no = 1").drop("_no", "object")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_filtered(vectors: DataFrame, candidates: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The nearest among ``candidates`` (chunk_id): filters come first, then the search."""
    return knn(vectors.join(candidates, "chunk_id", "left_semi"), queries, k)


def knn_then_filter(vectors: DataFrame, candidates: DataFrame, queries: DataFrame, k: int = TOP, over: int = OVER_SCAN) -> DataFrame:
    """The nearest ``k * over`` of all, and of these the candidates, at most k. A query can get less
    than k although there are more candidates."""
    some = knn(vectors, queries, k * over).join(candidates, "chunk_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return some.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("rank").withColumnRenamed("_rank", "rank").select("query_id", "chunk_id", "distance", "rank")
