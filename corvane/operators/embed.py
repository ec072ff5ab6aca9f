"""Vectors and summaries for chunks that wait for them. Models are given as callables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.scalars import header
from corvane.schema import SUMMARIZABLE

#: Texts at once, their greatest and least characters, and by how much a text that is too long shrinks.
BATCH, MAX_CHARS, MIN_CHARS, SHRINK = 128, 4000, 400, 0.6


class TooLong(ValueError):
    """A model's sign that a text doesn't fit."""


class Embedder(Protocol):
    """A model that gives each text a vector of ``dim`` numbers."""

    dim: int
    model_id: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Words hashed into ``dim`` places with a sign each, of length 1: the same on any machine."""

    def __init__(self, dim: int = 64):
        self.dim, self.model_id = dim, f"hash-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                out[k, h % self.dim] += 1.0 if h >> 31 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


def embed_fitting(model: Embedder, texts: list[str]) -> list[list[float]]:
    """Vectors of texts of at most MAX_CHARS characters; a text that is still too long shrinks down
    to MIN_CHARS before the error stands."""
    texts = [t[:MAX_CHARS] for t in texts]
    try:
        vectors = model.embed(texts)
    except TooLong:
        if len(texts) > 1:
            return [embed_fitting(model, [t])[0] for t in texts]
        if len(texts[0]) <= MIN_CHARS:
            raise
        return embed_fitting(model, [texts[0][: max(MIN_CHARS, int(len(texts[0]) * SHRINK))]])
    if any(len(v) != model.dim for v in vectors):
        raise ValueError(f"{model.model_id} gave vectors that don't have {model.dim} numbers")
    return vectors


def pending(chunks: DataFrame) -> DataFrame:
    """Chunks without vector."""
    return chunks.filter(F.col("embed_model").isNull())


def pending_summaries(chunks: DataFrame, kinds: tuple[str, ...] = SUMMARIZABLE) -> DataFrame:
    """Chunks of some kinds without summary."""
    return chunks.filter(F.col("summary").isNull() & F.col("kind").isin(*kinds))


def embed(chunks: DataFrame, model: Embedder) -> DataFrame:
    """chunk_id and embedding of chunks, each with its header; null texts count as empty."""
    text = F.concat(header(F.col("kind"), F.col("context_json"), F.col("summary")), F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                vectors = embed_fitting(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    return chunks.select(F.col("id").cast("long"), text.alias("text")).mapInArrow(run, "chunk_id long, embedding array<float>")


def summarize(chunks: DataFrame, say: Callable[[str], str]) -> DataFrame:
    """id and summary of chunks; what fails or is empty is left out and stays pending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, said = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    summary = (say(text or "") or "").strip()
                except Exception:
                    continue
                if summary:
                    ids.append(key)
                    said.append(summary)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string())], names=["id", "summary"])

    return chunks.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, summary string")
