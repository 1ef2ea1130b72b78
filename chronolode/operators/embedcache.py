"""Content-addressed embeddings: one vector for each distinct text and model, joined back to every chunk."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class EmbeddingProvider(ABC):
    """Texts to unit vectors, in their order. model_id is name@dimensions."""

    name: str
    dimensions: int

    @property
    def model_id(self) -> str:
        return f"{self.name}@{self.dimensions}"

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingProvider(EmbeddingProvider):
    """Signed hashing of words: deterministic and without a model, for tests and as a baseline."""

    name = "hashing"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def hashed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("sha", F.sha2("text", 256))


def distinct_texts(chunks: DataFrame) -> DataFrame:
    """(sha, text): one representative of each content, that of the smallest id."""
    return hashed(chunks).groupBy("sha").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))


def missing(chunks: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """Distinct texts without a vector of the model in cache(sha, model_id, vector)."""
    return distinct_texts(chunks).join(cache.filter(F.col("model_id") == model_id).select("sha"), "sha", "left_anti")


def embed_missing(chunks: DataFrame, cache: DataFrame, provider: EmbeddingProvider, batch_size: int = 64) -> DataFrame:
    """New rows for the cache. Each task embeds its own texts in batches; running it again yields nothing new."""
    model_id = provider.model_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                part = b.slice(at, batch_size)
                vectors = np.asarray(provider.embed(part.column(1).to_pylist()), np.float32)
                yield pa.record_batch([part.column(0), pa.array([model_id] * part.num_rows), pa.array(list(vectors), pa.list_(pa.float32()))], ["sha", "model_id", "vector"])

    return missing(chunks, cache, model_id).select("sha", "text").mapInArrow(run, "sha string, model_id string, vector array<float>")


def corpus_vectors(chunks: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """(id, vector) of every chunk whose content has a vector of the model."""
    return hashed(chunks).join(cache.filter(F.col("model_id") == model_id), "sha").select("id", "vector")


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct texts and their ratio, 0 without any."""
    t = hashed(chunks).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("sha").alias("distinct_texts"))
    return t.withColumn("ratio", F.when(F.col("distinct_texts") > 0, F.col("chunks") / F.col("distinct_texts")).otherwise(0.0))


def fingerprint(chunks: DataFrame, *, prefix: int = 3) -> DataFrame:
    """Count and md5 of all content hashes in order. The hashes are joined by their first digits, then those parts in
    order: the same string as one ordered list, put together from parts that stay small."""
    parts = hashed(chunks).groupBy(F.substring("sha", 1, prefix).alias("p")).agg(F.array_join(F.array_sort(F.collect_list("sha")), ",").alias("s"), F.count(F.lit(1)).alias("n"))
    parts = parts.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "s"))).alias("all"))
    return parts.select(F.coalesce("n", F.lit(0)).alias("n"), F.md5(F.array_join(F.transform("all", lambda x: x["s"]), ",").cast("binary")).alias("fingerprint"))


def first_by_vector(vectors: DataFrame) -> DataFrame:
    """One row for each distinct vector, that of the smallest id."""
    return vectors.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter("_r = 1").drop("_r")
