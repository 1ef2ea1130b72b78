"""Benchmarks of indexes: data sets, timed runs, sizes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions import vectors as vf
from chronolode.operators import evaluation as ev
from chronolode.operators.embedcache import first_by_vector
from chronolode.operators.vectors import CellIndex, VectorIndex, scan


def random_units(spark: SparkSession, n: int = 20_000, dim: int = 384, seed: int = 0) -> DataFrame:
    """(id, vector): independent directions, the hardest case for any index; made where they are used."""
    return spark.range(n).select("id", vf.normalised(F.array(*[F.randn(seed * 100_003 + i) for i in range(dim)])).alias("vector"))


def deduplicated(vectors: DataFrame) -> DataFrame:
    """The first of equal vectors."""
    return first_by_vector(vectors)


def split(vectors: DataFrame, queries: int = 500) -> tuple[DataFrame, DataFrame]:
    """Corpus, and at most `queries` held-out vectors, a tenth at most, one at least, by hash of the id."""
    n = min(queries, max(1, vectors.count() // 10))
    held = vectors.orderBy(F.xxhash64("id"), "id").limit(n)
    return vectors.join(held.select("id"), "id", "left_anti"), held.select(F.col("id").alias("qid"), "vector")


def run_suite(vectors: DataFrame, queries: DataFrame, builders: dict[str, Callable[[DataFrame], VectorIndex]], efforts: dict[str, tuple[int | None, ...]], k: int = 10) -> DataFrame:
    """(index, effort, recall, recall_by_id, build_s, query_s) of every index at each effort, on one set of queries."""
    truth, n = scan(vectors, queries, k).persist(), queries.count()
    out = []
    for name, build in builders.items():
        t = time.perf_counter()
        index = build(vectors)
        built = time.perf_counter() - t
        for effort in efforts.get(name, (None,)):
            t = time.perf_counter()
            hits = index.search(queries, k, effort=effort).persist()
            hits.count()
            took = time.perf_counter() - t
            ties = ev.recall_with_ties(hits, truth, k).agg(F.sum("recall")).first()[0] or 0.0
            ids = ev.recall_by_id(hits, truth, k).agg(F.sum("recall")).first()[0] or 0.0
            hits.unpersist()
            out.append((name, effort, ties / n, ids / n, built, took))
    truth.unpersist()
    return vectors.sparkSession.createDataFrame(out, "index string, effort int, recall double, recall_by_id double, build_s double, query_s double")


def memory_bytes(n: int, dim: int, centroids: int = 0) -> int:
    """Bytes of n vectors of 32-bit floats with ids, and of centroids with offsets."""
    return n * (4 * dim + 8) + centroids * (4 * dim + 8)


def cell_memory(index: CellIndex) -> int:
    return memory_bytes(index.cells.count(), index.centroids.shape[1], len(index.centroids))
