"""Reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions.numbers import floor12
from chronolode.operators.lexical import LexicalIndex
from chronolode.operators.vectors import VectorIndex

K = 60
CANDIDATES = 50


def fuse(ranked: DataFrame, *, k: int = K, limit: int | None = None) -> DataFrame:
    """(qid, id, score, ranks, rank) of ranked(qid, list, id, rank): an id counts 1 / (k + its best rank) for each
    list that has it; ties by id; ranks keeps each list's rank."""
    best = ranked.groupBy("qid", "list", "id").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("qid", "id").agg(floor12(F.sum(1 / (F.lit(float(k)) + F.col("rank")))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "rank")))).alias("ranks"))
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def hybrid_search(queries: DataFrame, *, lexical: LexicalIndex, vector: VectorIndex, admissible: DataFrame | None = None, k: int = 10, candidates: int = CANDIDATES, effort: int | None = None) -> DataFrame:
    """The k best of queries(qid, query, vector) by both retrievers over the same admissible ids, fused."""
    words = lexical.search(queries.select("qid", "query"), candidates, admissible=admissible).select("qid", F.lit("lexical").alias("list"), "id", "rank")
    near = vector.search(queries.select("qid", "vector"), candidates, effort=effort, admissible=admissible).select("qid", F.lit("vector").alias("list"), "id", "rank")
    return fuse(words.unionByName(near), limit=k)


def trace(queries: DataFrame, *, lexical: LexicalIndex, vector: VectorIndex, admissible: DataFrame | None = None, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """(qid, candidates_lexical, candidates_vector, fused) of a hybrid search."""
    words = lexical.search(queries.select("qid", "query"), candidates, admissible=admissible).select("qid", "id", F.lit(1).alias("l"), F.lit(0).alias("v"))
    near = vector.search(queries.select("qid", "vector"), candidates, admissible=admissible).select("qid", "id", F.lit(0).alias("l"), F.lit(1).alias("v"))
    both = words.unionByName(near).groupBy("qid", "id").agg(F.sum("l").alias("l"), F.sum("v").alias("v"))
    return both.groupBy("qid").agg(F.sum("l").alias("candidates_lexical"), F.sum("v").alias("candidates_vector"), F.least(F.count(F.lit(1)), F.lit(k)).alias("fused"))


def across(queries: DataFrame, *, lexical: LexicalIndex, vector: VectorIndex, before: DataFrame, after: DataFrame, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """(qid, id, rank_before, rank_after, change) of a hybrid search over two admissible sets, such as those in force
    on two dates. A rank is 0 where the id is not among the k best; change is added, dropped, moved or same."""
    a, b = (hybrid_search(queries, lexical=lexical, vector=vector, admissible=ids, k=k, candidates=candidates).select("qid", "id", F.col("rank").alias(name)) for ids, name in ((before, "rank_before"), (after, "rank_after")))
    both = a.join(b, ["qid", "id"], "full")
    change = F.when(F.col("rank_before").isNull(), "added").when(F.col("rank_after").isNull(), "dropped").when(F.col("rank_before") == F.col("rank_after"), "same").otherwise("moved")
    return both.select("qid", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rank_before", "rank_after")], change.alias("change"))
