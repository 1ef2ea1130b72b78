"""Measurement of retrieval: recall, filter placement, percentiles, geometry, graded cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions.numbers import required_overfetch
from chronolode.operators.vectors import VectorIndex, scan

OVERFETCH = (1, 2, 5, 10, 25, 50, 100, 250, 500)
LEVELS = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01)
EPSILON = 1e-5


def recall_with_ties(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): hits within the k-th true distance, over k; hits and truth are (qid, id, distance, rank)."""
    limit = truth.filter(F.col("rank") <= k).groupBy("qid").agg((F.max("distance") + EPSILON).alias("limit"))
    return hits.filter(F.col("rank") <= k).join(limit, "qid").groupBy("qid").agg((F.count_if(F.col("distance") <= F.col("limit")) / k).alias("recall"))


def recall_by_id(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): true ids among the hits, over k."""
    true = truth.filter(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("true"))
    return hits.filter(F.col("rank") <= k).join(true, ["qid", "id"], "left").groupBy("qid").agg((F.count("true") / k).alias("recall"))


def post_filter(ranked: DataFrame, admissible: DataFrame, k: int, overfetch: int) -> DataFrame:
    """Of the first k * overfetch ranked without a filter, the first k admissible ones."""
    kept = ranked.filter(F.col("rank") <= k * overfetch).join(admissible.select("id"), "id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("rank") <= k)


def collapse_curve(index: VectorIndex, queries: DataFrame, admissible: DataFrame, *, k: int = 10, levels: tuple[int, ...] = OVERFETCH) -> DataFrame:
    """(overfetch, recall) of filtering after the search against the filtered search. One ranking serves all levels:
    a hit survives a level if it is within its first k * overfetch and among its first k admissible ones."""
    truth = index.search(queries, k, admissible=admissible).select("qid", "id", F.lit(1).alias("true"))
    ranked = index.search(queries, k * max(levels))
    ok = ranked.join(admissible.select("id"), "id", "left_semi")
    ok = ok.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("place") <= k)
    hits = ok.join(truth, ["qid", "id"], "left").agg(*[F.count_if((F.col("rank") <= k * o) & F.col("true").isNotNull()).alias(str(o)) for o in levels])
    rows = hits.select(F.explode(F.array(*[F.struct(F.lit(o).alias("overfetch"), F.col(str(o)).alias("hits")) for o in levels])).alias("x")).select("x.*")
    return rows.select("overfetch", (F.col("hits") / (queries.count() * k)).alias("recall"))


def survivors(index: VectorIndex, queries: DataFrame, admissible: DataFrame, *, k: int = 10) -> DataFrame:
    """Mean number of admissible hits among the first k of an unfiltered search, and the share of queries with none."""
    left = index.search(queries, k).join(admissible.select("id"), "id", "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    n = queries.select("qid").join(left, "qid", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.avg("n").alias("mean_survivors"), F.avg((F.col("n") == 0).cast("int")).alias("zero_result_rate"))


def synthetic_admissible(vectors: DataFrame, share: float) -> DataFrame:
    """A share of ids, at least one, by a fixed order of residues."""
    n = max(1, round(vectors.count() * share))
    return vectors.select("id").orderBy((F.col("id") * 7919) % 10007, "id").limit(n)


def sweep(index: VectorIndex, vectors: DataFrame, queries: DataFrame, *, levels: tuple[float, ...] = LEVELS, k: int = 10, effort: int | None = None) -> DataFrame:
    """(level, strategy, recall, zero_result_rate) of the three placements of a filter at each selectivity."""
    total, asked, out = vectors.count(), queries.count(), None
    for level in levels:
        some = synthetic_admissible(vectors, level)
        n = max(1, round(total * level))
        truth = scan(vectors.join(some, "id", "left_semi"), queries, k).select("qid", "id", F.lit(1).alias("true"))
        factor = queries.sparkSession.range(1).select(required_overfetch(F.lit(n / total)).alias("o")).first()[0]
        plans = {"post-filter": post_filter(index.search(queries, k, effort=effort), some, k, 1), "post-filter+overfetch": post_filter(index.search(queries, k * factor, effort=effort), some, k, factor), "in-index": index.search(queries, k, effort=effort, admissible=some)}
        for strategy, hits in plans.items():
            per = hits.join(truth, ["qid", "id"], "left").groupBy("qid").agg(F.count("true").alias("hit"))
            row = per.agg((F.coalesce(F.sum("hit"), F.lit(0)) / (asked * k)).alias("recall"), (1 - F.count(F.lit(1)) / asked).alias("zero_result_rate"))
            row = row.select(F.lit(float(level)).alias("level"), F.lit(strategy).alias("strategy"), "recall", F.round("zero_result_rate", 12).alias("zero_result_rate"))
            out = row if out is None else out.unionByName(row)
    return out


def percentiles(rows: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.50, 0.95, 0.99)) -> DataFrame:
    """Values at place int(p * (n - 1)) of the sorted ones, without interpolation, by key.

    Values are counted first; places are running sums over distinct values, so that no group is gathered.
    """
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    run = counted.withColumn("_hi", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    place = lambda p: F.floor(F.lit(p) * (F.col("_n") - 1)).cast("long")
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_hi") > place(p), F.col(value))).alias(f"p{round(p * 100)}") for p in at], F.max("_n").alias("n"))


def held_out(rows: DataFrame, every: int, rest: int) -> tuple[DataFrame, DataFrame]:
    """Corpus without, and queries with, the ids that leave `rest` when divided by `every`."""
    held = rows.filter(F.pmod(F.col("id"), F.lit(every)) == rest)
    return rows.join(held.select("id"), "id", "left_anti"), held


def geometry(vectors: DataFrame, *, every: int = 1) -> DataFrame:
    """Vectors, distinct ones, intrinsic dimension by the ratio of the two nearest distances, mean nearest distance.

    The estimate uses every `every`-th distinct vector as a query against all distinct ones; ids are those of the
    first of equal vectors.
    """
    distinct = vectors.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector")
    queries = distinct.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), "vector")
    near = scan(distinct, queries, 3).filter(F.col("id") != F.col("qid"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).filter("r <= 2")
    chord = F.sqrt(F.greatest(2 * F.col("distance"), F.lit(0.0)))
    two = near.groupBy("qid").agg(F.greatest(F.max(F.when(F.col("r") == 1, chord)), F.lit(1e-12)).alias("r1"), F.max(F.when(F.col("r") == 2, chord)).alias("r2"), F.max(F.when(F.col("r") == 1, F.col("distance"))).alias("nn"))
    est = two.agg((F.count(F.lit(1)) / F.sum(F.log(F.greatest(F.col("r2") / F.col("r1"), F.lit(1 + 1e-12))))).alias("intrinsic_dim"), F.avg("nn").alias("mean_nn_distance"))
    return est.select(F.lit(vectors.count()).alias("n_vectors"), F.lit(distinct.count()).alias("n_distinct"), "intrinsic_dim", "mean_nn_distance")


def passed(citations: Column, refusal: Column, temporal: Column, leaked: Column) -> Column:
    return citations & refusal & temporal & ~leaked


def rollup(cases: DataFrame, key: str, flags: list[str], latency: str) -> DataFrame:
    """Shares of the flags and the middle latency (place n // 2) by class, and over all under the class `all`."""
    twice = cases.select(F.explode(F.array(F.col(key), F.lit("all"))).alias(key), *flags, latency)
    shares = twice.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("int")).alias(f) for f in flags])
    counted = twice.groupBy(key, latency).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key)
    run = counted.withColumn("_hi", F.sum("_c").over(w.orderBy(latency).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    middle = run.groupBy(key).agg(F.min(F.when(F.col("_hi") > F.floor(F.col("_n") / 2), F.col(latency))).alias(f"median_{latency}"))
    return shares.join(middle, key)
