"""Mixing sources to target weights by subset-sum budget fitting.

Per source, documents are counted by exact length in words. Whole copies of the source fill its target as far as they
go. What remains is fitted by a subset of documents. A budget of at most DP_BUDGET words goes to the bounded-knapsack
program as a whole, which finds the largest sum that does not exceed it. Of a larger one the same share of every length
is taken first; then documents are given back, of every length in turn, until DP_BUDGET words and the longest document
are free again, and the program fits these words with all documents that are left. So every sum stays within the
budget, and the shortfall is less than the shortest document left out.

Documents of a length are then chosen by seeded hash. Only counts are gathered, one row for each source and length; to
rank documents, hashes are cut into buckets of about BUCKET rows of the table, whole buckets of a length are taken or
left, and only within a bucket rows are ordered, so that a length or source with a third of all rows is spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240607
BUCKET = 1 << 15
DP_BUDGET = 1 << 16
_SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space (U+0020, U+0009 to U+000D); null: 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """sizes(source, source_size), one row a source, to (source, source_size, target).

    Sources by code point, null last, have the weights in turn. They share `share` of all sizes by weight; a target
    stops at MOST times its source's size and its excess is shared again. That ends at target = min(MOST * size,
    weight * level) for one level: with sources by the level at which they stop, the first k of them stopped, the
    level is what the others share, for the first k whose next source stops no lower.
    """
    order, by_stop = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("stop", "rank")
    w = sizes.withColumn("rank", F.row_number().over(order))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("stop", F.col("source_size") * MOST / F.col("weight"))
    below = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("used", F.coalesce(F.sum("source_size").over(below), F.lit(0)) * MOST)
    w = w.withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    w = w.withColumn("level", (F.sum("source_size").over(whole) * share - F.col("used")) / F.col("left"))
    w = w.withColumn("level", F.min(F.when(F.col("stop") >= F.col("level"), F.struct("stop", "rank", "level"))).over(whole)["level"])
    return w.select("source", "source_size", F.when(F.col("level").isNull(), F.col("source_size") * float(MOST)).otherwise(F.least(F.col("source_size") * float(MOST), F.col("weight") * F.col("level"))).alias("target"))


def fit(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each distinct positive length to take, at most count of each.

    Their lengths sum to the most that the budget allows if it is at most DP_BUDGET; otherwise to the budget less a
    shortfall that is smaller than every length of which a document is left.
    """
    total = int((length * count).sum())
    if budget <= 0 or not total:
        return np.zeros(len(length), np.int64)
    if budget >= total:
        return count.copy()
    take = np.zeros(len(length), np.int64)
    if budget > DP_BUDGET:
        # A share rounded down leaves less than one document of each length; the sum can't exceed the budget.
        take = np.minimum(count * budget // total, count) if total < 1 << 31 else np.array([int(c) * budget // total for c in count], np.int64)
    left = budget - int((take * length).sum())
    # Short of the program's reach: what the rounding left beyond it, by the longest documents that fit.
    for i in np.argsort(-length, kind="stable"):
        if left > DP_BUDGET:
            more = min(int(count[i] - take[i]), (left - DP_BUDGET) // int(length[i]))
            take[i] += more
            left -= more * int(length[i])
    # Give back, one of each length in turn, until the program has room to choose.
    room = min(budget, max(DP_BUDGET, int(length.max())))
    while left < room and take.any():
        some = np.flatnonzero(take)
        ahead = np.cumsum(length[some])
        some = some[: int(np.searchsorted(ahead, room - left)) + 1]
        take[some] -= 1
        left += int(length[some].sum())
    return take + _knapsack(length, count - take, left)


def _knapsack(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts whose sum is the largest within the budget. Each length comes in pieces of 1, 2, 4,
    ... documents; by[s] is the first piece that reached s."""
    by = np.full(budget + 1, -1, np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    pieces = []
    for i in np.argsort(-length, kind="stable"):
        n, k = min(int(count[i]), budget // int(length[i])), 1
        while n > 0 and not reached[budget]:
            k = min(k, n)
            size = k * int(length[i])
            new = np.flatnonzero(reached[:-size] & ~reached[size:]) + size
            by[new] = len(pieces)
            reached[new] = True
            pieces.append((i, k, size))
            n, k = n - k, 2 * k
    take = np.zeros(len(length), np.int64)
    s = int(np.flatnonzero(reached)[-1])
    while s:
        i, k, size = pieces[by[s]]
        take[i] += k
        s -= size
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (source, size, n, source_size, target) of one source: adds copies, that every document has, and extra."""
    size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    whole, target = int(pdf["source_size"].iloc[0]), int(round(pdf["target"].iloc[0]))
    copies = min(target // whole, MOST) if whole else 0
    extra = np.zeros(len(pdf), np.int64)
    if whole and copies < MOST:
        some = size > 0
        extra[some] = fit(size[some], n[some], target - copies * whole)
    return pd.DataFrame({"source": pdf["source"], "size": size, "copies": copies, "extra": extra, "source_size": whole, "target": pdf["target"]})


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Adds size, source_size, target and taken (words the mix takes of the row, repeats counted) to every row of docs.

    A null source is a source of its own, the last one. Null and empty texts have size 0 and nothing is taken of
    them. Rows that repeat are documents of their own; which of rows with the same id and text is taken makes no
    difference. Ties of length go by a hash of seed, id and text, so reruns agree. Columns of docs named like one
    that is added are replaced (names that start with _mix_ are reserved); an empty table gives an empty result.
    Targets are computed in one task from one row a source; the plan of a source from one row a length.
    """
    added = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c not in added]
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    # Own columns start with _mix_, apart from every name in docs.
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], word_count(F.col(text)).alias("_mix_size"), hashed.alias("_mix_h"),
                       F.col(source).cast("string").alias("_mix_source"), F.col(doc_id).alias("_mix_id"))
    buckets = docs.count() // BUCKET  # from the files' footers
    bits = min(buckets, 1 << 30).bit_length()
    rows = rows.withColumn("_mix_bucket", F.shiftrightunsigned("_mix_h", 64 - bits).cast("int") if bits else F.lit(0))
    fine = rows.groupBy(F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    by_size = fine.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    goals = goals.withColumnRenamed("source", "g")
    per_size = by_size.join(goals, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    plan = per_size.groupBy("source").applyInPandas(_plan, "source string, size long, copies long, extra long, source_size long, target double")
    plan = plan.withColumnsRenamed({"source": "p", "size": "p_size"})
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = (fine.join(plan, F.col("source").eqNullSafe(F.col("p")) & (F.col("size") == F.col("p_size")))
           .select(F.col("source").alias("_mix_c"), F.col("size").alias("_mix_c_size"), F.col("bucket").alias("_mix_c_bucket"), F.col("copies").alias("_mix_copies"),
                   (F.col("extra") - F.col("before")).alias("_mix_rest"), F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target")))
    out = rows.join(cut, F.col("_mix_source").eqNullSafe(F.col("_mix_c")) & (F.col("_mix_size") == F.col("_mix_c_size")) & (F.col("_mix_bucket") == F.col("_mix_c_bucket")))
    rank = F.row_number().over(Window.partitionBy("_mix_c", "_mix_c_size", "_mix_c_bucket").orderBy("_mix_h", "_mix_id"))
    taken = F.col("_mix_size") * (F.col("_mix_copies") + F.when(rank <= F.col("_mix_rest"), 1).otherwise(0))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"))
