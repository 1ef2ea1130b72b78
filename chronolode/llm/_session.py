"""Session helpers: checkpoints in the shared folder, joins that spread hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.ship import ship

__all__ = ["checkpoint", "connected_components", "ensure_checkpoint_dir", "hot_join", "shared_path", "ship"]

#: A key with one row in HOT of all rows, or more, is hot; so there are at most HOT such keys.
HOT = 1024
#: Edges beyond which a round of connected_components joins its hot nodes apart; below, one task could hold them all.
MANY_EDGES = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; only in local mode (tests), where it is unset, make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chronolode-ckpt-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: the rows survive the loss of executors and the lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_join(rows: DataFrame, known: DataFrame, on: list[str], n: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with known, whose keys are unique and whose column n counts the rows of each key.

    Keys with at least one in HOT of all rows are at most HOT; they are broadcast, so that their rows stay where they
    are, and only the rest is shuffled. Both sides are read twice and should be checkpoints or cheap. total: the sum
    of n, if it is known.
    """
    if total is None:
        total = known.agg(F.sum(n)).first()[0] or 0
    least = -(-total // HOT)
    hot = known.filter(F.col(n) >= least)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(known.filter(F.col(n) < least), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node of an undirected graph, by alternating large-star and small-star rounds.

    edges(a, b): comparable, non-null ids; direction, repeats and loops do not matter. Returns (node, component)
    for every node that has an edge. A round is one shuffle of the edges; rounds go on until one changes nothing.
    Each star step needs only the minimum of a node's neighbours, an aggregate with map-side combine, and a join
    back on the node, so that no neighbourhood is gathered in one task's memory; nodes with many neighbours, as the
    root of a large component has, are joined by broadcast. Rounds are cut by checkpoints.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = checkpoint(e)
    state = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = tuple(e.agg(*state).first())
    while True:
        many = before[0] > MANY_EDGES

        def back(rows: DataFrame, low: DataFrame, many: bool = many) -> DataFrame:
            return hot_join(rows, checkpoint(low), ["u"], "n") if many else rows.join(low, "u")

        # Large star: neighbours above a node are linked to the smallest of its neighbourhood.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = back(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpoint(large) if many else large
        # Small star: neighbours below a node and the node itself are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (back(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = checkpoint(small)
        now = tuple(e.agg(*state).first())
        if now == before:
            break
        before = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return leaves.unionByName(roots)
