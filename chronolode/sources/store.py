"""Tables of the corpus as Parquet: appends that insert what is absent, whole rewrites by swap, index tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chronolode.operators.lexical import LexicalIndex
from chronolode.operators.vectors import CellIndex, GraphIndex
from chronolode.sources.feeds import described

VERSION = {"lexical": 1, "cells": 1, "graph": 2}


class FormatError(ValueError):
    """A table of another kind or version than the reader knows."""


class Table:
    """A Parquet table in a folder of generations; a marker row names the current one, so readers never see half a
    rewrite, on any store that Spark writes. Appends go through Spark's file commit protocol."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _generation(self) -> int:
        try:
            return self.spark.read.schema("g int").json(f"{self.path}/current").agg(F.max("g")).first()[0] or 0
        except AnalysisException:
            return 0

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._generation():06d}")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(f"{self.path}/{self._generation():06d}")

    def replace(self, rows: DataFrame) -> None:
        g = self._generation() + 1
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(f"{self.path}/{g:06d}")
        self.spark.createDataFrame([(g,)], "g int").write.mode("append").json(f"{self.path}/current")

    def insert_absent(self, rows: DataFrame, keys: list[str], *, among: str = "true") -> int:
        """Appends rows whose keys no row (for which `among` holds) has, the first of equal ones; returns how many."""
        first = Window.partitionBy(*keys).orderBy(*[c for c in rows.columns if c not in keys] or keys)
        new = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").join(self.read().filter(among).select(*keys), keys, "left_anti").persist()
        n = new.count()
        if n:
            self.append(new)
        new.unpersist()
        return n

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those of the same keys."""
        both = self.read().withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        last = Window.partitionBy(*keys).orderBy(F.desc("_new"))
        self.replace(both.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_new"))


SOURCES = "source_id string, name string"
DOCUMENTS = "document_id string, source_id string, title string"
VERSIONS = "version_id long, document_id string, section string, heading string, effective_from date, effective_to date, issue_date date, recorded_at timestamp, superseded_at timestamp, removed boolean, sha string"
CHUNKS = "id long, version_id long, ordinal int, citation_path string, text string, char_count int, token_count int, sha string"
TRACES = "id long, conversation_id long, turn int, query string, resolved_query string, as_of date, answered boolean, candidates string, cited array<long>, run_id string, created_at timestamp"


def insert_version(table: Table, rows: DataFrame) -> int:
    """Versions that are absent among those known now."""
    return table.insert_absent(rows, ["document_id", "section", "effective_from"], among="superseded_at is null")


def insert_chunks(table: Table, rows: DataFrame) -> int:
    """Chunks with derived columns, absent by (version, ordinal)."""
    return table.insert_absent(described(rows), ["version_id", "ordinal"])


def ingest_snapshots(parsed: DataFrame, intervals: DataFrame, versions: Table, chunks: Table, document_id: str) -> dict[str, int]:
    """Parsed rows (day, section, heading, ordinal, citation_path, text) matched with the interval that covers their
    day; sections without one are skipped. Returns how many were skipped, existing and created."""
    v = intervals.select(F.col("section").alias("s"), F.col("effective_from").alias("f"), F.col("effective_to").alias("t"), "issue_date", "removed")
    rows = parsed.join(v, (F.col("section") == F.col("s")) & (F.col("f") <= F.col("day")) & (F.col("t").isNull() | (F.col("day") < F.col("t"))), "left").persist()
    vid = F.xxhash64(F.lit(document_id), "section", "f")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
    per = rows.filter("s is not null").groupBy("section", "f", "t", "issue_date", "removed").agg(F.min("heading").alias("heading"), F.sha2(body, 256).alias("sha"))
    new = per.select(vid.alias("version_id"), F.lit(document_id).alias("document_id"), "section", "heading", F.col("f").alias("effective_from"), F.col("t").alias("effective_to"), "issue_date", F.current_timestamp().alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"), "removed", "sha")
    found, skipped = per.count(), rows.filter("s is null").select("day", "section").distinct().count()
    created = insert_version(versions, new)
    insert_chunks(chunks, rows.filter("s is not null").select(F.xxhash64(vid, "ordinal").alias("id"), vid.alias("version_id"), "ordinal", "citation_path", "text"))
    rows.unpersist()
    return {"skipped": skipped, "existing": found - created, "created": created}


def save_lexical(index: LexicalIndex, path: str, buckets: int = 64) -> None:
    """Postings clustered by term, so that a term's row groups are all that a search reads; sizes and format beside."""
    index.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.frequencies.repartitionByRange(max(1, buckets // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/frequencies")
    meta = {"kind": "lexical", "version": VERSION["lexical"], "n": index.n, "average": index.average}
    index.postings.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _meta(spark: SparkSession, path: str, kind: str) -> dict:
    row = spark.read.text(f"{path}/meta").first()
    meta = json.loads(row[0]) if row else {}
    if meta.get("kind") != kind or meta.get("version") != VERSION[kind]:
        raise FormatError(f"{path}: {kind} version {VERSION[kind]} expected, found {meta.get('kind')} {meta.get('version')}")
    return meta


def load_lexical(spark: SparkSession, path: str) -> LexicalIndex:
    meta = _meta(spark, path, "lexical")
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies"), meta["n"], meta["average"])


def save_cells(index: CellIndex, path: str) -> None:
    """Vectors in a folder for each cell: probing a cell is partition pruning."""
    index.cells.repartition("cell").sortWithinPartitions("id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    meta = {"kind": "cells", "version": VERSION["cells"], "centroids": index.centroids.tolist()}
    index.cells.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    meta = _meta(spark, path, "cells")
    index = CellIndex.__new__(CellIndex)
    index.centroids = np.array(meta["centroids"], np.float64)
    index.cells = spark.read.parquet(f"{path}/cells").select("id", "vector", F.col("cell").cast("int").alias("cell"))
    return index


def save_graphs(index: GraphIndex, path: str) -> None:
    index.graphs.write.mode("overwrite").parquet(f"{path}/graphs")
    index.vectors.select("id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    meta = {"kind": "graph", "version": VERSION["graph"], "max_visits": index.max_visits}
    index.graphs.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_graphs(spark: SparkSession, path: str) -> GraphIndex:
    meta = _meta(spark, path, "graph")
    return GraphIndex(spark.read.parquet(f"{path}/vectors"), graphs=spark.read.parquet(f"{path}/graphs"), max_visits=meta["max_visits"])


def save_results(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").json(path)


def as_markdown(results: DataFrame, limit: int = 1000) -> str:
    """A report's rows, an aggregate of at most `limit`, as a Markdown table."""
    rows = [[*map(str, r)] for r in results.limit(limit).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(results.columns), line(["---"] * len(results.columns)), *map(line, rows)])
