"""Traces of answered questions: one row a turn, with its candidates as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.operators.answers import SNIPPET
from chronolode.sources.store import Table


def rows(turns: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows for the table of traces of turns(id, conversation_id, turn, query, resolved_query, as_of, answered, cited,
    run_id) and candidates(id, rank, chunk, citation_path, text, score): candidates by rank, texts cut to SNIPPET.
    A resolved query is kept only where it differs."""
    c = F.struct("rank", F.col("chunk").alias("id"), "citation_path", F.substring("text", 1, SNIPPET).alias("snippet"), "score")
    per = candidates.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(c))).alias("candidates"))
    out = turns.join(per, "id", "left")
    resolved = F.when(F.col("resolved_query") != F.col("query"), F.col("resolved_query"))
    return out.select("id", "conversation_id", "turn", "query", resolved.alias("resolved_query"), "as_of", "answered", F.coalesce("candidates", F.lit("[]")).alias("candidates"), "cited", "run_id", F.current_timestamp().alias("created_at"))


def persist(table: Table, turns: DataFrame, candidates: DataFrame) -> None:
    table.append(rows(turns, candidates))


def read(table: Table, trace_id: int) -> DataFrame:
    return table.read().filter(F.col("id") == trace_id)
