"""The model's tables derived from the standard ones: the same rules as DataFrames and as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.ship import ship

EPOCH = "2016-12-23"
AS_OF = dt.date(2020, 6, 1)
KNOWN_AT = dt.date(2019, 6, 1)
TEXT_QUERIES = ((1, "the and tion that"), (2, "les des ouen que"), (3, "ciónez la mente doja"), (4, "thath onat 555-7713 mail7.example.com"), (5, "der die ung keit und und"))


def register(queries: dict, oracles: dict[str, str], sql: str | None = None, days: tuple[str, ...] = ()):
    """Decorator: a query under its function's name with its SQL. Columns that are days come out as ISO text."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            out = f(spark, sf_dir)
            return out.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in out.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        queries[f.__name__] = run
        if sql:
            oracles[f.__name__] = sql if not days else f"SELECT * REPLACE ({', '.join(f'{c}::DATE::VARCHAR AS {c}' for c in days)}) FROM ({sql})"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(expr: str):
    return F.expr(f"date_add(DATE '{EPOCH}', CAST({expr} AS INT))")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version a document: a section is a source in a language, a document a language."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("version_id"), F.col("doc_id").alias("record_id"), F.col("lang").alias("document_id"), F.concat_ws("/", "source", "lang").alias("section"),
        _day("doc_id % 3500").alias("effective_from"), (F.col("doc_id") % 17 == 0).alias("removed"), _day("doc_id % 3500 + doc_id % 700").alias("recorded_at"),
        F.when(F.col("doc_id") % 23 == 0, _day("doc_id % 3500 + doc_id % 700 + 400")).alias("superseded_at"))
    first = Window.partitionBy("section", "effective_from").orderBy("version_id")
    d = d.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return d.withColumn("effective_to", F.lead("effective_from").over(Window.partitionBy("section").orderBy("effective_from")))


VERSIONS = f"""v0 AS (SELECT doc_id AS version_id, lang AS document_id, source || '/' || lang AS section,
    DATE '{EPOCH}' + (doc_id % 3500)::INT AS effective_from, doc_id % 17 = 0 AS removed, DATE '{EPOCH}' + (doc_id % 3500 + doc_id % 700)::INT AS recorded_at,
    CASE WHEN doc_id % 23 = 0 THEN DATE '{EPOCH}' + (doc_id % 3500 + doc_id % 700 + 400)::INT END AS superseded_at FROM documents),
v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY section, effective_from ORDER BY version_id) = 1),
versions AS (SELECT *, lead(effective_from) OVER (PARTITION BY section ORDER BY effective_from) AS effective_to FROM v1)"""


def live(known_at: bool = False) -> str:
    known = f"recorded_at <= DATE '{KNOWN_AT}' AND (superseded_at IS NULL OR superseded_at > DATE '{KNOWN_AT}')" if known_at else "superseded_at IS NULL"
    return f"effective_from <= DATE '{AS_OF}' AND (effective_to IS NULL OR DATE '{AS_OF}' < effective_to) AND NOT removed AND {known}"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a version."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("version_id"), F.lit(0).alias("ordinal"), F.concat("source", F.lit("("), "lang", F.lit(")("), F.col("doc_id") % 10, F.lit(")")).alias("citation_path"), "text")


CHUNKS = "chunks AS (SELECT doc_id AS id, doc_id AS version_id, 0 AS ordinal, source || '(' || lang || ')(' || (doc_id % 10) || ')' AS citation_path, text FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: ids divisible by 20, against all vectors."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))


VECTORS = """vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector FROM embeddings),
vq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 20 = 0)"""


def text_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXT_QUERIES, "qid long, query string")


TEXT_Q = "tq(qid, query) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in TEXT_QUERIES) + ")"
