"""Corpus pipeline: five stages, each on all that its predecessor kept; the rows are written and read between them.

What holds for every stage: a null in any column, an empty and a very long text, rows that repeat and an empty table
are taken; every column of documents passes through with its values, also one named like a column that an operator
adds, as operators get such columns under other names (`aside`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import decontaminate, mixing, pii, simhash, toxicity
from chronolode.llm._session import checkpoint, ship


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones under numbered names, and the columns that bring docs' own names back."""
    names = {c: c if c in used else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, as do repeats of such a row, whose score is the same.

    A null or empty text has score 0 and stays, so does a row with a null id; without any toxic label nothing goes.
    """
    ship(spark)
    rows, back = aside(docs, "doc_id", "text")
    model = toxicity.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(rows, model).filter("predicted = 0").select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id.

    Null, empty and wordless texts have fingerprint zero and are one component; null ids come last; of rows with the
    same id and text one stays, of rows with the same id and other texts the one whose text has the smallest hash.
    """
    ship(spark)
    rows, back = aside(docs, "doc_id", "text")
    return simhash.deduplicate(rows).select(*back)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any whole benchmark window go, however long they are around it.

    That is stricter than the operator's own `contaminated`, by which a passage in a long document may stay. A null,
    empty or wordless text holds none and stays; rows that repeat go or stay together; an empty benchmark keeps all.
    """
    ship(spark)
    rows, back = aside(docs, "doc_id", "text")
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("n_hit = 0").select(*back)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in angle brackets; every row stays and n_chars follows a changed text.

    A null text stays null, an empty one empty; rows that repeat change alike; a null id is no obstacle.
    """
    ship(spark)
    rows, back = aside(docs, "doc_id", "text", "n_chars")
    return pii.redact(rows).select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents that the mix takes, each with size, source_size, target and taken.

    A null source is one of its own; null and empty texts have no words and are not taken; equal lengths go by seeded
    hash. Where documents have a column of one of these names it keeps its values and the mix's is named mix_<name>.
    """
    ship(spark)
    rows, back = aside(docs, "doc_id", "text", "source")
    out = mixing.mix(rows).filter("taken > 0")
    added = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "taken")]
    return out.select(*back, *added)


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("decontamination", contaminated), ("pii", private), ("mixing", mixed)]

#: No SQL: a learned classifier and seeded selection; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are a table in the checkpoint folder for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
