"""Inverted index and BM25 as DataFrames.

postings(term, id, tf, dl) are the index; document frequencies and the corpus averages are aggregates of it. A search
joins the few query terms with the postings; the admissible filter is a semi join on the postings before anything is
scored, while frequencies and averages stay those of the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions import text as tx

K1, B = 1.2, 0.75
MAX_QUERY_TERMS = 1000


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of chunks(id, text). A document's terms are counted within its row: no shuffle of tokens."""
    words = chunks.select("id", tx.tokens(F.col("text")).alias("w"))
    rows = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return rows.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", F.col("tf").cast("int").alias("tf"), "dl")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: int, df) -> F.Column:
    return F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def gaps(index: DataFrame) -> DataFrame:
    """Postings with each id's distance from the term's previous one."""
    return index.withColumn("gap", F.col("id") - F.coalesce(F.lag("id").over(Window.partitionBy("term").orderBy("id")), F.lit(0)))


def index_stats(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Documents, terms, postings, bytes of gaps and frequencies as varints, of fixed 32-bit pairs, and their ratio."""
    sized = gaps(index).agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("term").alias("terms"), F.coalesce(F.sum(tx.varint_bytes(F.col("gap")) + tx.varint_bytes(F.col("tf"))), F.lit(0)).alias("bytes"))
    both = sized.withColumn("documents", F.lit(0)).unionByName(chunks.agg(F.count(F.lit(1)).alias("documents")).select(F.lit(0).alias("postings"), F.lit(0).alias("terms"), F.lit(0).alias("bytes"), "documents"))
    t = both.agg(*[F.sum(c).alias(c) for c in ("documents", "terms", "postings", "bytes")]).withColumn("fixed32_bytes", F.col("postings") * 8)
    return t.withColumn("ratio", F.when(F.col("bytes") > 0, F.col("fixed32_bytes") / F.col("bytes")).otherwise(0.0))


@dataclass
class LexicalIndex:
    """Postings with the corpus size and mean length that scores need (one row from an aggregate)."""

    postings: DataFrame
    frequencies: DataFrame
    n: int
    average: float

    @classmethod
    def build(cls, chunks: DataFrame) -> LexicalIndex:
        index = postings(chunks)
        size = chunks.select(F.size(tx.tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)), F.avg("dl")).first()
        return cls(index, document_frequency(index), size[0], float(size[1] or 0.0))

    def search(self, queries: DataFrame, k: int = 10, *, admissible: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank): the k best of queries(qid, query), ties by id. A term that a query repeats counts
        as often. The query terms are broadcast up to MAX_QUERY_TERMS; beyond, the join shuffles on term."""
        terms = queries.select("qid", F.explode(tx.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
        listed = [r["term"] for r in terms.select("term").distinct().limit(MAX_QUERY_TERMS + 1).collect()]
        few = len(listed) <= MAX_QUERY_TERMS
        hint = F.broadcast if few else (lambda x: x)
        # A literal list is pushed below the aggregates that make postings and frequencies, and into saved tables' scans.
        some = F.col("term").isin(listed) if few else F.lit(True)
        weights = self.frequencies.filter(some).join(hint(terms), "term").select("qid", "term", (F.col("times") * idf(self.n, F.col("df"))).alias("w"))
        rows = self.postings.filter(some)
        rows = rows if admissible is None else rows.join(admissible.select("id"), "id", "left_semi")
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(self.average or 1.0))
        part = F.col("w") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)
        scored = rows.join(hint(weights), "term").groupBy("qid", "id").agg(F.round(F.sum(part), 9).alias("score"))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def match_all(index: DataFrame, queries: DataFrame, k: int = 10, *, admissible: DataFrame | None = None) -> DataFrame:
    """(qid, id, hits, rank) of documents that hold every term of a query, those with most occurrences first. A plain
    stand-in for a database's full-text match; terms are not stemmed."""
    terms = queries.select("qid", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))
    need = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("need"))
    rows = index if admissible is None else index.join(admissible.select("id"), "id", "left_semi")
    met = rows.join(terms, "term").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("met"), F.sum("tf").alias("hits"))
    full = met.join(need, "qid").filter(F.col("met") == F.col("need"))
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "id"))).filter(F.col("rank") <= k).select("qid", "id", "hits", "rank")
