"""Temporal reads, lexical, vector and hybrid search, and their measurement."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions import numbers as nm
from chronolode.functions import text as tx
from chronolode.operators import evaluation as ev
from chronolode.operators import fusion, lexical, suite, temporal
from chronolode.operators import vectors as vx
from chronolode.plans import views as v

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *days: str):
    """Registers a query with its SQL; days names the columns that are dates, which come out as ISO text."""
    return v.register(QUERIES, ORACLES, sql, days)


_CTE = f"WITH {v.VERSIONS}, {v.CHUNKS}"
_ADM = f"adm AS (SELECT c.id FROM chunks c JOIN versions USING (version_id) WHERE {v.live()})"


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return v.versions(spark, d), v.chunks(spark, d)


@query(f"{_CTE} SELECT c.id, section, citation_path, effective_from, coalesce(effective_to, DATE '9999-12-31') AS effective_to FROM chunks c JOIN versions USING (version_id) WHERE {v.live()}", "effective_from", "effective_to")
def asof_filter(spark: SparkSession, d: str) -> DataFrame:
    return temporal.chunks_as_of(*_both(spark, d), v.AS_OF).select("id", "section", "citation_path", "effective_from", F.coalesce("effective_to", F.lit(dt.date(9999, 12, 31))).alias("effective_to"))


@query(f"{_CTE} SELECT c.id, section FROM chunks c JOIN versions USING (version_id) WHERE {v.live(True)}")
def asof_known_at(spark: SparkSession, d: str) -> DataFrame:
    return temporal.chunks_as_of(*_both(spark, d), v.AS_OF, known_at=v.KNOWN_AT).select("id", "section")


@query(f"{_CTE} SELECT count(*) AS n FROM chunks c JOIN versions USING (version_id) WHERE {v.live()} AND document_id = 'en'")
def asof_count(spark: SparkSession, d: str) -> DataFrame:
    return temporal.count_as_of(*_both(spark, d), v.AS_OF, document="en")


@query(f"{_CTE} SELECT c.id, citation_path FROM chunks c JOIN versions USING (version_id) WHERE {v.live()} AND citation_path LIKE 'src1_(%%'")
def asof_prefix(spark: SparkSession, d: str) -> DataFrame:
    return temporal.chunks_as_of(*_both(spark, d), v.AS_OF, prefix="src1_(%").select("id", "citation_path")


@query(f"{_CTE} SELECT id, section FROM (SELECT c.id, section, ordinal FROM chunks c JOIN versions USING (version_id) WHERE {v.live()} ORDER BY section, ordinal, id LIMIT 25)")
def asof_ordered(spark: SparkSession, d: str) -> DataFrame:
    return temporal.chunks_as_of(*_both(spark, d), v.AS_OF, limit=25).select("id", "section")


@query(f"{_CTE}, {_ADM} SELECT (SELECT count(*) FROM adm) AS admissible, (SELECT count(*) FROM chunks) AS corpus, (SELECT count(*) FROM adm)::DOUBLE / (SELECT count(*) FROM chunks) AS selectivity")
def admissible_selectivity(spark: SparkSession, d: str) -> DataFrame:
    ver, ch = _both(spark, d)
    return temporal.selectivity(temporal.admissible_ids(ver, ch, v.AS_OF), ch).select(F.col("admissible").cast("long"), F.col("corpus").cast("long"), "selectivity")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as version records: a section is a customer, issued with the first shipment."""
    shipped = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("issue_date"))
    orders = v.table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("section"), F.col("o_orderdate").cast("date").alias("effective_from"), "issue_date", (F.col("o_orderstatus") == "P").alias("removed"))


_RECORDS = """WITH rec AS (SELECT o_orderkey AS record_id, o_custkey AS section, o_orderdate::DATE AS effective_from, issue_date, o_orderstatus = 'P' AS removed
  FROM orders JOIN (SELECT l_orderkey, min(l_shipdate)::DATE AS issue_date FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
one AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY section, effective_from ORDER BY issue_date, record_id) = 1),
tl AS (SELECT *, lead(effective_from) OVER (PARTITION BY section ORDER BY effective_from) AS effective_to FROM one)"""


@query(f"{_RECORDS} SELECT record_id, section, effective_from, issue_date FROM one", "effective_from", "issue_date")
def timeline_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return temporal.first_issued(_records(spark, d)).select("record_id", "section", "effective_from", "issue_date")


@query(f"{_RECORDS} SELECT record_id, section, effective_from, coalesce(effective_to, DATE '9999-12-31') AS effective_to, removed FROM tl", "effective_from", "effective_to")
def timeline_build(spark: SparkSession, d: str) -> DataFrame:
    return temporal.timeline(_records(spark, d)).select("record_id", "section", "effective_from", F.coalesce("effective_to", F.lit(dt.date(9999, 12, 31))).alias("effective_to"), "removed")


_PTS = "pts AS (SELECT c_custkey AS section, DATE '1995-06-01' + (c_custkey % 2000)::INT AS day FROM customer)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("section"), F.expr("date_add(DATE '1995-06-01', CAST(c_custkey % 2000 AS INT))").alias("day"))


@query(f"{_RECORDS}, {_PTS} SELECT p.section, day, coalesce(record_id, -1) AS version FROM pts p LEFT JOIN tl t ON p.section = t.section AND effective_from <= day AND (effective_to IS NULL OR day < effective_to)", "day")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    return temporal.covering(_points(spark, d), temporal.timeline(_records(spark, d))).select("section", "day", F.coalesce("version", F.lit(-1)).alias("version"))


@query(f"{_RECORDS}, {_PTS}, j AS (SELECT p.section, record_id FROM pts p LEFT JOIN tl t ON p.section = t.section AND effective_from <= day AND (effective_to IS NULL OR day < effective_to)) "
       "SELECT count(*) AS parsed, count(*) FILTER (record_id IS NULL) AS skipped FROM j")
def ingest_skipped(spark: SparkSession, d: str) -> DataFrame:
    j = temporal.covering(_points(spark, d), temporal.timeline(_records(spark, d)))
    return j.agg(F.count(F.lit(1)).alias("parsed"), F.count_if(F.col("version").isNull()).alias("skipped"))


@query(f"""WITH o AS (SELECT doc_id AS version_id, source AS section, DATE '{v.EPOCH}' + (doc_id % 3500)::INT AS a, DATE '{v.EPOCH}' + (doc_id % 3500 + 5 + doc_id % 40)::INT AS b FROM documents)
SELECT x.section, x.version_id AS a, y.version_id AS b FROM o x JOIN o y ON x.section = y.section AND (x.a < y.a OR x.a = y.a AND x.version_id < y.version_id) AND x.b > y.a""")
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.col("source").alias("section"), v._day("doc_id % 3500").alias("effective_from"), v._day("doc_id % 3500 + 5 + doc_id % 40").alias("effective_to"), F.lit(None).cast("date").alias("superseded_at"))
    return temporal.overlaps(o)


_TURNS = f"turns AS (SELECT conv_id, turn, DATE '{v.EPOCH}' + ((conv_id * 7 + (turn // 2) * 400) % 3500)::INT AS as_of, role, text FROM conversations)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "conversations").select("conv_id", "turn", v._day("(conv_id * 7 + CAST(turn / 2 AS INT) * 400) % 3500").alias("as_of"), "role", "text")


@query(f"{_CTE}, {_TURNS}, p AS (SELECT conv_id, min(as_of) AS a, max(as_of) AS b FROM turns GROUP BY 1), f AS (SELECT DISTINCT effective_from AS e FROM versions) "
       "SELECT conv_id, a, b, (SELECT count(*) FROM f WHERE e > a AND e < b)::INT AS amendments FROM p", "a", "b")
def amendments_between(spark: SparkSession, d: str) -> DataFrame:
    pairs = turns(spark, d).groupBy("conv_id").agg(F.min("as_of").alias("a"), F.max("as_of").alias("b"))
    return temporal.amendments_between(pairs, v.versions(spark, d), "a", "b")


@query(f"WITH {v.VERSIONS} SELECT count(*) AS versions, count(DISTINCT section) AS sections, count(DISTINCT effective_from) AS dates, min(effective_from) AS since, max(effective_from) AS latest FROM versions", "since", "latest")
def horizon_stats(spark: SparkSession, d: str) -> DataFrame:
    return temporal.horizon(v.versions(spark, d))


@query(f"""{_CTE}, cited AS (SELECT v.* FROM versions v WHERE {v.live()} AND version_id % 5 = 0),
days AS (SELECT CASE WHEN effective_from > DATE '{v.EPOCH}' THEN effective_from - 1 END AS day FROM cited UNION SELECT effective_to FROM cited)
SELECT day FROM days WHERE day IS NOT NULL AND day <> DATE '{v.AS_OF}' ORDER BY day DESC LIMIT 3""", "day")
def compare_dates(spark: SparkSession, d: str) -> DataFrame:
    cited = v.versions(spark, d).filter(temporal.as_of(v.AS_OF) & (F.col("version_id") % 5 == 0))
    return temporal.compare_dates(cited, as_of=v.AS_OF, since=dt.date.fromisoformat(v.EPOCH))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _tok(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss')), '[a-z0-9]+(?:[.\-][a-z0-9]+)*'), lambda t: t NOT IN ({_STOP}))"


_POST = f"""tk AS (SELECT id, {_tok('text')} AS w FROM chunks), dl AS (SELECT id, len(w) AS dl FROM tk),
post AS (SELECT term, t.id, count(*)::INT AS tf, any_value(dl)::INT AS dl FROM (SELECT id, unnest(w) AS term FROM tk) t JOIN dl ON dl.id = t.id GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl)"""
_LEX = f"WITH {v.CHUNKS}, {_POST}"


@query(f"{_LEX} SELECT id, dl::INT AS n_tokens, len(list_distinct(w))::INT AS n_terms, text_len FROM tk JOIN dl USING (id) JOIN (SELECT id, length(text)::INT AS text_len FROM chunks) USING (id)")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    w = v.chunks(spark, d).select("id", tx.tokens(F.col("text")).alias("w"), F.length("text").alias("text_len"))
    return w.select("id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_terms"), "text_len")


@query(f"{_LEX} SELECT term, id, tf, dl FROM post")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(v.chunks(spark, d))


@query(f"{_LEX} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM df, st")
def df_idf(spark: SparkSession, d: str) -> DataFrame:
    ch = v.chunks(spark, d)
    n = ch.count()
    return lexical.document_frequency(lexical.postings(ch)).select("term", "df", F.round(lexical.idf(n, F.col("df")), 9).alias("idf"))


@query(f"{_LEX} SELECT term, id, id - coalesce(lag(id) OVER (PARTITION BY term ORDER BY id), 0) AS gap FROM post")
def postings_gaps(spark: SparkSession, d: str) -> DataFrame:
    return lexical.gaps(lexical.postings(v.chunks(spark, d))).select("term", "id", "gap")


def _vb(x: str) -> str:
    return f"greatest(1, ceil(length(bin({x})) / 7.0))"


@query(f"{_LEX}, g AS (SELECT term, tf, id - coalesce(lag(id) OVER (PARTITION BY term ORDER BY id), 0) AS gap FROM post), "
       f"s AS (SELECT count(*) AS postings, count(DISTINCT term) AS terms, sum({_vb('gap')} + {_vb('tf')})::BIGINT AS bytes FROM g) "
       "SELECT (SELECT count(*) FROM chunks) AS documents, terms, postings, bytes, postings * 8 AS fixed32_bytes, postings * 8 / bytes AS ratio FROM s")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    ch = v.chunks(spark, d)
    return lexical.index_stats(ch, lexical.postings(ch))


def _bm25(admissible: bool, k: int) -> str:
    f = "WHERE p.id IN (SELECT id FROM adm)" if admissible else ""
    return f"""{_CTE}, {_ADM}, {_POST}, {v.TEXT_Q},
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_tok('query')}) AS term FROM tq) GROUP BY 1, 2),
sc AS (SELECT qid, p.id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.dl / a))), 9) AS score
       FROM post p JOIN df USING (term) JOIN qt USING (term), st {f} GROUP BY 1, 2),
bm AS (SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM sc QUALIFY rank <= {k})"""


def _lex(spark: SparkSession, d: str) -> lexical.LexicalIndex:
    return lexical.LexicalIndex.build(v.chunks(spark, d))


def _adm(spark: SparkSession, d: str) -> DataFrame:
    return temporal.admissible_ids(*_both(spark, d), v.AS_OF)


@query(f"{_bm25(False, 10)} SELECT qid, id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lex(spark, d).search(v.text_queries(spark), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"{_bm25(True, 10)} SELECT qid, id, round(score, 6) AS score, rank FROM bm")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _lex(spark, d).search(v.text_queries(spark), 10, admissible=_adm(spark, d)).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"{_bm25(False, 10)}, n AS (SELECT qid, count(*) FILTER (id IN (SELECT id FROM adm)) AS survivors FROM bm GROUP BY 1) SELECT qid, survivors, survivors = 0 AS empty FROM n")
def bm25_postfilter_loss(spark: SparkSession, d: str) -> DataFrame:
    top = _lex(spark, d).search(v.text_queries(spark), 10).select("qid", "id")
    ok = _adm(spark, d).select("id", F.lit(1).alias("ok"))
    t = top.join(ok, "id", "left").groupBy("qid").agg(F.count("ok").alias("survivors"))
    return t.withColumn("empty", F.col("survivors") == 0)


def _knn(admissible: bool, k: int, name: str = "nn") -> str:
    f = "WHERE vecs.id IN (SELECT id FROM adm)" if admissible else ""
    return f"""{name} AS (SELECT qid, id, distance, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::INT AS rank
  FROM (SELECT qid, vecs.id, round(1 - list_dot_product(vecs.vector, vq.vector), 12) AS distance FROM vecs, vq {f}) QUALIFY rank <= {k})"""


@query(f"{_LEX}, {v.TEXT_Q}, qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({_tok('query')}) AS term FROM tq)), nt AS (SELECT qid, count(*) AS need FROM qt GROUP BY 1), "
       "m AS (SELECT qid, id, count(*) AS met, sum(tf)::BIGINT AS hits FROM post JOIN qt USING (term) GROUP BY 1, 2) SELECT qid, id, hits, (row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id))::INT AS rank FROM m JOIN nt USING (qid) WHERE met = need QUALIFY rank <= 10")
def fts_match_all(spark: SparkSession, d: str) -> DataFrame:
    return lexical.match_all(lexical.postings(v.chunks(spark, d)), v.text_queries(spark))


_KNN = f"{_CTE}, {_ADM}, {v.VECTORS}"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"{_KNN}, {_knn(False, 10)} SELECT qid, id, round(distance, 6) + 0 AS distance, rank FROM nn")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return _hits(vx.ExactIndex(v.vectors(spark, d)).search(v.vector_queries(spark, d), 10))


@query(f"{_KNN}, {_knn(True, 10)} SELECT qid, id, round(distance, 6) + 0 AS distance, rank FROM nn")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _hits(vx.ExactIndex(v.vectors(spark, d)).search(v.vector_queries(spark, d), 10, admissible=_adm(spark, d)))


@query(f"{_KNN}, {_knn(False, 5)} SELECT qid, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids, round(max(distance), 6) AS threshold FROM nn GROUP BY 1")
def knn_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    nn = vx.scan(v.vectors(spark, d), v.vector_queries(spark, d), 5)
    return nn.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"), F.round(F.max("distance"), 6).alias("threshold"))


def _fixed_centroids(spark: SparkSession, d: str) -> np.ndarray:
    """The first vector of each label."""
    first = v.table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).orderBy("label").collect()
    return np.array([r["e"] for r in first], np.float64)


_CELLS = """cen AS (SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS cell, c FROM (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY 1)),
asg AS (SELECT id, vector, cell FROM (SELECT id, vector, cell, row_number() OVER (PARTITION BY id ORDER BY round(list_dot_product(vector, c), 12) DESC, cell) AS r FROM vecs, cen) WHERE r = 1),
cd AS (SELECT qid, vq.vector, cell, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(vq.vector, c), 12), cell) AS r FROM vq, cen)"""


@query(f"WITH {v.VECTORS}, {_CELLS} SELECT id, cell FROM asg")
def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    return vx.assign(v.vectors(spark, d), _fixed_centroids(spark, d)).select("id", "cell")


@query(f"WITH {v.VECTORS}, {_CELLS}, n AS (SELECT cen.cell, count(id) AS n FROM cen LEFT JOIN asg USING (cell) GROUP BY 1) SELECT count(*)::INT AS n_lists, min(n) AS smallest, max(n) AS largest, sum(n) / count(*) AS mean, count(*) FILTER (n = 0) AS empty, max(n) / (sum(n) / count(*)) AS imbalance FROM n")
def ivf_list_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _fixed_centroids(spark, d)
    return vx.list_stats(vx.assign(v.vectors(spark, d), c), len(c))


@query(f"""WITH {v.VECTORS}, {_CELLS}, h AS (SELECT qid, id, round(1 - list_dot_product(asg.vector, cd.vector), 12) AS distance FROM cd JOIN asg USING (cell) WHERE r <= 3)
SELECT qid, id, round(distance, 6) + 0 AS distance, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::INT AS rank FROM h QUALIFY rank <= 10""")
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(vx.CellIndex(v.vectors(spark, d), _fixed_centroids(spark, d)).search(v.vector_queries(spark, d), 10, effort=3))


@query(f"""{_KNN}, {_CELLS}, ok AS (SELECT * FROM asg WHERE id IN (SELECT id FROM adm)), n AS (SELECT cell, count(*) AS n FROM ok GROUP BY 1),
w AS (SELECT qid, vector, cell, r, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY qid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cd LEFT JOIN n USING (cell)),
p AS (SELECT * FROM w WHERE r <= 2 OR before < 10), used AS (SELECT qid, count(*)::INT AS probed FROM p GROUP BY 1),
h AS (SELECT qid, id, round(1 - list_dot_product(ok.vector, p.vector), 12) AS distance FROM p JOIN ok USING (cell))
SELECT qid, id, round(distance, 6) + 0 AS distance, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::INT AS rank, probed FROM h JOIN used USING (qid) QUALIFY rank <= 10""")
def ivf_filtered_probe(spark: SparkSession, d: str) -> DataFrame:
    index = vx.CellIndex(v.vectors(spark, d), _fixed_centroids(spark, d))
    hits = index.search(v.vector_queries(spark, d), 10, effort=2, admissible=_adm(spark, d), with_probes=True)
    return hits.select("qid", "id", F.round("distance", 6).alias("distance"), "rank", "probed")


@query()
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of fitted cells."""
    index = vx.CellIndex(v.vectors(spark, d), n_lists=10)
    return index.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query()
def hnsw_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(vx.GraphIndex(v.vectors(spark, d)).search(v.vector_queries(spark, d), 10))


@query()
def hnsw_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _hits(vx.GraphIndex(v.vectors(spark, d)).search(v.vector_queries(spark, d), 10, admissible=_adm(spark, d)))


def _hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    """Text query i with the vector of id 20 (i - 1)."""
    vec = v.vector_queries(spark, d).select((F.col("qid") / 20 + 1).cast("long").alias("qid"), "vector")
    return v.text_queries(spark).join(F.broadcast(vec.filter(F.col("qid") <= len(v.TEXT_QUERIES))), "qid")


_HYBRID = _bm25(True, 50) + f""", {v.VECTORS.replace('vq AS (SELECT vec_id AS qid', 'vq AS (SELECT vec_id // 20 + 1 AS qid').replace('vec_id % 20 = 0)', f'vec_id % 20 = 0 AND vec_id // 20 + 1 <= {len(v.TEXT_QUERIES)})')}, {_knn(True, 50)},
l AS (SELECT qid, 'lexical' AS list, id, rank FROM bm UNION ALL SELECT qid, 'vector', id, rank FROM nn),
fu AS (SELECT qid, id, floor(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) * 1e12) / 1e12 AS score, coalesce(max(rank) FILTER (list = 'lexical'), 0) AS lexical_rank, coalesce(max(rank) FILTER (list = 'vector'), 0) AS vector_rank FROM l GROUP BY 1, 2)"""


@query(f"{_HYBRID} SELECT qid, id, round(score, 9) AS score, lexical_rank, vector_rank, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM fu QUALIFY rank <= 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: both retrievers over the ids in force, fused by reciprocal rank."""
    hits = fusion.hybrid_search(_hybrid_queries(spark, d), lexical=_lex(spark, d), vector=vx.ExactIndex(v.vectors(spark, d)), admissible=_adm(spark, d), k=10)
    return hits.select("qid", "id", F.round("score", 9).alias("score"), *[F.coalesce(F.col("ranks")[c], F.lit(0)).alias(f"{c}_rank") for c in ("lexical", "vector")], "rank")


@query(f"{_HYBRID} SELECT qid, count(*) FILTER (lexical_rank > 0) AS candidates_lexical, count(*) FILTER (vector_rank > 0) AS candidates_vector, least(10, count(*))::BIGINT AS fused FROM fu GROUP BY 1")
def hybrid_trace(spark: SparkSession, d: str) -> DataFrame:
    t = fusion.trace(_hybrid_queries(spark, d), lexical=_lex(spark, d), vector=vx.ExactIndex(v.vectors(spark, d)), admissible=_adm(spark, d), k=10)
    return t.select("qid", *[F.col(c).cast("long") for c in ("candidates_lexical", "candidates_vector", "fused")])


_LATER = dt.date(2022, 6, 1)
_FOUND = f"{_HYBRID} SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM fu QUALIFY rank <= 10"


@query(f"WITH a AS ({_FOUND}), b AS ({_FOUND.replace(str(v.AS_OF), str(_LATER))}) SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, coalesce(a.rank, 0) AS rank_before, coalesce(b.rank, 0) AS rank_after, "
       "CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'dropped' WHEN a.rank = b.rank THEN 'same' ELSE 'moved' END AS change FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id")
def hybrid_across_dates(spark: SparkSession, d: str) -> DataFrame:
    """The same questions as of two dates, and what changed between them."""
    before, after = (temporal.admissible_ids(*_both(spark, d), day) for day in (v.AS_OF, _LATER))
    return fusion.across(_hybrid_queries(spark, d), lexical=_lex(spark, d), vector=vx.ExactIndex(v.vectors(spark, d)), before=before, after=after, k=10)


_LISTS = "l AS (SELECT user_id AS qid, event_type AS list, (event_id % 97) AS id, (1 + event_id % 13)::INT AS rank FROM events), b AS (SELECT qid, list, id, min(rank) AS rank FROM l GROUP BY 1, 2, 3)"


@query(f"WITH {_LISTS}, f AS (SELECT qid, id, floor(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) * 1e12) / 1e12 AS score FROM b GROUP BY 1, 2) SELECT qid, id, round(score, 9) AS score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM f QUALIFY rank <= 10")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    lists = v.table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("list"), (F.col("event_id") % 97).alias("id"), (1 + F.col("event_id") % 13).cast("int").alias("rank"))
    return fusion.fuse(lists, limit=10).select("qid", "id", F.round("score", 9).alias("score"), "rank")


# Measurement.
_IVF3 = f"ivf AS (SELECT qid, id, round(1 - list_dot_product(asg.vector, cd.vector), 12) AS distance FROM cd JOIN asg USING (cell) WHERE r <= 3), iv AS (SELECT * FROM ivf QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 10)"


def _ivf_and_truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, q = v.vectors(spark, d), v.vector_queries(spark, d)
    return vx.CellIndex(rows, _fixed_centroids(spark, d)).search(q, 10, effort=3), vx.scan(rows, q, 10)


@query(f"WITH {v.VECTORS}, {_CELLS}, {_IVF3}, {_knn(False, 10)}, th AS (SELECT qid, max(distance) + 1e-5 AS t FROM nn GROUP BY 1) SELECT qid, count(*) FILTER (distance <= t) / 10 AS recall FROM iv JOIN th USING (qid) GROUP BY 1")
def recall_ties(spark: SparkSession, d: str) -> DataFrame:
    return ev.recall_with_ties(*_ivf_and_truth(spark, d), k=10)


@query(f"WITH {v.VECTORS}, {_CELLS}, {_IVF3}, {_knn(False, 10)} SELECT qid, count(nn.id) / 10 AS recall FROM iv LEFT JOIN nn USING (qid, id) GROUP BY 1")
def recall_by_id(spark: SparkSession, d: str) -> DataFrame:
    return ev.recall_by_id(*_ivf_and_truth(spark, d), k=10)


_COLLAPSE = f"{_KNN}, {_knn(True, 10, 'truth')}, {_knn(False, 5000, 'top')}, lv(o) AS (VALUES (1), (2), (5), (10), (25), (50), (100), (250), (500)), " \
    "got AS (SELECT o, qid, id FROM (SELECT o, qid, id, row_number() OVER (PARTITION BY o, qid ORDER BY rank) AS r FROM top JOIN lv ON rank <= 10 * o WHERE id IN (SELECT id FROM adm)) WHERE r <= 10), " \
    "nq AS (SELECT count(*) AS n FROM vq)"


@query(f"{_COLLAPSE} SELECT o AS overfetch, count(truth.id) / (any_value(n) * 10) AS recall FROM lv CROSS JOIN nq LEFT JOIN got USING (o) LEFT JOIN truth USING (qid, id) GROUP BY 1")
def collapse_curve(spark: SparkSession, d: str) -> DataFrame:
    return ev.collapse_curve(vx.ExactIndex(v.vectors(spark, d)), v.vector_queries(spark, d), _adm(spark, d), k=10)


@query(f"{_COLLAPSE}, s AS (SELECT vq.qid, count(id) AS n FROM vq LEFT JOIN (SELECT * FROM got WHERE o = 1) g USING (qid) GROUP BY 1) SELECT avg(n) AS mean_survivors, avg((n = 0)::INT) AS zero_result_rate FROM s")
def collapse_survivors(spark: SparkSession, d: str) -> DataFrame:
    return ev.survivors(vx.ExactIndex(v.vectors(spark, d)), v.vector_queries(spark, d), _adm(spark, d), k=10)


_SYN = ("sel(s) AS (VALUES (0.5), (0.1), (0.02)), syn AS (SELECT s, id FROM (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY (id * 7919) % 10007, id) AS r, count(*) OVER (PARTITION BY s) AS n FROM vecs, sel) "
        "WHERE r <= greatest(1, round_even(n * s, 0)))")


@query(f"""WITH {v.VECTORS}, {_SYN}, pr AS (SELECT syn.s, qid, syn.id, round(1 - list_dot_product(vecs.vector, vq.vector), 12) AS distance FROM syn JOIN vecs USING (id), vq),
truth AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY s, qid ORDER BY distance, id) <= 10),
al AS (SELECT qid, vecs.id, round(1 - list_dot_product(vecs.vector, vq.vector), 12) AS distance, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_dot_product(vecs.vector, vq.vector), 12), vecs.id) AS r FROM vecs, vq),
ov AS (SELECT s, count(*) AS n, count(*) / (SELECT count(*) FROM vecs) AS selectivity, least(512, greatest(1, round_even((SELECT count(*) FROM vecs) / count(*), 0)))::INT AS o FROM syn GROUP BY 1),
pl AS (SELECT s, 'post-filter' AS strategy, 1 AS f FROM ov UNION ALL SELECT s, 'post-filter+overfetch', o FROM ov),
post AS (SELECT s, strategy, qid, id FROM (SELECT pl.s, strategy, qid, al.id, row_number() OVER (PARTITION BY pl.s, strategy, qid ORDER BY al.r) AS p FROM pl JOIN al ON r <= 10 * f JOIN syn ON syn.s = pl.s AND syn.id = al.id) WHERE p <= 10
         UNION ALL SELECT s, 'in-index', qid, id FROM truth),
c AS (SELECT sel.s, st.strategy, vq.qid, count(post.id) AS got, count(truth.id) AS hit FROM sel CROSS JOIN (VALUES ('post-filter'), ('post-filter+overfetch'), ('in-index')) st(strategy) CROSS JOIN vq
      LEFT JOIN post ON post.s = sel.s AND post.strategy = st.strategy AND post.qid = vq.qid LEFT JOIN truth ON truth.s = post.s AND truth.qid = post.qid AND truth.id = post.id GROUP BY 1, 2, 3)
SELECT s::DOUBLE AS level, strategy, sum(hit) / (count(*) * 10) AS recall, avg((got = 0)::INT) AS zero_result_rate FROM c GROUP BY 1, 2""")
def selectivity_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ev.sweep(vx.ExactIndex(v.vectors(spark, d)), v.vectors(spark, d), v.vector_queries(spark, d), levels=(0.5, 0.1, 0.02), k=10)


@query("SELECT event_type, list_sort(list(value))[1 + (0.50 * (count(*) - 1))::DOUBLE::BIGINT - CASE WHEN (0.50 * (count(*) - 1))::DOUBLE::BIGINT > 0.50 * (count(*) - 1) THEN 1 ELSE 0 END] AS p50, "
       "list_sort(list(value))[1 + floor(0.95 * (count(*) - 1))::BIGINT] AS p95, list_sort(list(value))[1 + floor(0.99 * (count(*) - 1))::BIGINT] AS p99, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ev.percentiles(v.table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")


@query("SELECT vec_id AS id, vec_id % 50 = 7 AS is_query FROM embeddings")
def held_out_split(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    corpus, held = ev.held_out(rows, 50, 7)
    return corpus.withColumn("is_query", F.lit(False)).unionByName(held.withColumn("is_query", F.lit(True)))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount / 10.0 AS s FROM lineitem) SELECT DISTINCT s, (CASE WHEN s <= 0 THEN 512 ELSE least(512, greatest(1, round_even(1 / s, 0))) END)::INT AS overfetch FROM s")
def overfetch_required(spark: SparkSession, d: str) -> DataFrame:
    s = v.table(spark, d, "lineitem").select((F.col("l_discount") / 10.0).alias("s")).distinct()
    return s.withColumn("overfetch", nm.required_overfetch(F.col("s")))


@query("""WITH e AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS x FROM embeddings GROUP BY embedding), s AS (SELECT * FROM e),
p AS (SELECT s.id, round(1 - list_dot_product(s.x, e.x), 12) AS d, row_number() OVER (PARTITION BY s.id ORDER BY round(1 - list_dot_product(s.x, e.x), 12), e.id) AS r FROM s JOIN e ON s.id <> e.id),
r AS (SELECT id, greatest(max(sqrt(greatest(2 * d, 0))) FILTER (r = 1), 1e-12) AS r1, max(sqrt(greatest(2 * d, 0))) FILTER (r = 2) AS r2, max(d) FILTER (r = 1) AS nn FROM p WHERE r <= 2 GROUP BY 1)
SELECT (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM e) AS n_distinct, round(count(*) / sum(ln(greatest(r2 / r1, 1 + 1e-12))), 4) AS intrinsic_dim, round(avg(nn), 6) AS mean_nn_distance FROM r""")
def two_nn_dimension(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    g = ev.geometry(rows)
    return g.select("n_vectors", "n_distinct", F.round("intrinsic_dim", 4).alias("intrinsic_dim"), F.round("mean_nn_distance", 6).alias("mean_nn_distance"))


@query()
def index_suite(spark: SparkSession, d: str) -> DataFrame:
    """Recall of every index at two efforts."""
    builders = {"exact": vx.ExactIndex, "cells": vx.CellIndex, "graph": vx.GraphIndex}
    return suite.run_suite(v.vectors(spark, d), v.vector_queries(spark, d), builders, {"cells": (1, 8), "graph": (16, 64)}).drop("build_s", "query_s")
