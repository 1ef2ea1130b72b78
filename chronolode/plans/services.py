"""Embedding cache, queue, prices, answers, conversations, sections: queries over the standard tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.functions import numbers as nm
from chronolode.functions import text as tx
from chronolode.functions import vectors as vf
from chronolode.operators import answers as an
from chronolode.operators import embedcache, jobs, sections
from chronolode.operators import evaluation as ev
from chronolode.plans import views as v
from chronolode.plans.search import _CTE, _RECORDS, _TURNS, _adm, _records, turns
from chronolode.streaming import events as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *days: str):
    return v.register(QUERIES, ORACLES, sql, days)


# Content-addressed embeddings: vectors stand for the texts of the documents with their ids.
_CACHE = """chunks AS (SELECT doc_id AS id, text, sha256(text) AS sha FROM documents),
cache AS (SELECT sha, 'm@64' AS model_id, embedding FROM (SELECT c.sha, e.embedding, row_number() OVER (PARTITION BY c.sha ORDER BY e.vec_id) AS r FROM embeddings e JOIN chunks c ON c.id = e.vec_id WHERE e.vec_id % 3 <> 0) WHERE r = 1)"""


def _cache(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings").filter("vec_id % 3 <> 0").join(embedcache.hashed(v.chunks(spark, d)).select("id", "sha"), F.col("vec_id") == F.col("id"))
    return e.groupBy("sha").agg(F.min_by("embedding", "vec_id").alias("vector")).withColumn("model_id", F.lit("m@64"))


@query(f"WITH {_CACHE} SELECT sha, min(id) AS id FROM chunks WHERE sha NOT IN (SELECT sha FROM cache WHERE model_id = 'm@64') GROUP BY 1")
def embed_todo_anti(spark: SparkSession, d: str) -> DataFrame:
    return embedcache.missing(v.chunks(spark, d), _cache(spark, d), "m@64").select("sha", "id")


@query(f"WITH {_CACHE} SELECT id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm FROM chunks JOIN cache USING (sha)")
def embed_join(spark: SparkSession, d: str) -> DataFrame:
    return embedcache.corpus_vectors(v.chunks(spark, d), _cache(spark, d), "m@64").select("id", F.round(vf.dot(F.col("vector"), F.col("vector")), 5).alias("norm"))


@query(f"WITH {_CACHE} SELECT count(*) AS new_rows, count(DISTINCT sha) AS texts FROM chunks WHERE id IN (SELECT min(id) FROM chunks GROUP BY sha) AND sha NOT IN (SELECT sha FROM cache)")
def embed_new(spark: SparkSession, d: str) -> DataFrame:
    """Vectors made for texts that the cache lacks, by a provider without a model."""
    new = embedcache.embed_missing(v.chunks(spark, d), _cache(spark, d).withColumn("model_id", F.lit("hashing@64")), embedcache.HashingProvider())
    return new.agg(F.count(F.lit(1)).alias("new_rows"), F.countDistinct("sha").alias("texts"))


@query(f"WITH {_CACHE} SELECT count(*) AS chunks, count(DISTINCT sha) AS distinct_texts, count(*) / count(DISTINCT sha) AS ratio FROM chunks")
def dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    return embedcache.dedup_stats(v.chunks(spark, d))


@query(f"WITH {_CACHE} SELECT sha, min(id) AS id, length(any_value(text)) AS n FROM chunks GROUP BY 1")
def distinct_on_hash(spark: SparkSession, d: str) -> DataFrame:
    return embedcache.distinct_texts(v.chunks(spark, d)).select("sha", "id", F.length("text").cast("long").alias("n"))


@query(f"WITH {_CACHE} SELECT count(*) AS n, md5(string_agg(sha, ',' ORDER BY sha)) AS fingerprint FROM chunks")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return embedcache.fingerprint(v.chunks(spark, d))


@query("SELECT min(vec_id) AS id FROM embeddings GROUP BY embedding")
def distinct_vectors(spark: SparkSession, d: str) -> DataFrame:
    return embedcache.first_by_vector(v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).select("id")


@query("SELECT vec_id AS id, round(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[]), 6) AS before, 1.0::DOUBLE AS after FROM embeddings")
def truncate_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    cut, short = vf.truncated(F.col("embedding"), 16), F.slice("embedding", 1, 16)
    return e.select(F.col("vec_id").alias("id"), F.round(vf.dot(short, short), 6).alias("before"), F.round(vf.dot(cut, cut), 6).alias("after"))


@query("SELECT doc_id AS id, length(text) AS char_count, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))::BIGINT AS token_count, sha256(text) AS sha, left(text, 400) AS snippet FROM documents")
def chunk_derive(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "documents")
    return c.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("char_count"), tx.word_count(F.col("text")).cast("long").alias("token_count"), tx.sha256(F.col("text")).alias("sha"), F.substring("text", 1, an.SNIPPET).alias("snippet"))


# The queue: events as jobs, user_id % 10 as the queue, at noon of a fixed day.
NOW = dt.datetime(2024, 1, 15, 12, 0, 0)
_STATE = "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'dead' END"
_JOBS = f"jobs AS (SELECT event_id AS id, user_id % 10 AS queue, event_type AS kind, props AS payload, {_STATE} AS state, (event_id % 3)::INT AS priority, (event_id % 5)::INT AS attempts, 4 AS max_attempts, (event_id % 7)::INT AS lease_epoch, ts AS available_at FROM events)"
_T = f"TIMESTAMP '{NOW}'"


def job_table(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("queue"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), F.expr(_STATE).alias("state"), (F.col("event_id") % 3).cast("int").alias("priority"),
                    (F.col("event_id") % 5).cast("int").alias("attempts"), F.lit(4).alias("max_attempts"), (F.col("event_id") % 7).cast("int").alias("lease_epoch"), F.lit(None).cast("string").alias("claimed_by"), F.col("ts").cast("timestamp").alias("available_at"),
                    F.concat_ws(":", "event_type", "value").alias("idempotency_key"), F.when(F.expr(_STATE).isin("succeeded", "dead"), F.col("ts").cast("timestamp")).alias("finished_at"), F.lit(None).cast("string").alias("last_error"))


def _now() -> Column:
    return F.lit(NOW)


@query(f"WITH {_JOBS}, c AS (SELECT id FROM jobs WHERE queue = 3 AND state IN ('pending', 'running') AND available_at <= {_T} AND attempts < max_attempts ORDER BY priority DESC, available_at, id LIMIT 5) "
       f"SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' ELSE state END AS state, attempts + (id IN (SELECT id FROM c))::INT AS attempts, lease_epoch + (id IN (SELECT id FROM c))::INT AS lease_epoch, epoch_us(CASE WHEN id IN (SELECT id FROM c) THEN {_T} + INTERVAL 90 SECOND ELSE available_at END) AS available_us FROM jobs")
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    after = jobs.claim(job_table(spark, d), 3, "w1", _now(), limit=5, visibility=90)
    return after.select("id", "state", "attempts", "lease_epoch", F.unix_micros("available_at").alias("available_us"))


_DEAD = f"queue = 3 AND state = 'running' AND available_at <= {_T} AND attempts >= max_attempts"


@query(f"WITH {_JOBS} SELECT id, CASE WHEN {_DEAD} THEN 'dead' ELSE state END AS state, CASE WHEN {_DEAD} THEN '{jobs.EXPIRED}' ELSE '' END AS last_error FROM jobs")
def job_reap(spark: SparkSession, d: str) -> DataFrame:
    return jobs.reap(job_table(spark, d), 3, _now()).select("id", "state", F.coalesce("last_error", F.lit("")).alias("last_error"))


@query(f"WITH {_JOBS} SELECT queue, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'succeeded') AS succeeded, 0::BIGINT AS failed, count(*) FILTER (state = 'dead') AS dead, count(*) FILTER (state IN ('pending', 'running')) AS outstanding FROM jobs GROUP BY 1")
def job_stats(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stats(job_table(spark, d))


@query(f"WITH {_JOBS} SELECT id FROM jobs WHERE queue = 3 AND state = 'dead' ORDER BY available_at DESC, id LIMIT 50")
def job_dlq(spark: SparkSession, d: str) -> DataFrame:
    return jobs.dead_letters(job_table(spark, d), 3).select("id")


@query(f"WITH {_JOBS}, b AS (SELECT id FROM jobs WHERE queue = 3 AND state = 'dead' ORDER BY available_at, id LIMIT 100) SELECT id, CASE WHEN id IN (SELECT id FROM b) THEN 'pending' ELSE state END AS state, CASE WHEN id IN (SELECT id FROM b) THEN 0 ELSE attempts END AS attempts FROM jobs")
def job_requeue(spark: SparkSession, d: str) -> DataFrame:
    return jobs.requeue_dead(job_table(spark, d), 3, _now()).select("id", "state", "attempts")


@query("WITH k AS (SELECT event_id AS id, user_id % 10 AS queue, event_type || ':' || (event_id % 50) AS key FROM events), held AS (SELECT DISTINCT queue, key FROM k WHERE id % 4 = 0) "
       "SELECT min(id) AS id FROM k WHERE id % 4 <> 0 AND (queue, key) NOT IN (SELECT (queue, key) FROM held) GROUP BY queue, key")
def job_dedupe(spark: SparkSession, d: str) -> DataFrame:
    k = v.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("queue"), F.concat_ws(":", "event_type", F.col("event_id") % 50).alias("idempotency_key"))
    return jobs.enqueue(k.filter("id % 4 = 0"), k.filter("id % 4 <> 0")).select("id")


_OWN = "state = 'running' AND id % 2 = 0"


@query(f"WITH {_JOBS} SELECT id, CASE WHEN {_OWN} THEN 'succeeded' ELSE state END AS state FROM jobs")
def job_ack(spark: SparkSession, d: str) -> DataFrame:
    """Even jobs report success with their own epoch, odd ones with an old one."""
    t = job_table(spark, d)
    done = t.filter("state = 'running'").select("id", (F.col("lease_epoch") - F.col("id") % 2).alias("lease_epoch"))
    return jobs.ack(t, done, _now()).select("id", "state")


@query(f"WITH {_JOBS} SELECT id, CASE WHEN {_OWN} THEN (CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'pending' END) ELSE state END AS state, "
       f"epoch_us(CASE WHEN {_OWN} AND attempts < max_attempts THEN {_T} + to_microseconds((500000 * least(30, pow(2, attempts - 1)))::BIGINT) ELSE available_at END) AS available_us FROM jobs")
def job_nack(spark: SparkSession, d: str) -> DataFrame:
    """Even jobs report failure; the jitter is held at its middle."""
    t = job_table(spark, d)
    bad = t.filter("state = 'running'").select("id", (F.col("lease_epoch") - F.col("id") % 2).alias("lease_epoch"), F.lit("boom").alias("error"))
    return jobs.nack(t, bad, _now(), u=F.lit(0.5)).select("id", "state", F.unix_micros("available_at").alias("available_us"))


@query(f"WITH {_JOBS} SELECT id, epoch_us(CASE WHEN {_OWN} THEN {_T} + INTERVAL 30 SECOND ELSE available_at END) AS available_us FROM jobs")
def job_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    t = job_table(spark, d)
    alive = t.filter("state = 'running'").select("id", (F.col("lease_epoch") - F.col("id") % 2).alias("lease_epoch"))
    return jobs.heartbeat(t, alive, _now()).select("id", F.unix_micros("available_at").alias("available_us"))


@query(f"{_RECORDS}, days AS (SELECT DISTINCT date_trunc('month', effective_from)::DATE AS day FROM rec) SELECT day, 'snapshot:' || day AS idempotency_key, count(*)::INT AS n FROM days JOIN tl ON effective_from <= day AND (effective_to IS NULL OR day < effective_to) GROUP BY day", "day")
def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    from chronolode.operators import temporal

    tl = temporal.timeline(_records(spark, d))
    days = _records(spark, d).select(F.trunc("effective_from", "month").alias("day"))
    return jobs.plan_ingest(days, tl).select("day", "idempotency_key", "n")


# Prices: rates change inside the month of the events.
_RATES = "rates(model, input_rate, output_rate, f, t) AS (VALUES ('click', 2.00, 10.00, DATE '2023-01-01', DATE '2024-01-16'), ('click', 3.00, 15.00, DATE '2024-01-16', NULL), ('view', 0.25, 1.25, DATE '2023-01-01', NULL), ('purchase', 5.00, 25.00, DATE '2023-01-01', NULL), ('signup', 1.10, 4.40, DATE '2023-01-01', DATE '2025-01-01'), ('error', 0.15, 0.60, DATE '2023-01-01', NULL))"
_USAGE = "usage AS (SELECT event_id AS usage_id, user_id AS run_id, event_type AS model, ts::DATE AS day, event_id % 4001 AS fresh, event_id % 307 AS cw, event_id % 2003 AS cr, event_id % 911 AS o FROM events)"
_COST = f"""WITH {_RATES}, {_USAGE}, raw AS (SELECT usage_id, run_id, (fresh * (input_rate * 100)::BIGINT * 100 + cw * (input_rate * 100)::BIGINT * 125 + cr * (input_rate * 100)::BIGINT * 10 + o * (output_rate * 100)::BIGINT * 100)::HUGEINT AS tt
  FROM usage u JOIN rates r ON u.model = r.model AND f <= day AND (t IS NULL OR day < t)),
cost AS (SELECT usage_id, run_id, (tt // 10000 + CASE WHEN tt % 10000 > 5000 OR (tt % 10000 = 5000 AND (tt // 10000) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS micros FROM raw)"""


def _priced(spark: SparkSession, d: str) -> DataFrame:
    day = dt.date
    rates = spark.createDataFrame([("click", "2.00", "10.00", day(2023, 1, 1), day(2024, 1, 16)), ("click", "3.00", "15.00", day(2024, 1, 16), None), ("view", "0.25", "1.25", day(2023, 1, 1), None), ("purchase", "5.00", "25.00", day(2023, 1, 1), None),
                                   ("signup", "1.10", "4.40", day(2023, 1, 1), day(2025, 1, 1)), ("error", "0.15", "0.60", day(2023, 1, 1), None)], "model string, input_rate string, output_rate string, effective_from date, effective_to date")
    e = v.table(spark, d, "events")
    use = e.select(F.col("event_id").alias("usage_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("model"), F.to_date("ts").alias("day"), (F.col("event_id") % 4001).alias("fresh"), (F.col("event_id") % 307).alias("cache_write"), (F.col("event_id") % 2003).alias("cache_read"), (F.col("event_id") % 911).alias("output"))
    return an.priced(use, rates)


@query(f"{_COST} SELECT usage_id, micros FROM cost")
def rate_asof_cost(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("usage_id", (F.col("cost") * 1_000_000).cast("long").alias("micros"))


@query(f"{_COST} SELECT coalesce(run_id, -1) AS run_id, sum(micros)::BIGINT AS micros FROM cost GROUP BY ROLLUP (run_id)")
def ledger_total(spark: SparkSession, d: str) -> DataFrame:
    return an.ledger(_priced(spark, d), "run_id").select(F.coalesce("run_id", F.lit(-1)).alias("run_id"), (F.col("total") * 1_000_000).cast("long").alias("micros"))


# Answers. A document's answer cites itself and some neighbours with quotes from, or not from, its own text.
_REFS = """refs AS (SELECT doc_id AS answer, 0 AS pos, doc_id AS id, substr(text, 3, 40) AS quote FROM documents
UNION ALL SELECT doc_id, 1, doc_id + 1, '' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, doc_id + 100000, 'x' FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 3, doc_id, 'repeated' FROM documents UNION ALL SELECT doc_id, 4, doc_id + 2, 'no such words' FROM documents WHERE doc_id % 5 = 0)"""
_SHOWN = "shown AS (SELECT doc_id AS answer, doc_id AS id, text FROM documents UNION ALL SELECT d.doc_id, e.doc_id, e.text FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 UNION ALL SELECT d.doc_id, e.doc_id, e.text FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 2)"
_OK = "ok AS (SELECT doc_id AS id FROM documents WHERE doc_id % 17 <> 0)"
_WS = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CHECKS = f"""WITH {_REFS}, {_SHOWN}, {_OK}, one AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY answer, id ORDER BY pos) = 1),
checks AS (SELECT o.answer, o.id, CASE WHEN o.id NOT IN (SELECT doc_id FROM documents) THEN 'exists' WHEN s.id IS NULL THEN 'retrieved' WHEN o.id NOT IN (SELECT id FROM ok) THEN 'admissible'
  WHEN {_WS.format('quote')} <> '' AND contains({_WS.format('s.text')}, {_WS.format('quote')}) THEN 'ok' ELSE 'quote' END AS "check" FROM one o LEFT JOIN shown s ON s.answer = o.answer AND s.id = o.id)"""


def _checks(spark: SparkSession, d: str) -> DataFrame:
    doc = v.table(spark, d, "documents").select("doc_id", "text")
    ref = lambda where, pos, shift, quote: doc.filter(where).select(F.col("doc_id").alias("answer"), F.lit(pos).alias("pos"), (F.col("doc_id") + shift).alias("id"), quote.alias("quote"))
    refs = ref("true", 0, 0, F.substring("text", 3, 40))
    for r in (ref("doc_id % 3 = 0", 1, 1, F.lit("")), ref("doc_id % 7 = 0", 2, 100000, F.lit("x")), ref("true", 3, 0, F.lit("repeated")), ref("doc_id % 5 = 0", 4, 2, F.lit("no such words"))):
        refs = refs.unionByName(r)
    shown = doc.select(F.explode(F.array(*[F.col("doc_id") - i for i in range(3)])).alias("answer"), F.col("doc_id").alias("id"), "text").filter("answer >= 0")
    return an.validate(refs, shown, doc.filter("doc_id % 17 <> 0").select(F.col("doc_id").alias("id")), doc.select(F.col("doc_id").alias("id")))


@query(f"{_CHECKS} SELECT answer, id, \"check\" FROM checks")
def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d)


@query(f"{_CHECKS} SELECT answer, bool_and(\"check\" = 'ok') AS ok, count(*) AS cited FROM checks GROUP BY 1")
def answers_hold(spark: SparkSession, d: str) -> DataFrame:
    return an.answers_hold(_checks(spark, d))


_HITS = "hits AS (SELECT user_id AS qid, value / 10000.0 AS score FROM events WHERE user_id % 3 <> 0), qs AS (SELECT DISTINCT user_id AS qid FROM events)"


@query(f"WITH {_HITS}, t AS (SELECT qs.qid, max(score) AS top FROM qs LEFT JOIN hits USING (qid) GROUP BY 1), r AS (SELECT qid, CASE WHEN top IS NULL THEN 'no_admissible_source' WHEN top < 0.02 THEN 'low_confidence' ELSE '' END AS reason FROM t) SELECT qid, reason = '' AS passed, reason FROM r")
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").select(F.col("user_id").alias("qid"), (F.col("value") / 10000.0).alias("score"))
    return an.gate(e.filter("qid % 3 <> 0"), e.select("qid").distinct())


_SAY = ("Hello!", "hi there", "  Good   morning ... ", "thanks, now what about work?", "how are you?", "Who are you", "help", "help me with a form", "what's up —", "bye", "", "May I work?")
_SAYINGS = "say(i, s) AS (VALUES " + ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in enumerate(_SAY)) + ")"


@query("WITH " + _SAYINGS + ", x AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN s ELSE text END AS t FROM conversations JOIN say ON i = (conv_id + turn) % " + str(len(_SAY)) + ") SELECT conv_id, turn, CASE WHEN regexp_matches(t, '" + tx.GREETING.replace("'", "''") + "') THEN 'greeting' ELSE 'passthrough' END AS intent FROM x")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    say = F.array(*[F.lit(s) for s in _SAY])
    c = v.table(spark, d, "conversations").withColumn("t", F.when(F.col("conv_id") % 3 == 0, F.get(say, ((F.col("conv_id") + F.col("turn")) % len(_SAY)).cast("int"))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", tx.intent(F.col("t")).alias("intent"))


_RAW = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'sometime in 2019' WHEN 2 THEN ' 2015-02-03 ' WHEN 3 THEN '2031-01-01' WHEN 4 THEN '2019-13-45' ELSE '2019-0' || (1 + doc_id % 9) || '-1' || (doc_id % 10) END"


@query(f"WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents) SELECT doc_id, coalesce(CASE WHEN try_cast(trim(raw) AS DATE) IS NOT NULL THEN least(greatest(try_cast(trim(raw) AS DATE), DATE '2016-12-23'), DATE '2026-08-11') END::VARCHAR, '') AS as_of FROM r")
def asof_clamp(spark: SparkSession, d: str) -> DataFrame:
    r = v.table(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("raw"))
    return r.select("doc_id", F.coalesce(nm.clamped_date(F.col("raw"), dt.date(2016, 12, 23), dt.date(2026, 8, 11)).cast("string"), F.lit("")).alias("as_of"))


@query(f"WITH q AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN replace(substr(text, 1, 60), ' ', chr(10) || '  ') WHEN 1 THEN upper(substr(text, 1, 30)) ELSE ' ' END AS quote FROM documents) SELECT doc_id, {_WS.format('quote')} <> '' AND contains({_WS.format('text')}, {_WS.format('quote')}) AS held FROM q")
def quote_match(spark: SparkSession, d: str) -> DataFrame:
    q = v.table(spark, d, "documents").withColumn("quote", F.when(F.col("doc_id") % 3 == 0, F.replace(F.substring("text", 1, 60), F.lit(" "), F.lit("\n  "))).when(F.col("doc_id") % 3 == 1, F.upper(F.substring("text", 1, 30))).otherwise(" "))
    return q.select("doc_id", tx.quotes(F.col("text"), F.col("quote")).alias("held"))


_ANSWER = "SELECT conv_id, turn, text, CASE WHEN conv_id % 11 = 0 THEN 'low_confidence' ELSE '' END AS reason, conv_id % 13 = 0 AS refused, turn % 9 = 8 AS malformed, CASE WHEN conv_id % 5 = 1 THEN 'out_of_scope' WHEN conv_id % 5 = 2 THEN 'insufficient' ELSE 'answer' END AS kind, turn % 4 AS cited, (conv_id + turn) % 3 > 0 AS valid FROM conversations"


@query(f"WITH a AS ({_ANSWER}) SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{tx.GREETING.replace(chr(39), chr(39) * 2)}') THEN 'greeting' WHEN reason <> '' THEN reason WHEN refused THEN 'provider_refusal' WHEN malformed THEN 'malformed' WHEN kind = 'out_of_scope' THEN kind "
       "WHEN kind = 'insufficient' OR cited = 0 THEN 'insufficient_evidence' WHEN NOT valid THEN 'citation_failed' ELSE 'answered' END AS status FROM a")
def answer_status(spark: SparkSession, d: str) -> DataFrame:
    v.table(spark, d, "conversations").createOrReplaceTempView("chronolode_conversations")
    a = spark.sql(_ANSWER.replace("FROM conversations", "FROM chronolode_conversations"))
    return a.select("conv_id", "turn", an.status(*[F.col(c) for c in ("text", "reason", "refused", "malformed", "kind", "cited", "valid")]).alias("status"))


# Conversations.
@query(f"WITH {_TURNS}, {v.VERSIONS}, f AS (SELECT DISTINCT effective_from AS e FROM versions), p AS (SELECT *, lag(as_of) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM turns), "
       "m AS (SELECT conv_id, turn, coalesce(prev = as_of, false) AS continuation, CASE WHEN prev IS NULL OR prev = as_of THEN '' WHEN as_of < prev THEN 'earlier' ELSE 'later' END AS rupture, (SELECT count(*) FROM f WHERE e > least(prev, as_of) AND e < greatest(prev, as_of)) AS n FROM p) "
       "SELECT conv_id, turn, continuation, rupture, CASE WHEN rupture = '' THEN '' WHEN n = 0 THEN '· no amendments in between' ELSE '· ' || n || CASE WHEN n = 1 THEN ' amendment ' ELSE ' amendments ' END || rupture END AS label FROM m")
def transcript_rupture(spark: SparkSession, d: str) -> DataFrame:
    from chronolode.operators import temporal

    t = an.ruptures(turns(spark, d))
    t = temporal.amendments_between(t, v.versions(spark, d), "previous", "as_of")
    return t.select("conv_id", "turn", "continuation", "rupture", an.rupture_label(F.col("amendments"), F.col("rupture")).alias("label"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)")
def thread_latest(spark: SparkSession, d: str) -> DataFrame:
    return an.latest(v.table(spark, d, "conversations")).select("conv_id", "turn", "place")


@query("SELECT c.conv_id, coalesce(max(turn) FILTER (c.conv_id % 4 <> 0) + 1, 0) AS next FROM conversations c GROUP BY 1")
def next_turn(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "conversations")
    return an.next_turn(c.filter("conv_id % 4 <> 0"), c)


@query(f"WITH {_TURNS} SELECT conv_id, string_agg('[' || as_of || '] ' || role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM turns GROUP BY 1")
def prompt_history(spark: SparkSession, d: str) -> DataFrame:
    return an.history(turns(spark, d).withColumn("text", F.coalesce("text", F.lit(""))))


@query("WITH t AS (SELECT event_id, value, max(value) OVER (PARTITION BY event_type) AS top FROM events) SELECT event_id, CASE WHEN value / top >= 0.92 THEN 'strongest' WHEN value / top >= 0.75 THEN 'strong' WHEN value / top >= 0.45 THEN 'moderate' ELSE 'weak' END AS strength, "
       "(event_id % 130)::VARCHAR || CASE WHEN event_id % 130 % 100 BETWEEN 10 AND 20 THEN 'th' WHEN event_id % 130 % 10 = 1 THEN 'st' WHEN event_id % 130 % 10 = 2 THEN 'nd' WHEN event_id % 130 % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM t")
def strength_bucket(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    top = e.groupBy(F.col("event_type").alias("k")).agg(F.max("value").alias("top"))
    return e.join(top, F.col("event_type") == F.col("k")).select("event_id", tx.strength(F.col("value"), F.col("top")).alias("strength"), tx.ordinal(F.col("event_id") % 130).alias("ordinal"))


@query(f"{_CTE}, h AS (SELECT user_id AS qid, event_id % (SELECT count(*) + 500 FROM documents) AS id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS rank FROM events) SELECT qid, rank, h.id, citation_path, effective_from || ' → ' || coalesce(effective_to::VARCHAR, 'present') AS in_force, left(text, 400) AS snippet FROM h JOIN chunks c USING (id) JOIN versions USING (version_id)")
def hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Hits on ids of all documents and on 500 that are gone."""
    ids = v.table(spark, d, "documents").count() + 500
    h = v.table(spark, d, "events").select(F.col("user_id").alias("qid"), (F.col("event_id") % ids).alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    return an.hydrate(h, v.chunks(spark, d), v.versions(spark, d))


_CASES = "cases AS (SELECT doc_id AS c, lang AS cls, doc_id % 2 = 0 AS citations_valid, doc_id % 3 > 0 AS refusal_correct, doc_id % 5 > 0 AS temporal_correct, doc_id % 7 = 0 AS leaked, (n_chars % 500)::DOUBLE AS latency FROM documents)"


@query(f"WITH {_CASES}, p AS (SELECT *, citations_valid AND refusal_correct AND temporal_correct AND NOT leaked AS passed FROM cases), t AS (SELECT cls, passed, citations_valid, latency FROM p UNION ALL SELECT 'all', passed, citations_valid, latency FROM p) "
       "SELECT cls, count(*) AS n, avg(passed::INT) AS passed, avg(citations_valid::INT) AS citations_valid, list_sort(list(latency))[1 + count(*) // 2] AS median_latency FROM t GROUP BY 1")
def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "documents").select(F.col("lang").alias("cls"), (F.col("doc_id") % 2 == 0).alias("citations_valid"), (F.col("doc_id") % 3 > 0).alias("refusal"), (F.col("doc_id") % 5 > 0).alias("temporal"), (F.col("doc_id") % 7 == 0).alias("leaked"), (F.col("n_chars") % 500).cast("double").alias("latency"))
    c = c.withColumn("passed", ev.passed(F.col("citations_valid"), F.col("refusal"), F.col("temporal"), F.col("leaked")))
    return ev.rollup(c, "cls", ["passed", "citations_valid"], "latency")


_PFX = "starts_with(replace({0}, '8 CFR ', ''), replace({1}, '8 CFR ', '')) OR starts_with(replace({1}, '8 CFR ', ''), replace({0}, '8 CFR ', ''))"


@query(f"""WITH {v.VERSIONS}, k AS (SELECT version_id AS c, '8 CFR ' || section || '(' || version_id % 4 || ')' AS path, effective_from, effective_to, DATE '{v.EPOCH}' + (version_id % 3000 + 20)::INT AS as_of, section || '(1)' AS expected, section || '(2)(a)' AS forbidden FROM versions)
SELECT c AS "case", {_PFX.format('path', 'expected')} AS retrieved, effective_from <= as_of AND (effective_to IS NULL OR as_of < effective_to) AS temporal_ok, {_PFX.format('path', 'forbidden')} AS leaked FROM k""")
def eval_grade(spark: SparkSession, d: str) -> DataFrame:
    ver = v.versions(spark, d)
    k = ver.select(F.col("version_id").alias("case"), F.concat(F.lit("8 CFR "), "section", F.lit("("), F.col("version_id") % 4, F.lit(")")).alias("citation_path"), "effective_from", "effective_to", v._day("version_id % 3000 + 20").alias("as_of"), "section")
    cases = k.select("case", "as_of", F.array(F.concat("section", F.lit("(1)"))).alias("expected"), F.array(F.concat("section", F.lit("(2)(a)"))).alias("forbidden"))
    return an.grade(cases, k.select("case", F.lit(1).alias("rank"), "citation_path"), k.select("case", "citation_path", "effective_from", "effective_to"))


# Sections and markup.
def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item's text as the paragraphs of a section, in one snapshot a day."""
    b = v.table(spark, d, "benchmark")
    p = F.transform(F.split(tx.escaped(F.col("text")), r"\n"), lambda t, i: F.concat(F.lit("<P>("), F.chr(F.lit(97) + i % 26), F.lit(") "), t, F.lit("</P>")))
    xml = F.concat(F.lit('<DIV5><DIV8 TYPE="SECTION" N="'), F.col("item_id").cast("string"), F.lit('"><HEAD>Item</HEAD>'), F.array_join(p, ""), F.lit("</DIV8></DIV5>"))
    return b.select(v._day("item_id").alias("day"), xml.alias("xml"))


@query()
def parse_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.parse_snapshots(_snapshots(spark, d), "8 CFR")


@query()
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents packed into chunks."""
    p = v.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.concat(F.lit("("), i.cast("string"), F.lit(")")).alias("path"), t.alias("text"))), lambda x: x["text"] != "").alias("paragraphs"))
    return sections.pack_rows(p)


@query()
def word_diff(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns of a conversation."""
    c = v.table(spark, d, "conversations")
    old = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.withColumn("before", old).filter("before is not null").select("conv_id", "turn", tx.word_diff(F.col("before"), F.col("text")).alias("x"))
    return pairs.select("conv_id", "turn", "x.old", "x.new")


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;') AS escaped, '<strong>' || source || '</strong> [' || doc_id || ']' AS bold FROM documents")
def markup(spark: SparkSession, d: str) -> DataFrame:
    t = v.table(spark, d, "documents")
    return t.select("doc_id", tx.escaped(F.col("text")).alias("escaped"), tx.bold(F.concat(F.lit("**"), "source", F.lit("** ["), "doc_id", F.lit("]"))).alias("bold"))


# Traces.
@query("SELECT conv_id, turn, left(text, 400) AS snippet, to_json({'id': conv_id, 'rank': turn + 1}) AS candidate FROM conversations")
def trace_rows(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.substring("text", 1, an.SNIPPET).alias("snippet"), F.to_json(F.struct(F.col("conv_id").alias("id"), (F.col("turn") + 1).alias("rank"))).alias("candidate"))


@query("SELECT event_type AS outcome, count(*) AS n, count(*) FILTER (value < 10) AS le_10, count(*) FILTER (value < 50) AS le_50, count(*) FILTER (value < 100) AS le_100 FROM events GROUP BY 1")
def outcome_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("value") < b).alias(f"le_{b}") for b in (10, 50, 100)])


# Streams, run to their end over the events.
@query("SELECT min(event_id) AS id FROM events GROUP BY user_id % 10, event_type || ':' || (event_id % 50)")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("queue"), F.concat("event_type", F.lit(":"), F.col("event_id") % 50).alias("idempotency_key"))
    return streams.replay(spark, e, streams.first_of_key).select(F.col("event_id").alias("id"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.replay(spark, v.table(spark, d, "events"), streams.daily_counts)
