"""Operators on small cases."""

import datetime as dt
import json
import math
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from chronolode.functions import numbers as nm
from chronolode.functions import text as tx
from chronolode.functions import vectors as vf
from chronolode.operators import answers as an
from chronolode.operators import embedcache, fusion, jobs, lexical, sections, suite, temporal
from chronolode.operators import evaluation as ev
from chronolode.operators import vectors as vx
from chronolode.sources import feeds, store, traces
from chronolode.streaming import events as streams
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

D = dt.date


# Lexical.
CORPUS = [(101, "Optional practical training is available to F-1 students."), (102, "A 24-month STEM extension of optional practical training."), (103, "Unemployment during practical training."), (104, "See 214.2(f)(10)(ii)(C) for the extension."),
          (105, "The and of to."), (106, ""), (107, "padding " * 200 + "training"), (108, None)]


def bm25(docs, query, k, allowed=None):
    from unicodedata import normalize
    import re

    tok = lambda s: [t for t in re.findall(tx.TERM, normalize("NFKC", s or "").casefold()) if t not in tx.STOPWORDS]
    bags = {i: Counter(tok(t)) for i, t in docs}
    n, avg = len(docs), sum(sum(b.values()) for b in bags.values()) / len(docs)
    score = Counter()
    for term in tok(query):
        df = sum(term in b for b in bags.values())
        for i, b in bags.items():
            if term in b and (allowed is None or i in allowed):
                dl = sum(b.values())
                score[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * b[term] * 2.2 / (b[term] + 1.2 * (0.25 + 0.75 * dl / avg))
    return [i for i, _ in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


QUERIES = ["optional practical training", "unemployment", "214.2", "stem extension", "practical training extension unemployment", "f-1 student", "nothing known", "", "the of and", "training training extension"]


@pytest.mark.parametrize("allowed", [None, [102, 103, 107], []])
def test_bm25(spark, allowed):
    index = lexical.LexicalIndex.build(spark.createDataFrame(CORPUS, "id long, text string"))
    q = spark.createDataFrame(list(enumerate(QUERIES)), "qid long, query string")
    adm = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "id long")
    rows = index.search(q, 3, admissible=adm).orderBy("qid", "rank").collect()
    for i, text in enumerate(QUERIES):
        assert [r["id"] for r in rows if r["qid"] == i] == bm25(CORPUS, text, 3, allowed)


def test_lexical_files(spark, tmp_path):
    index = lexical.LexicalIndex.build(spark.createDataFrame(CORPUS, "id long, text string"))
    store.save_lexical(index, str(tmp_path / "i"), buckets=3)
    again = store.load_lexical(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(0, QUERIES[0])], "qid long, query string")
    assert again.search(q).collect() == index.search(q).collect()
    spark.createDataFrame([(json.dumps({"kind": "lexical", "version": 99}),)], "value string").write.mode("overwrite").text(str(tmp_path / "i/meta"))
    with pytest.raises(store.FormatError):
        store.load_lexical(spark, str(tmp_path / "i"))


def test_tokens_exact(spark):
    texts = ["Straße ﬁne Ⅷ Ｆｕｌｌ H-1B 8 CFR 214.2(f)", None, "I-20 and K"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(tx.tokens_exact("t").alias("w")).first()["w"] == ["strasse", "fine", "viii", "full", "h-1b", "8", "cfr", "214.2", "f"]
    assert [r["w"] for r in df.select(tx.tokens(F.col("t")).alias("w")).collect()][2] == ["i-20", "k"]


# Fusion.
@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(1, 20), max_size=8), min_size=1, max_size=3))
def test_fusion_equals_sums(spark, lists):
    rows = [(0, f"l{i}", x, r) for i, ids in enumerate(lists) for r, x in enumerate(ids, 1)]
    best = {}
    for _, name, x, r in rows:
        best[(name, x)] = min(r, best.get((name, x), r))
    score = Counter()
    for (_, x), r in best.items():
        score[x] += 1 / (60 + r)
    expected = sorted(((x, math.floor(s * 1e12) / 1e12) for x, s in score.items()), key=lambda t: (-t[1], t[0]))
    got = fusion.fuse(spark.createDataFrame(rows, "qid long, list string, id long, rank int")).orderBy("rank").collect()
    assert [r["id"] for r in got] == [x for x, _ in expected]
    assert all(abs(r["score"] - s) < 1e-11 and all(best[(k, r["id"])] == v for k, v in r["ranks"].items()) for r, (_, s) in zip(got, expected, strict=True))


# Vectors.
def clustered(n=12, per=25, dim=16, seed=0):
    r = np.random.default_rng(seed)
    c = r.standard_normal((n, dim))
    x = np.repeat(c, per, axis=0) + 0.1 * r.standard_normal((n * per, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, x, q):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")


def truth(x, q, k, allowed=None):
    out = []
    for i, v in enumerate(q):
        d = np.round(1 - x @ v, 12)
        ids = sorted((j for j in range(len(x)) if allowed is None or j in allowed), key=lambda j: (d[j], j))[:k]
        out += [(i, j, r) for r, j in enumerate(ids, 1)]
    return out


@pytest.mark.parametrize("allowed", [None, set(range(0, 300, 37)), set()])
def test_exact_index(spark, allowed):
    x = clustered()
    x[150] = x[10]
    q = np.concatenate([x[[10, 40]], clustered(seed=3)[:3]])
    rows, queries = frames(spark, x, q)
    adm = None if allowed is None else spark.createDataFrame([(i,) for i in sorted(allowed)], "id long")
    got = [(r["qid"], r["id"], r["rank"]) for r in vx.ExactIndex(rows).search(queries, 10, admissible=adm).orderBy("qid", "rank").collect()]
    assert got == truth(x, q, 10, allowed)
    assert vx.ExactIndex(rows).search(queries, 0).count() == 0


@pytest.mark.parametrize("kind", ["cells", "graph"])
def test_approximate_indexes(spark, kind, tmp_path):
    x, q = clustered(), clustered(seed=0)[::29]
    rows, queries = frames(spark, x, q)
    index = vx.INDEXES[kind](rows)
    exact = set(truth(x, q, 10))
    got = {(r["qid"], r["id"], r["rank"]) for r in index.search(queries, 10).collect()}
    ids = lambda s: {(a, b) for a, b, _ in s}
    assert len(ids(got) & ids(exact)) >= 0.85 * len(exact)
    allowed = set(range(0, 300, 23))
    adm = spark.createDataFrame([(i,) for i in sorted(allowed)], "id long")
    hits = index.search(queries, 10, admissible=adm).collect()
    assert {r["id"] for r in hits} <= allowed
    assert Counter(r["qid"] for r in hits) == Counter({i: 10 for i in range(len(q))})
    save, load = (store.save_cells, store.load_cells) if kind == "cells" else (store.save_graphs, store.load_graphs)
    save(index, str(tmp_path / "x"))
    again = {(r["qid"], r["id"], r["rank"]) for r in load(spark, str(tmp_path / "x")).search(queries, 10).collect()}
    assert again == got
    if kind == "cells":
        n = len(index.centroids)
        full = {(r["qid"], r["id"], r["rank"]) for r in index.search(queries, 10, effort=n).collect()}
        assert full == exact


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 2.0, 2.0])], "a array<double>, z array<double>, v array<double>")
    x = r.select(vf.normalised(F.col("a")), vf.normalised(F.col("z")), vf.truncated(F.col("v"), 2), vf.cosine_distance(F.col("a"), F.col("a")), vf.from_blob(vf.to_blob("a"))).first()
    assert x[0] == pytest.approx([0.6, 0.8]) and x[1] == [0, 0] and x[2] == pytest.approx([0.4472136, 0.8944272]) and x[3] == -24 and x[4] == [3, 4]


# Temporal.
VERSION = "version_id long, document_id string, section string, effective_from date, effective_to date, recorded_at date, superseded_at date, removed boolean"
STORE = [(1, "8", "214.2", D(2017, 1, 18), D(2020, 10, 2), D(2017, 1, 18), None, False), (2, "8", "214.2", D(2020, 10, 2), None, D(2020, 10, 2), None, False),
         (3, "8", "214.1", D(2017, 1, 18), None, D(2017, 1, 18), D(2018, 12, 22), False), (4, "8", "214.1", D(2017, 1, 18), None, D(2018, 12, 22), None, False), (5, "8", "214.9", D(2019, 1, 1), None, D(2019, 1, 1), None, True)]


@pytest.mark.parametrize("day,known,ids", [(D(2018, 1, 1), None, [1, 4]), (D(2020, 10, 1), None, [1, 4]), (D(2020, 10, 2), None, [2, 4]), (D(2018, 1, 1), D(2018, 6, 1), [1, 3]), (D(2018, 1, 1), D(2018, 12, 22), [1, 4]), (D(2016, 1, 1), None, []), (D(2018, 1, 1), D(2016, 1, 1), [])])
def test_as_of(spark, day, known, ids):
    v = spark.createDataFrame(STORE, VERSION)
    assert sorted(r["version_id"] for r in v.filter(temporal.as_of(day, known, "8")).collect()) == ids


def test_timeline_and_overlaps(spark):
    rows = [(0, "214.11", D(2020, 10, 2), D(2021, 1, 1), False), (1, "214.11", D(2020, 10, 2), D(2020, 9, 1), False), (2, "214.11", D(2020, 10, 2), D(2020, 9, 1), True), (3, "214.11", D(2021, 5, 1), D(2021, 5, 1), True), (4, "214.16", D(2019, 5, 10), D(2019, 5, 10), True)]
    tl = temporal.timeline(spark.createDataFrame(rows, "record_id long, section string, effective_from date, issue_date date, removed boolean"))
    assert sorted((r["record_id"], r["effective_to"]) for r in tl.collect()) == [(1, D(2021, 5, 1)), (3, None), (4, None)]
    o = spark.createDataFrame([(1, "a", D(2020, 1, 1), None, None), (2, "a", D(2020, 2, 1), D(2020, 3, 1), None), (3, "a", D(2020, 5, 1), None, None), (4, "b", D(2020, 1, 1), D(2020, 2, 1), None), (5, "b", D(2020, 2, 1), None, None), (6, "b", D(2020, 1, 5), None, D(2021, 1, 1))],
                              "version_id long, section string, effective_from date, effective_to date, superseded_at date")
    assert sorted((r["a"], r["b"]) for r in temporal.overlaps(o).collect()) == [(1, 2), (1, 3)]
    assert temporal.overlaps(o.limit(0)).count() == 0 and temporal.overlaps(o.filter("version_id = 1")).count() == 0


# Sections.
@pytest.mark.parametrize("texts,expected", [
    (["(a) one", "(1) x", "(2) y", "(i) r", "(ii) s", "(A) t", "(1) u", "(2) v", "(3) w", "(B) z", "(b) two"], ["a", "a1", "a2", "a2i", "a2ii", "a2iiA", "a2iiA1", "a2iiA2", "a2iiA3", "a2iiB", "b"]),
    (["(a) x", "(b) x", "(1) y", "(i) one", "(c) x", "(d) x"], ["a", "b", "b1", "b1i", "c", "d"]),
    (["(a)(1)(i) deep", "plain", "(ii) Optional training—(A) General."], ["a1i", "a1i", "a1iiA"]),
])
def test_paths(texts, expected):
    assert ["".join(p) for p in sections.paths(texts)] == expected


def test_roman_and_pack():
    assert [sections.roman(x) for x in ("i", "iv", "IX", "xl", "mcmxciv", "b", "")] == [1, 4, 9, 40, 1994, None, None]
    packed = sections.pack([("p1", "a" * 500), ("p2", "b" * 500), ("p3", "c" * 10), ("p4", "d" * 1900), ("p5", "e")])
    assert [(o, p, len(t)) for o, p, t in packed] == [(0, "p1", 1001), (1, "p3", 10), (2, "p4", 1900), (3, "p5", 1)]
    assert sections.pack([]) == []


XML = """<DIV5><DIV8 TYPE="SECTION" N=" 214.2 "><HEAD>§ 214.2 Special</HEAD><P>(a) <I>General</I>.
 Text</P><P> </P><EXTRACT><P>(1) Sub &amp; more</P></EXTRACT></DIV8><DIV8 TYPE="SECTION" N=""><P>x</P></DIV8><DIV8 TYPE="OTHER" N="1"><P>x</P></DIV8></DIV5>"""


def test_feeds_and_ingest(spark, tmp_path):
    (tmp_path / "x").mkdir()
    cache = feeds.SnapshotCache(str(tmp_path / "x"), fetch=lambda url: calls.append(url) or XML.encode(), interval=0.01)
    calls: list = []
    assert cache.get("u", 8, 214, "2020-01-01") == cache.get("u", 8, 214, "2020-01-01") == XML.encode() and calls == ["u"]
    cache.get("v", 8, 214, "2015-01-01")
    parsed = sections.parse_snapshots(feeds.snapshots(spark, str(tmp_path / "x")), "8 CFR")
    assert {(r["day"], r["citation_path"], r["text"]) for r in parsed.collect()} == {(d, "8 CFR 214.2(a)", "(a) General. Text (1) Sub & more") for d in (D(2020, 1, 1), D(2015, 1, 1))}
    (tmp_path / "f.json").write_text(json.dumps({"content_versions": [{"identifier": "214.2", "date": "2017-01-18", "issue_date": "2017-01-18", "removed": False, "substantive": True, "name": "n"}, {"identifier": "214.2", "date": "2017-01-18", "issue_date": "2018-01-18"}]}))
    intervals = temporal.timeline(feeds.version_feed(spark, str(tmp_path / "f.json")))
    versions, chunks = store.Table(spark, str(tmp_path / "v"), store.VERSIONS), store.Table(spark, str(tmp_path / "c"), store.CHUNKS)
    first = store.ingest_snapshots(parsed, intervals, versions, chunks, "8")
    assert first == {"skipped": 1, "existing": 0, "created": 1}
    assert store.ingest_snapshots(parsed, intervals, versions, chunks, "8") == {"skipped": 1, "existing": 1, "created": 0}
    assert versions.read().count() == chunks.read().count() == 1
    c = chunks.read().first()
    assert (c["char_count"], c["token_count"]) == (32, 7)


def test_table_upsert(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "s"), store.SOURCES)
    t.upsert(spark.createDataFrame([("a", "one"), ("b", "two")], store.SOURCES), ["source_id"])
    t.upsert(spark.createDataFrame([("a", "new")], store.SOURCES), ["source_id"])
    assert sorted(map(tuple, t.read().collect())) == [("a", "new"), ("b", "two")]
    assert store.as_markdown(t.read().orderBy("name")) == "| source_id | name |\n| --- | --- |\n| a | new |\n| b | two |"


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([(1, "same text"), (2, "same text")], "id long, text string")
    none = spark.createDataFrame([], "sha string, model_id string, vector array<float>")
    p = embedcache.HashingProvider(8)
    new = embedcache.embed_missing(chunks, none, p)
    assert new.count() == 1 and embedcache.embed_missing(chunks, new, p).count() == 0
    assert embedcache.corpus_vectors(chunks, new, p.model_id).count() == 2
    assert tuple(embedcache.dedup_stats(chunks).first()) == (2, 1, 2.0) and tuple(embedcache.dedup_stats(chunks.limit(0)).first()) == (0, 0, 0.0)


# Queue.
JOB = "id long, queue string, kind string, payload string, state string, priority int, attempts int, max_attempts int, lease_epoch int, claimed_by string, available_at timestamp, idempotency_key string, finished_at timestamp, last_error string"
T0 = dt.datetime(2024, 1, 1)


def one_job(spark, **kw):
    row = {"id": 1, "queue": "q", "kind": "k", "payload": "{}", "state": "pending", "priority": 0, "attempts": 0, "max_attempts": 2, "lease_epoch": 0, "claimed_by": None, "available_at": T0, "idempotency_key": None, "finished_at": None, "last_error": None}
    return spark.createDataFrame([tuple((row | kw)[c.split()[0]] for c in JOB.split(", "))], JOB)


def test_job_life(spark):
    now = F.lit(T0)
    later = F.lit(T0 + dt.timedelta(minutes=5))
    t = jobs.claim(one_job(spark), "q", "w1", now)
    assert jobs.claimable(t, "q", now).count() == 0 and jobs.claimable(t, "q", later).count() == 1
    again = jobs.claim(t, "q", "w2", later)
    stale = spark.createDataFrame([(1, 1)], "id long, lease_epoch int")
    assert jobs.ack(again, stale, later).first()["state"] == "running"  # the first worker lost its lease
    fresh = spark.createDataFrame([(1, 2)], "id long, lease_epoch int")
    assert jobs.ack(again, fresh, later).first()["state"] == "succeeded"
    dead = jobs.nack(again, fresh.withColumn("error", F.lit("e" * 5000)), later).first()
    assert dead["state"] == "dead" and len(dead["last_error"]) == 4000
    much = F.lit(T0 + dt.timedelta(hours=1))
    assert jobs.reap(again, "q", much).first()["last_error"] == jobs.EXPIRED
    assert jobs.requeue_dead(jobs.reap(again, "q", much), "q", much).first()["state"] == "pending"


def test_enqueue(spark):
    held = one_job(spark, idempotency_key="a")
    new = one_job(spark, id=2, idempotency_key="a").unionByName(one_job(spark, id=3, idempotency_key="b")).unionByName(one_job(spark, id=4, idempotency_key="b")).unionByName(one_job(spark, id=5)).unionByName(one_job(spark, id=6))
    assert sorted(r["id"] for r in jobs.enqueue(held, new).collect()) == [3, 5, 6]


class State:
    """What applyInPandasWithState hands to a step."""

    exists, hasTimedOut, get, timeout = False, False, None, None

    def update(self, value):
        self.exists, self.get, self.timeout = True, value, None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_stream_leases():
    state, step = State(), streams.lease_step(1000)
    run = lambda *ops: next(step((1,), iter([pd.DataFrame({"op": ops})]), state))["state"][0]
    assert run("ack") == "pending" and run("claim") == "running" and state.timeout == 1000
    assert run("claim", "heartbeat") == "running" and state.get == (1, "running")
    state.hasTimedOut = True
    assert run() == "pending" and state.timeout is None
    state.hasTimedOut = False
    assert run("claim", "nack", "claim", "ack") == "succeeded" and state.get == (3, "succeeded")


def test_first_of_key_in_any_order(spark, tmp_path):
    """Rows come in several files, latest first, over a year; some have no kind."""
    from chronolode.plans import services

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), i % 7, None if i % 11 == 0 else "ab"[i % 2], "{}") for i in range(9_000, 0, -1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").repartitionByRange(6, F.desc("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for i, ts, user, kind, _ in rows:
        key = user % 10, kind and f"{kind}:{i % 50}"
        want[key] = min(want.get(key, (i, ts)), (i, ts))
    assert sorted(r["id"] for r in services.stream_dedupe(spark, str(tmp_path)).collect()) == sorted(i for i, _ in want.values())
    jobs = spark.read.parquet(str(tmp_path / "events.parquet")).withColumn("queue", F.col("user_id") % 10).withColumn("idempotency_key", F.concat("event_type", F.lit(":"), F.col("event_id") % 50))
    got = streams.replay(spark, jobs, streams.first_of_key)
    assert sorted(got.columns) == sorted(jobs.columns)
    assert {(r["queue"], r["idempotency_key"]): (r["event_id"], r["ts"]) for r in got.collect()} == want
    assert streams.replay(spark, jobs.filter("event_id < 0"), streams.first_of_key).count() == 0


# Prices and answers.
def test_price_boundaries(spark):
    rates = spark.createDataFrame([("m", "2.00", "10.00", D(2026, 1, 1), D(2026, 9, 1)), ("m", "3.00", "15.00", D(2026, 9, 1), None)], "model string, input_rate string, output_rate string, effective_from date, effective_to date")
    use = lambda day, n=1_000_000: spark.createDataFrame([("m", day, n, 0, 0, 0)], "model string, day date, fresh long, cache_write long, cache_read long, output long")
    assert an.priced(use(D(2026, 8, 31)), rates).first()["cost"] == Decimal("2.000000") and an.priced(use(D(2026, 9, 1)), rates).first()["cost"] == Decimal("3.000000")
    with pytest.raises(Exception, match="no rate for m"):
        an.priced(use(D(2020, 1, 1)), rates).collect()
    assert an.priced(use(D(2020, 1, 1)), rates, strict=False).first()["cost"] is None


def test_validate(spark):
    refs = spark.createDataFrame([(1, 0, 10, "word for  word"), (1, 1, 10, "other"), (1, 2, 11, "Word for word"), (1, 3, 12, " "), (1, 4, 99, "x"), (1, 5, 13, "x"), (1, 6, 14, "text")], "answer long, pos int, id long, quote string")
    shown = spark.createDataFrame([(1, i, "x word\n for word y text") for i in (10, 11, 12, 14)], "answer long, id long, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = {r["id"]: r["check"] for r in an.validate(refs, shown, ids(10, 11, 12, 13), ids(10, 11, 12, 13, 14)).collect()}
    assert got == {10: "ok", 11: "quote", 12: "quote", 99: "exists", 13: "retrieved", 14: "admissible"}


@pytest.mark.parametrize("say,kind", [("hi", "greeting"), ("Good morning!!", "greeting"), ("thanks, now what about work?", "passthrough"), ("how is it going?", "greeting"), ("help me", "passthrough"), ("", "passthrough"), ("WHO ARE YOU", "greeting")])
def test_intent(spark, say, kind):
    assert spark.createDataFrame([(say,)], "t string").select(tx.intent(F.col("t"))).first()[0] == kind


def test_markup(spark):
    df = spark.createDataFrame([("see [7] and [8] <b>", "the quick  brown fox jumps", [7, 9])], "t string, x string, c array<long>")
    assert df.select(tx.citation_chips("t", "c")).first()[0] == 'see <a class="chip" href="#cite-1">1</a> and [8] &lt;b&gt;'
    assert df.select(tx.highlighted("x", F.lit("quick brown fox jumps"))).first()[0] == "the <mark>quick  brown fox jumps</mark>"
    assert df.select(tx.highlighted("x", F.lit("brown fox"))).first()[0] == "the quick  brown fox jumps"
    odd = spark.createDataFrame([(r"a \E$1 (b c d a \E$1 (b c", "[3][03][99999999999999999999][3", None)], "x string, t string, q string")
    assert odd.select(tx.highlighted("x", F.lit("\\E$1  (b\nc d"))).first()[0] == r"a <mark>\E$1 (b c d</mark> a \E$1 (b c"
    assert odd.select(tx.highlighted("x", "q")).first()[0] == r"a \E$1 (b c d a \E$1 (b c"
    link = '<a class="chip" href="#cite-2">2</a>'
    assert odd.select(tx.citation_chips("t", F.array(F.lit(8), F.lit(3), F.lit(3)))).first()[0] == link * 2 + "[99999999999999999999][3"
    assert odd.select(tx.citation_chips("t", F.lit(None).cast("array<int>"))).first()[0] == "[3][03][99999999999999999999][3"
    assert tuple(spark.createDataFrame([("a b c", "a x c")], "o string, n string").select(tx.word_diff("o", "n").alias("d")).first()["d"]) == ("a <del>b</del> c", "a <ins>x</ins> c")


def test_numbers(spark):
    row = spark.range(1).select(nm.required_overfetch(F.lit(0.0)), nm.required_overfetch(F.lit(0.4)), nm.required_overfetch(F.lit(1.0)), nm.required_overfetch(F.lit(0.0191)), nm.backoff(F.lit(40), 1.0, 30.0, F.lit(0.5)), nm.backoff(F.lit(3), 1.0, 30.0, F.lit(1.0)), tx.varint_bytes(F.lit(0)), tx.varint_bytes(F.lit(127)), tx.varint_bytes(F.lit(128))).first()
    assert tuple(row) == (512, 2, 1, 52, 15.0, 4.0, 1, 1, 2)


def test_percentiles_and_rollup(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 101 + ["b"], "v": [float(i) for i in range(101)] + [7.0]}))
    got = {r["k"]: (r["p50"], r["p95"], r["p99"], r["n"]) for r in ev.percentiles(df, ["k"], "v").collect()}
    assert got == {"a": (50.0, 95.0, 99.0, 101), "b": (7.0, 7.0, 7.0, 1)}


def test_drain(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "jobs"), JOB)
    t.append(one_job(spark).unionByName(one_job(spark, id=2, kind="other")).unionByName(one_job(spark, id=3)))
    failing = lambda df: df.filter("id = 3").select("id", F.lit("boom").alias("error"))
    assert jobs.drain(t, "q", {"k": failing}, now=lambda: F.lit(T0)) == {"processed": 1, "failed": 2}
    rows = {r["id"]: r for r in t.read().collect()}
    assert rows[1]["state"] == "succeeded" and rows[2]["state"] == rows[3]["state"] == "pending" and rows[2]["last_error"] == "no handler for other"
    late = lambda: F.lit(T0 + dt.timedelta(hours=1))
    assert jobs.drain(t, "q", {"k": failing}, now=late) == {"processed": 0, "failed": 2}
    assert [r["state"] for r in t.read().filter("id > 1").collect()] == ["dead", "dead"]


def test_traces(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), store.TRACES)
    turn = spark.createDataFrame([(1, 5, 0, "q", "q", D(2020, 1, 1), True, [7], "r"), (2, 5, 1, "q", "other", D(2020, 1, 1), False, [], "r")], "id long, conversation_id long, turn int, query string, resolved_query string, as_of date, answered boolean, cited array<long>, run_id string")
    cand = spark.createDataFrame([(1, 2, 8, "b", "y" * 900, 0.1), (1, 1, 7, "a", "x", 0.2)], "id long, rank int, chunk long, citation_path string, text string, score double")
    traces.persist(t, turn, cand)
    r = traces.read(t, 1).first()
    found = json.loads(r["candidates"])
    assert [c["id"] for c in found] == [7, 8] and len(found[1]["snippet"]) == 400 and r["resolved_query"] is None
    assert traces.read(t, 2).first()["resolved_query"] == "other"


def test_suite(spark):
    rows, q = suite.split(suite.random_units(spark, 400, 8, 1).persist(), 20)
    assert q.count() == 20 and rows.count() == 380
    got = {(r["index"], r["effort"]): r["recall"] for r in suite.run_suite(rows, q, {"exact": vx.ExactIndex, "cells": lambda x: vx.CellIndex(x, n_lists=10)}, {"cells": (1, 10)}).collect()}
    assert got[("exact", None)] == got[("cells", 10)] == 1.0 > got[("cells", 1)] > 0.2
    assert suite.memory_bytes(10, 4, 2) == 10 * 24 + 2 * 24


def test_beam_of_a_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vx._Graph(np.arange(600), x, 8, 64, 1)
    for admit in (None, np.arange(600) % 7 == 0, np.zeros(600, bool)):
        right = 0
        for q in x[:40]:
            d = 1.0 - x @ q
            own = np.arange(600) if admit is None else np.flatnonzero(admit)
            want = own[np.argsort(d[own], kind="stable")][:10]
            found, visits = g.search(q, 10, 64, admit, 1 << 60)
            assert [a for a, _ in found] == sorted(a for a, _ in found) and visits <= 600
            assert all(abs(a - d[n]) < 1e-12 and (admit is None or admit[n]) for a, n in found)
            right += len(set(want.tolist()) & {n for _, n in found})
        assert right >= 0.95 * 40 * min(10, len(own))
    found, visits = g.search(x[0], 10, 64, None, 20)
    assert visits < 20 + 2 * 8 + 1


def test_graph_under_narrow_and_wide_filters():
    """Few admissible nodes cost as many measurements, not a walk over all; equal vectors stay within reach."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[300:600] = x[300]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vx._Graph(np.arange(900), x, 8, 64, 1)
    few = np.arange(900) % 45 == 0
    for q in x[::90]:
        d = np.round(1.0 - x @ q, 12)
        found, visits = g.search(q, 10, 64, few, 1 << 60)
        own = np.flatnonzero(few)
        assert visits == few.sum() and [n for _, n in found] == own[np.lexsort((own, d[own]))][:10].tolist()
        assert len(g.beam(q, [g.entry], 900, 0)[0]) == 900
    assert max(len(v) for v in np.split(g.layers[0][2], g.layers[0][1][1:-1])) < 64
    half, right = np.arange(900) % 2 == 0, 0
    for q in x[::9]:
        found, visits = g.search(q, 10, 64, half, 1 << 60)
        far = np.sort(np.round(1.0 - x[half] @ q, 12))[9]
        right += sum(a <= far + 1e-9 for a, _ in found)
        assert all(half[n] for _, n in found) and visits <= 900
    assert right >= 950


def test_graph_of_few_or_equal_vectors():
    for x in (np.ones((1, 1)), np.ones((2, 1)), np.ones((300, 1))):
        g = vx._Graph(np.arange(len(x)), x, 4, 16, 0)
        assert len(g.search(x[0], 10, 16, None, 1 << 60)[0]) == min(10, len(x))
        assert len(g.beam(x[0], [g.entry], len(x), 0)[0]) == len(x)
