import random
import sys
import zlib
from collections import Counter

import numpy as np
from chronolode.llm import langid as li
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, score string, rejected int"


def corpus(n=300, seed=2):
    r = random.Random(seed)
    parts = {"aa": ["th", "er", "on", "an", "re", "he"], "bb": ["sch", "ung", "ein", "ü", "ich"], "cc": ["ción", "ñ", "os", "las", "í"]}
    rows = []
    for i in range(n):
        lang = r.choice(sorted(parts))
        rows.append((i, " ".join("".join(r.choices(parts[lang], k=r.randint(1, 4))) for _ in range(r.randint(3, 60))).capitalize() + ".", lang, "s", 1))
    return rows


def test_accuracy_on_held_out(spark):
    d = spark.createDataFrame([*corpus(), (None, "erheth", None, "x", 1), (5000, None, "aa", "x", 1)], DOC)
    got = li.identify(d, li.fit(d)).withColumn("held", li.held_out(F.col("doc_id")))
    rows = [r for r in got.collect() if r["held"] and r["text"]]
    assert len(rows) > 30 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges_and_rejection(spark):
    d = spark.createDataFrame(corpus(), DOC)
    model = li.fit(d)
    odd = [(1, None), (2, ""), (None, "123 !? 😀"), (3, "a"), (4, "ее привет как дела " * 20), (5, "thereon " * 20_000), (5, "thereon " * 20_000), (6, "İstanbul ŞŞ ß")]
    rows = {(r["doc_id"], r["text"]): r for r in li.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [rows[k]["lang_pred"] for k in odd[:3]] == ["und"] * 3 and rows[odd[0]]["score"] == 0
    assert rows[odd[3]]["lang_pred"] in ("aa", "bb", "cc") and rows[odd[4]]["rejected"] and not rows[odd[5]]["rejected"] and rows[odd[5]]["lang_pred"] == "aa"
    assert li.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_nothing_to_learn(spark):
    for rows in ([], [(1, "text", None, None, None)]):
        d = spark.createDataFrame(rows, DOC)
        assert [r["lang_pred"] for r in li.identify(d, li.fit(d)).collect()] == ["und"] * len(rows)


def brute(texts):
    """Interpolated Kneser-Ney by dictionaries: a function of (context, character)."""
    grams = Counter()
    for t in texts:
        x = "".join(map(chr, li.normalised(t)))
        grams.update(x[i : i + li.ORDER] for i in range(len(x) - li.ORDER + 1))
    levels = {li.ORDER: grams}
    for k in range(li.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount = {}
    for k, c in levels.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = min(0.95, max(0.1, one / max(one + 2 * two, 1)))

    def p(context, character):
        k = len(context) + 1
        below = p(context[1:], character) if context else 1 / (len(levels[1]) + 1)
        after = [v for g, v in levels[k].items() if g[:-1] == context]
        if not after:
            return below
        return max(levels[k].get(context + character, 0) - discount[k], 0) / sum(after) + discount[k] * len(after) / sum(after) * below

    return p


GRAMS = ["   t", "ther", "eren", "nher", "xxxx", "theз", "зher", "q re", "is a", "   ñ"]


def test_equals_brute_force_in_one_shard_and_in_many(spark):
    rows = [*corpus(40), (999, "ü\U00020000 the", "aa", "s", 1)]
    d = spark.createDataFrame(rows, DOC)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    grams = np.array([[*map(ord, g)] for g in GRAMS], np.uint32)
    want = {k: brute([r[1] for r in learned if r[2] == k]) for k in ("aa", "bb", "cc")}
    want = np.array([[np.log(p(g[:-1], g[-1])) for g in GRAMS] for p in want.values()])
    whole, cut = li.fit(d), li.fit(d, shard_entries=500)
    assert whole.shards == 1 and cut.shards > 3 and whole.languages == cut.languages == ["aa", "bb", "cc"]
    assert np.allclose(whole.shard(0).gram_logs(grams), want, atol=1e-5)
    assert np.allclose(sum(cut.shard(i).gram_logs(grams) for i in range(cut.shards)), want, atol=1e-5)
    texts = d.select("doc_id", "text")
    a, b = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 6), r["rejected"]) for r in li.identify(texts, m).collect()} for m in (whole, cut))
    assert a == b


def test_calibration_is_of_documents_that_the_trial_model_did_not_count(spark):
    rows = corpus(60)
    model = li.fit(spark.createDataFrame(rows, DOC))
    fold = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == li.CALIBRATION_FOLD and r[2] == "bb"]
    p = brute([r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 > 1 and r[2] == "bb"])
    each = []
    for r in fold:
        x = "".join(map(chr, li.normalised(r[1])))
        logs = [np.log(p(x[i : i + 3], x[i + 3])) for i in range(len(x) - 3)]
        each.append((-np.mean(logs), len(logs)))
    ce, n = map(np.array, zip(*each, strict=True))
    middle = np.median(ce)
    assert np.allclose(model.limit[1], (middle, np.quantile((ce - middle) * np.sqrt(n), li.CALIBRATION)), atol=1e-4)


def test_calibration_takes_every_document_of_its_fold(spark):
    """However many there are; limits and sharpness are those that numpy finds over all of them."""
    rows = [(i, t, lang if i % 100 < 2 else "aa", s, n) for i, t, lang, s, n in corpus(3_600)]
    d = spark.createDataFrame(rows, DOC).repartition(5)
    model = li.fit(d)
    table, floor = li.kneser_ney(li._count(d, "doc_id", "lang", "text"))
    trial = li._model(table, floor[1], 1, li.SHARD)
    fold = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == li.CALIBRATION_FOLD]
    sums, n = trial.shard(0).sums([li.normalised(r[1]) for r in fold])
    entropy, own = sums / n[:, None], np.array([trial.languages.index(r[2]) for r in fold])
    assert (own == 0).sum() > 600
    for k in range(3):
        x = entropy[own == k, k]
        middle = np.median(x)
        assert np.allclose(model.limit[k], (middle, np.quantile((x - middle) * np.sqrt(n[own == k]), li.CALIBRATION)), atol=1e-12)
    ahead = (entropy - entropy[np.arange(len(fold)), own][:, None]) * np.sqrt(n)[:, None]
    grid = 2.0 ** np.linspace(-3, 6, 37)
    loss = np.array([np.logaddexp.reduce(-b * ahead, axis=1).mean() for b in grid])
    assert model.sharpness == grid[np.flatnonzero(loss <= loss.min() + 1e-3)[0]]


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(1)
    groups = {0: r.normal(size=2_001), 1: np.repeat([2.5, -1.0], [700, 3]), 2: np.array([7.0]), 3: np.append(r.random(500) * 1e-9, [1e6, -1e6]), 4: np.array([1.0, 2.0])}
    d = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k int, x double").repartition(4)
    for p in (0.5, 0.99):
        got = li.quantiles(d, p)
        assert got.keys() == groups.keys() and all(np.isclose(got[k], np.quantile(v, p), rtol=1e-12, atol=0) for k, v in groups.items())
    assert li.quantiles(d.filter("k > 9"), 0.5) == {}


def test_probabilities_sum_to_one(spark):
    """Over all characters after a context, the unseen one included."""
    model = li.fit(spark.createDataFrame(corpus(80), DOC)).shard(0)
    texts = [(r[0], li.normalised(r[1])) for r in corpus(80) if r[2] == "aa"]
    alphabet = np.unique(np.concatenate([t for i, t in texts if zlib.crc32(str(i).encode()) % 5]))
    for context in ([32, 32, 32], [ord("t"), ord("h"), ord("e")], [ord("z"), ord("z"), ord("z")]):
        grams = np.array([[*context, c] for c in [*alphabet, 0x4E00]], np.uint32)
        assert abs(np.exp(model.gram_logs(grams)[0]).sum() - 1) < 1e-3


def test_small_language_beside_a_large_one(spark):
    """However many grams another language has, they take nothing away from a language's own."""
    r = random.Random(4)
    small = [(i, t, lang, s, n) for i, t, lang, s, n in corpus(60) if lang == "aa"]
    counted = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 > 1][:6]
    large = [(i, "".join(map(chr, r.choices(range(0x4E00, 0x9F00), k=8_000))), "zz", "s", 1) for i in counted]
    alone, both = li.fit(spark.createDataFrame(small, DOC)), li.fit(spark.createDataFrame(small + large, DOC).repartition(8))
    assert both.languages == ["aa", "zz"] and len(both.shard(0).value.keys) > 45_000
    grams = np.array([[*map(ord, g)] for g in GRAMS], np.uint32)
    assert np.array_equal(alone.shard(0).gram_logs(grams)[0], both.shard(0).gram_logs(grams)[0])


def test_text_of_all_letters(spark):
    """More different letters than fit a packed window are counted and scored like any."""
    letters = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isalpha()]
    text = "".join(letters) + "abab"
    rows = [*corpus(30), *[(i, text, "all", "s", 1) for i in (1, 2, 4)]]
    d = spark.createDataFrame(rows, DOC)
    got = li.identify(spark.createDataFrame([(1, text), (2, "therhe an on")], "doc_id long, text string"), li.fit(d)).collect()
    assert [r["lang_pred"] for r in got] == ["all", "aa"]
    cp = li.normalised(text)
    grams, inverse = li._window_ids(cp, 4)
    assert len(np.unique(cp)) > 1 << 16 and (grams[inverse] == np.lib.stride_tricks.sliding_window_view(cp, 4)).all() and len(grams) == len({tuple(g) for g in grams.tolist()})


def test_language_that_has_only_calibration_documents(spark):
    ids = [r["id"] for r in spark.range(5000, 5100).filter(li._fold(F.col("id")) == 1).collect()]
    d = spark.createDataFrame([*corpus(), *[(i, "привет как дела у вас сегодня " * 4, "dd", "s", 1) for i in ids[:3]]], DOC)
    model = li.fit(d)
    assert model.languages == ["aa", "bb", "cc", "dd"]
    assert [r["lang_pred"] for r in li.identify(spark.createDataFrame([(1, "как дела сегодня")], "doc_id long, text string"), model).collect()] == ["dd"]
