import math
import random
import re

import numpy as np
import pytest
from chronolode.llm import _grid
from chronolode.llm import toxicity as tox
from pyspark.sql import functions as F

DOC = "doc_id long, text string, score string, predicted int, lang string"


def corpus(n=400, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abdefgilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        sents = [" ".join(r.choices(words, k=r.randint(4, 12))) for _ in range(r.randint(1, 8))]
        bad = i % 6 == 0
        if bad:
            k = r.randrange(len(sents))
            sents[k] += " zukwort" + r.choice(["a", "en", "ist", "xu"])
        docs.append((i, ". ".join(s.capitalize() for s in sents) + ".", "s", 9, None))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_from_labels_and_locates(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOC)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1), labels[0]], "doc_id long, toxic int")
    model = tox.fit(d, lab)
    got = tox.score(d, model)
    assert set(got.columns) == {"doc_id", "text", "lang", "score", "predicted", "sentences"}
    rows = got.withColumn("held", tox.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["held"]]
    assert 60 < len(held) < 250
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["predicted"]:
            assert any("zukwort" in r["text"][x["start"] : x["end"]].lower() for x in r["sentences"])
    again = tox.fit(d.repartition(3), lab)
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_edges(spark):
    docs, labels = corpus(120)
    model = tox.fit(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = [(1, None, None, None, None), (None, "", None, None, None), (2, "... 123 !!", None, None, None), (2, "É" * 50_000, None, None, None), (3, "wort ist hier. " * 20_000, None, None, None)]
    rows = tox.score(spark.createDataFrame(odd, DOC), model).collect()
    assert len(rows) == 5 and sorted(r["score"] for r in rows)[:3] == [0, 0, 0]
    assert tox.score(spark.createDataFrame([], DOC), model).count() == 0


def test_without_toxic_labels(spark):
    docs, _ = corpus(30)
    d = spark.createDataFrame(docs, DOC)
    for lab in ([], [(1, 0), (2, 0)]):
        rows = tox.classify(d, spark.createDataFrame(lab, "doc_id long, toxic int")).collect()
        assert len(rows) == 30 and all(r["predicted"] == 0 for r in rows)


def test_offsets_are_code_points(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOC)
    model = tox.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = "Été 😀 là. Dann zukworten hier! Ende"
    r = tox.score(spark.createDataFrame([(0, "vorher"), (1, text)], "doc_id long, text string"), model).filter("doc_id = 1").first()
    assert [text[x["start"] : x["end"]] for x in r["sentences"]] == ["Dann zukworten hier"]


def test_plain_sentences_are_no_evidence(spark):
    """Any number of sentences without a telling feature scores 0; one sentence that has some is found among them."""
    docs, labels = corpus()
    model = tox.fit(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = "Hhh jjj kkk. " * 50_000 + "Hhh jjj kkk\n" * 50_000
    rows = tox.score(spark.createDataFrame([(0, plain), (1, plain + "hhh zukworten jjj"), (2, "hhh zukworten jjj")], "doc_id long, text string"), model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["score"], by[0]["predicted"], by[0]["sentences"]) == (0, 0, [])
    assert by[1]["score"] == by[2]["score"] and by[1]["predicted"] == 1 and len(by[1]["sentences"]) == 1


def brute(text, model):
    """The noisy-or in plain Python: sentences by punctuation and line ends, words with their beginnings, each once."""
    left, found = 1.0, []
    for sentence in re.split(r"[.!?\n]", text or ""):
        seen = set()
        for word in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", sentence):
            word = "".join(c.lower() if c < "\u0080" or "\u00c0" <= c <= "\u00de" else c for c in word).encode()
            h = _grid.hash_slices(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), tox.PREFIXES)[:, 0]
            seen |= {int(x) >> (64 - tox.FEATURE_BITS) for x in h if x}
        weights = [float(model.weights[f]) for f in seen if model.weights[f]]
        if weights:
            p = 1 / (1 + math.exp(-model.bias - sum(weights)))
            left *= 1 - p
            found.append(p)
    return 1 - left, [p for p in found if p >= tox.SENTENCE_THRESHOLD]


def test_scores_equal_a_plain_noisy_or(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (1000, "ÜBER zukworten. zukwortist! ÀÞ\nx", None, None, None), (1001, None, None, None, None)], DOC)
    model = tox.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in tox.score(d, model).collect():
        score, found = brute(r["text"], model)
        assert r["score"] == pytest.approx(score, abs=1e-6) and [x["p"] for x in r["sentences"]] == pytest.approx(found, rel=1e-4)


def test_learning_reads_one_row_an_id_and_no_longer_texts_than_the_bound(spark, monkeypatch):
    docs, labels = corpus(150)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit(spark.createDataFrame(docs, DOC), lab)
    monkeypatch.setattr(tox, "MAX_BYTES", max(len(d[1].encode()) for d in docs))
    more = [(i, "z " * tox.MAX_BYTES, "s", 1, None) for i in (0, 6, 12)] + docs[:50]
    again = tox.fit(spark.createDataFrame(docs + more, DOC), lab)
    assert again.bias == model.bias and (again.weights == model.weights).all()
