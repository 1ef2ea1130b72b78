import random

import pytest
from chronolode.llm import decontaminate as dc

DOC = "doc_id long, text string, n_words string, items int, lang string"
ITEM = "item_id long, text string, extra int"
LONG = " ".join(f"w{i}" for i in range(40))


def brute(docs, items, window=dc.WINDOW):
    out = []
    for _, text, *_ in docs:
        w, hit, found = dc.text_words(text), set(), set()
        for item, t, *_ in items:
            x = dc.text_words(t)
            n = min(window, len(x))
            for i in range(len(x) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit.update(range(j, j + n))
                        found |= {item} - {None}
        out.append((len(w), len(hit), sorted(found, key=str)))
    return sorted(out, key=str)


CASES = [
    ([(1, f"Intro {LONG.upper()} end", "x", 1, "en"), (2, None, "x", 1, None), (3, "", None, None, None), (None, "w3 w4 w5", "x", 1, "en"), (1, f"Intro {LONG.upper()} end", "x", 1, "en"), (4, "... !!", "x", 1, "en"), (5, "short item here and short item", "x", 1, "en")],
     [(10, LONG, 1), (10, LONG, 1), (11, None, 1), (12, "", 1), (13, "Short, item!", 1), (None, "here and", 1), (14, "é É über", 1)]),
    ([(1, "é É über " * 3, None, None, None), (2, "a" * 100_000 + " short item " + "b c " * 50_000, None, None, None)], [(13, "short item", None), (14, "é É über", None), (15, "b c b c b c", None)]),
    ([], [(1, "a b", None)]),
    ([(1, "a b", None, None, None)], []),
]


@pytest.mark.parametrize("docs,items", CASES)
def test_equals_brute_force(spark, docs, items):
    got = dc.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert set(got.columns) == {"doc_id", "text", "lang", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"}
    rows = got.collect()
    assert sorted(((r["n_words"], r["n_hit"], list(r["items"])) for r in rows), key=str) == brute(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in rows)


def test_threshold(spark):
    clean = " ".join(f"x{i}" for i in range(300))
    docs = spark.createDataFrame([(1, f"{LONG} {clean}"), (2, f"{' '.join(LONG.split()[:13])} {clean}")], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in dc.decontaminate(docs, spark.createDataFrame([(1, LONG)], "item_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_threshold_is_an_exact_fraction(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f"), (3, "z a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([("i-1", "a b c d")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in dc.decontaminate(docs, items, threshold=(7, 10)).collect()}
    assert got == {1: (4, True), 2: (4, False), 3: (4, True)}
    assert not any(r["contaminated"] for r in dc.decontaminate(docs, items, threshold=(9, 10)).collect())
    assert all(r["contaminated"] for r in dc.decontaminate(docs, items, threshold=(0, 1)).collect())


def test_text_ids_shared_passages_and_random_windows(spark):
    r = random.Random(4)
    words = [f"v{i}" for i in range(12)]
    items = [(f"mmlu-{i}", " ".join(r.choices(words, k=r.randint(1, 30))), 0) for i in range(12)] + [(None, "v1 v2 v3", 0), ("mmlu-3", "V1, v1 v1", 0)]
    passage = " ".join(f"shared{i}" for i in range(30))
    items.append(("long-9", passage, 0))
    docs = [(i if i % 7 else None, " ".join(r.choices(words, k=r.randint(0, 80))) + (f" {passage} {passage}" if i % 3 == 0 else ""), "x", 1, "en") for i in range(60)]
    got = dc.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id string, text string, extra int"), window=6, shingle=3).collect()
    assert sorted(((x["n_words"], x["n_hit"], list(x["items"])) for x in got), key=str) == brute(docs, items, 6)
