import random
import re
from collections import Counter

import pytest
from chronolode.llm import pii
from pyspark.sql import functions as F

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m[0])))


TEXTS = [
    None, "", "nothing", "a@b.c", "a@b.c_d@e.f x@y..z q@w.e.", "é 😀 mail: jo.e+1%@ex-1.org, ip 255.1.02.3 and 256.1.1.1, 1.2.3.4.5.6.7.8.9", "0255.0.0.1 1.2.3 999999999999.1.1.1",
    "4417744280351547 4417 7442 8035 1547 4417-7442-8035-1547 4417744280351548", "7536784127813050 4845168114407329", "+1 (555) 010-7777 +1((((( +123456789 +1234567890123456 ++1 555 0107777+",
    "1" * 5000 + " " + "a" * 5000 + "@" + "1." * 3000, "+1" + "(" * 3000, "a.b@c.d" * 300, "4417744280351547\n192.168.0.1\t+49 30 1234567",
]


def test_base_equals_python(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "y", 1), (3, TEXTS[3], "x", 3)], "doc_id long, text string, base string, spans int")
    got = pii.find(df).select("doc_id", "text_hash", pii.listed(F.col("base")).alias("b")).collect()
    assert len(got) == len(TEXTS) + 2
    assert sorted(r["b"] for r in got) == sorted([base(t) for t in TEXTS] + [base(TEXTS[4]), base(TEXTS[3])])


def test_discovers_by_context_and_leaves_others(spark):
    seeds = [(i, f"some words here and tel: +1 (555) 010-{1000 + i} then more words follow") for i in range(12)]
    unseen = [(100, "we write tel: 555-010-4321 then nothing"), (101, "the number 555-010-9999 is none of these"), (102, "the a the b the 1234567 c")]
    more = [(200 + i, "the then none of words is here and and the") for i in range(50)]
    got = {r["doc_id"]: r["s"] for r in pii.find(spark.createDataFrame(seeds + unseen + more, "doc_id long, text string")).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert got[100] == "phone:14:26" and got[101] == "" and got[102] == "" and got[0].startswith("phone:")


def test_redact(spark):
    df = spark.createDataFrame([(1, "é a@b.c and 1.2.3.4!", 5, "en"), (2, None, None, None), (3, "clean", 5, "en"), (1, "é a@b.c and 1.2.3.4!", 5, "en")], "doc_id long, text string, n_chars long, lang string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "é <EMAIL> and <IP>!", len("é <EMAIL> and <IP>!"), "en")] * 2 + [(2, None, None, None), (3, "clean", 5, "en")]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).count() == 0 and pii.redact(df).count() == 0


def test_main_path_is_native(spark):
    plan = pii.find(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowEval", ""))


@pytest.mark.parametrize("text", ["x" * 200_000, "1" * 200_000, "1 " * 100_000, "a." * 100_000 + "@", "+" * 100_000])
def test_long_runs_end(spark, text):
    assert pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![A-Za-z0-9])"
MAILISH = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:@|\x20?[\[({]at[\])}]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]+)*"


def bootstrap(texts):
    """Naive loop: {candidate: kind}."""
    mentions, phrases = [], Counter()
    for t in texts:
        words = t.lower().split()
        for k in range(1, pii.PHRASE + 1):
            phrases.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
        spans = [(m.start(), m.end(), k, m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        rest = [(m.start(), m.end(), k, m[0]) for k, p in (("number", NUMBER), ("mailish", MAILISH)) for m in re.finditer(p, t) if k == "mailish" or 7 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
        for a, b, k, x in spans + [c for c in rest if not any(s[0] < c[1] and c[0] < s[1] for s in spans)]:
            before, behind = t[:a].lower().split(), t[b:].lower().split()
            for n in range(1, pii.PHRASE + 1):
                mentions += [("l", " ".join(before[-n:]), x, k)] * (len(before) >= n) + [("r", " ".join(behind[:n]), x, k)] * (len(behind) >= n)
    edges = Counter(mentions)
    seen, rows = Counter(), Counter()
    for (side, phrase, _, _), n in edges.items():
        seen[side, phrase] += n
        rows[side, phrase] += 1
    edges = {e: n for e, n in edges.items() if rows[e[:2]] >= pii.MIN_SUPPORT}
    seeds = {(x, k, k): 1.0 for _, _, x, k in edges if k in pii.KINDS}
    scores = dict(seeds)
    for _ in range(pii.ROUNDS):
        mass, support = Counter(), Counter()
        for (side, phrase, x, c), n in edges.items():
            for k in pii.KINDS:
                if (x, c, k) in scores:
                    mass[side, phrase, k] += scores[x, c, k] * n
                    support[side, phrase, k] += scores[x, c, k] >= 0.5
        sure = {p: m / max(phrases[p[1]], seen[p[:2]]) for p, m in mass.items() if support[p] >= pii.MIN_SUPPORT}
        best = {}
        for side, phrase, x, c in edges:
            for k in pii.KINDS:
                v = sure.get((side, phrase, k), 0)
                if c not in pii.KINDS and v >= pii.MIN_CONFIDENCE and (k == "email") == (c == "mailish"):
                    best[x, c, k, side] = max(best.get((x, c, k, side), 0), min(v, 0.999))
        scores = dict(seeds)
        for x, c, k in {b[:3] for b in best}:
            scores[x, c, k] = 1 - (1 - best.get((x, c, k, "l"), 0)) * (1 - best.get((x, c, k, "r"), 0))
    out = {}
    for (x, c, k), v in scores.items():
        if c not in pii.KINDS and v >= pii.MIN_SCORE:
            out[x] = max(out.get(x, (0, "")), (v, k))
    return {x: k for x, (_, k) in out.items()}


def test_discovery_equals_a_naive_loop(spark):
    r = random.Random(5)
    common = ["my", "number", "is", "at", "the", "a", "of", "reach", "me", "and", "tel:", "now", "x" * 90]
    fill = lambda: " ".join(r.choices(common, k=r.randint(4, 14)))
    texts = []
    for i in range(40):
        texts.append(f"{fill()} my number is +1 (555) 010-{1000 + i} {fill()} reach me at u{i}@h{i % 7}.org {fill()}")
        texts.append(f"{fill()} tel: +49 30 12{10000 + i}\n{fill()} {'x' * 90}{i % 2} 12345{i:02}67")
    texts += [f"{fill()} my  number\tis 555 77{i:02} 01 {fill()} reach me at jo{i} [at] x [dot] org" for i in range(6)] + [f"{fill()} number is the 555 88{i:02} 02" for i in range(6)]
    texts += [f"the is at {fill()}" for _ in range(300)]
    want = bootstrap(texts)
    assert {"555 7703 01": "phone", "jo4 [at] x [dot] org": "email"}.items() <= want.items() and "555 8801 02" not in want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.annotate(docs)
    assert {x["item"]: x["kind"] for x in pii.discover(found, docs).collect()} == want
