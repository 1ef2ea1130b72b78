import re

import numpy as np
import xxhash
from chronolode.llm import simhash as sh

DOC = "doc_id long, text string, fp int, root string, component_id string, lang string"


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def components(rows):
    fp = [fingerprint(t) for _, t in rows]
    own = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 3 and own[j] < own[i]:
                    own[i], changed = own[j], True
    ids = {c: min([rows[i][0] for i in range(len(rows)) if own[i] == c and rows[i][0] is not None], default=None) for c in own}
    return sorted(((rows[i][0], f"{fp[i]:016x}", ids[own[i]]) for i in range(len(rows))), key=str)


def test_equals_brute_force(spark):
    base = " ".join(f"word{i * 7 % 97}" for i in range(400))
    rows = [(5, base), (2, base.replace("word7 ", "other ", 1)), (9, base.upper()), (9, base.upper()), (None, base), (3, None), (1, ""), (8, " \t\n"), (4, "one"), (7, "one two"), (6, "É é one two"), (None, "only here"), (11, "x " * 60_000), (12, "ÀB c\x0b d\x1ce f")]
    df = spark.createDataFrame([(i, t, 1, "r", "c", None) for i, t in rows], DOC)
    got = sh.near_duplicates(df)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=str) == components(rows)
    kept = sh.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({c for *_, c in components(rows)}) and len(set(ids)) == len(ids)


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set(base.tolist())
    for b in base.tolist():
        for n in (1, 2, 3, 4):
            for _ in range(4):
                x = b
                for bit in rng.choice(64, n, replace=False).tolist():
                    x ^= 1 << bit
                values.add(x)
    values |= {0, 2**64 - 1, 7, 2**63}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = {frozenset((r["a"], r["b"])) for r in sh.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    expected = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == expected


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_duplicates(df).count() == 0 and sh.deduplicate(df).count() == 0


def test_long_chain(spark):
    from chronolode.llm._session import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
