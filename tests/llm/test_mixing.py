import numpy as np
import pytest
from chronolode.llm import mixing as mx
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOC = "doc_id long, text string, source string, size string, taken int, _h int, c int"


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: mx.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 500), rng.choice(["a", "b", "É", "z"], 500, p=[0.1, 0.6, 0.2, 0.1]), strict=True))]
    rows += [(7, "x y", None), (7, "x y", None), (None, None, "a"), (None, "", "b"), (900, "   q\t", "q"), (901, None, "none")]
    df = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], DOC)
    got = mx.mix(df)
    assert got.columns == ["doc_id", "text", "source", "_h", "c", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        assert r["size"] == len([x for x in (r["text"] or "").replace("\t", " ").split(" ") if x]) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal = expected_targets(sizes)
    for s, t in goal.items():
        mine = [r for r in out if r["source"] == s]
        assert all(r["target"] == pytest.approx(t) and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 1
    key = F.sort_array(F.collect_list(F.struct("doc_id", "text", "taken")))
    assert mx.mix(df.repartition(3)).agg(key).first() == got.agg(key).first()


def test_empty(spark):
    assert mx.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def sums(pairs):
    out = {0}
    for n, c in pairs:
        out = {s + n * k for s in out for k in range(c + 1)}
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 12)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.floats(0, 1), st.sampled_from([1, 2, 7]))
def test_fit_equals_exhaustive_search(pairs, share, gap):
    """Also with gaps: all lengths even, or multiples of 7."""
    pairs = [(n * gap, c) for n, c in sorted(pairs)]
    length, count = np.array(pairs, np.int64).T
    budget = int(share * (length * count).sum())
    take = mx.fit(length, count, budget)
    assert (take >= 0).all() and (take <= count).all()
    assert int((take * length).sum()) == max(s for s in sums(pairs) if s <= budget)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(1, 40)), min_size=1, max_size=25, unique_by=lambda x: x[0]), st.floats(0, 1), st.sampled_from([0, 10, 500]), st.sampled_from([1, 2, 7]))
def test_shortfall_beyond_the_program_is_below_every_length_left(pairs, share, dp, gap):
    length, count = np.array(sorted(pairs), np.int64).T
    length = length * gap
    budget = int(share * (length * count).sum())
    old, mx.DP_BUDGET = mx.DP_BUDGET, dp
    try:
        take = mx.fit(length, count, budget)
    finally:
        mx.DP_BUDGET = old
    short, left = budget - int((take * length).sum()), length[take < count]
    assert (take >= 0).all() and (take <= count).all() and short >= 0 and (not len(left) or short < left.min())
