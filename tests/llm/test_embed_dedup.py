import numpy as np
import pytest
from chronolode.llm import embed_dedup as ed

VEC = "vec_id long, embedding array<float>, label int, n_links string, cls int, extra string"


def brute(rows):
    usable = lambda v, lab: lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    x = [np.array(v, np.float32).astype(float) if usable(v, lab) else None for _, v, lab in rows]
    own, n = list(range(len(rows))), [0] * len(rows)
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and rows[i][2] == rows[j][2] and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j])
             and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98]
    for i, _ in pairs:
        n[i] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if own[j] < own[i]:
                own[i], changed = own[j], True
    low = {c: min((rows[i][0] for i in range(len(rows)) if own[i] == c and rows[i][0] is not None), default=None) for c in own}
    return sorted(((rows[i][0], n[i], low[own[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rows, nan = [], float("nan")
    for c in range(25):
        centre = r.standard_normal(16)
        for s in r.uniform(0, 0.06, r.integers(1, 12)):
            rows.append((len(rows), (centre + s * r.standard_normal(16)).tolist(), int(c % 3)))
        rows.append((len(rows), (centre * 5).tolist(), int(c % 3)))
        rows.append((len(rows), (centre * 5).tolist(), None if c % 2 else int(c % 3)))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [nan] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0] * 16, 2), (905, [1.0] * 16, 2), (None, [1.0] * 16, 2), (906, [1.0] * 8, 2), (907, [float("inf")] + [1.0] * 15, 2), (None, None, None)]
    got = ed.near_duplicates(spark.createDataFrame([(*x, "n", 1, None) for x in rows], VEC)).collect()
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in got), key=str) == brute(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)


def test_crowded_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 7)
    r = np.random.default_rng(4)
    c = r.standard_normal(8)
    rows = [(i, (c + 0.01 * r.standard_normal(8)).tolist(), 1) for i in range(60)]
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in got), key=str) == brute(rows)


def test_recall_at_the_threshold():
    r = np.random.default_rng(0)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    for classes in (10, 10_000, 300_000, 10_000_000):
        hashes, tables = ed.shape(classes, 0.98, ed.WIDTH)
        some = slice(0, 4000 if classes < 10**6 else 500)
        met = [(ed.keys(x[some], tables, hashes, ed.WIDTH, ed.SEED)) for x in (a, near, -b)]
        assert (met[0] == met[1]).any(axis=1).mean() > 0.999
        # Of unrelated vectors as many meet in the largest label as in a small one, or fewer.
        assert (met[0] == met[2]).mean() * classes < 0.5 or classes <= 10_000


def test_larger_labels_have_more_projections_and_tables():
    shapes = [ed.shape(n, 0.98, ed.WIDTH) for n in (1, 10_000, 100_000, 10**7)]
    assert shapes[0] == shapes[1] == (10, 48) and all(x < y for x, y in zip(shapes[1:], shapes[2:], strict=False))


def test_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
