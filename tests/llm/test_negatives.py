"""Hard negatives against all pairs."""

import numpy as np
import pytest

from webloom.llm import negatives

FIELDS = "vec_id long, embedding array<float>, label int, id string, rid string, dim string, targets string, v string, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, k, "i", "r", "d", "t", "v", 1) for i, e, k in rows], FIELDS)


def naive(rows, every=50):
    v = [(i, k if i is None or i % 7 else (k + 1) % 10, [int(np.floor(256 * x)) for x in e]) for i, e, k in rows if k is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    order = lambda i: 2**63 if i is None else i
    out = []
    for at, (i, k, q) in enumerate(v):
        if i is None or i % every:
            continue
        s = [(-sum(a * b for a, b in zip(q, e)), order(j), j, m == k) for n, (j, m, e) in enumerate(v) if n != at and len(e) == len(q)]
        for p, _, j, _ in sorted(x for x in s if x[3])[:5]:
            band = sorted(x[:3] for x in s if not x[3] and 50 * -p <= 100 * -x[0] <= 95 * -p)
            out += [(i, j, r + 1, n, -p, -x) for r, (x, _, n) in enumerate(band[:3])]
    return sorted(map(repr, out))


def cases():
    rng = np.random.default_rng(3)
    vector = lambda d=6, at=0.0: [float(np.float32(x)) for x in rng.normal(size=d) + at]
    rows = [(i, vector(at=0.4), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(400 + i, rows[0][1], i % 2) for i in range(90)]  # a common vector, also of anchors
    rows += [(50, rows[3][1], 2), (50, rows[50][1], rows[50][2]), (1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 6, 1), (1150, [float("inf")] * 6, 1), (1200, vector(), None)]
    rows += [(None, rows[1][1], 1), (None, rows[2][1], 3), (1250, [], 1), (1251, [], 1), (1252, [], 2), (1300, [0.0] * 6, 1), (1350, [-3.0] * 6, 77)]
    rows += [(2000 + k, vector(2, 1), k % 3) for k in range(0, 60, 2)] + [(3000 + 50 * k, [0.01 * (k + 1)] * 2000, k % 2) for k in range(6)]
    return rows


@pytest.mark.parametrize("how", [{}, {"sample_rows": 12, "shard_bytes": 400, "block_rows": 4, "pivots": 3, "steps": (0.2, 0.6, 1.0)}, {"sample_rows": 1, "shard_bytes": 3000, "pivots": 2, "steps": (1.0,)}])
def test_negatives_are_those_of_all_pairs(spark, how):
    rows = cases()
    got = negatives.mined(table(spark, rows), **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == naive(rows)


def test_small_and_empty_tables(spark):
    assert negatives.mined(table(spark, [])).count() == 0
    one = [(50, [1.0, 2.0], 1)]
    assert negatives.mined(table(spark, one)).count() == 0
    few = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2), (53, [0.95, 5.0], 2), (54, [0.97, 0.0], 2), (55, [0.5, 0.0], 2), (56, [0.4, 0.0], 2)]
    got = negatives.mined(table(spark, few))
    assert sorted(repr(tuple(r)) for r in got.collect()) == naive(few)


def test_annuli_hold_all_that_is_near():
    rng = np.random.default_rng(5)
    v = rng.integers(-50, 50, (400, 5))
    n = np.arange(400)
    p = negatives.Pivots(n, n, n, v, float((v**2).sum(1).max()), 9)
    pivot, away = p.keys(v)
    for q in v[:40]:
        s = v @ q
        for lo, hi in ((np.sort(s)[-5], negatives.NO_CEILING), (np.sort(s)[-60], np.sort(s)[-20])):
            low, high = p.annuli(q[None], np.array([lo]), np.array([hi]), 1.0)
            wanted = (s >= lo) & (s <= hi)
            assert ((away >= low[pivot]) & (away <= high[pivot]))[wanted].all()


def test_best_takes_ties_by_place():
    rng = np.random.default_rng(7)
    s = rng.integers(0, 4, (30, 40))
    fits = rng.random((30, 40)) < 0.5
    x, y = negatives.best(s, np.arange(40), fits, 3)
    for q in range(30):
        want = sorted(((-s[q, j], j) for j in range(40) if fits[q, j]))[:3]
        assert sorted(y[x == q].tolist()) == sorted(j for _, j in want)
