"""The toxicity model against a second implementation with dictionaries and plain loops."""

import math

import numpy as np
import pytest

from webloom.llm import toxicity


def sigmoid(z):
    return 1 / (1 + math.exp(-min(40, max(-40, z))))


def plain_weights(rows, y):
    """Naive Bayes log-count ratios as scales of a logistic regression: gradient steps with momentum."""
    size = 1 << toxicity.BITS
    count = [{}, {}]
    for r, label in zip(rows, y):
        for h in r:
            count[label][h] = count[label].get(h, 0) + 1
    total = [size + sum(c.values()) for c in count]
    ratio = {h: math.log((1 + count[1].get(h, 0)) / total[1]) - math.log((1 + count[0].get(h, 0)) / total[0]) for r in rows for h in r}
    n = len(y)
    rate = 3.0 / (sum(ratio[h] ** 2 for r in rows for h in r) / n + 1)
    w, v, b, vb = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for _ in range(60):
        g, gb = {h: toxicity.L2 * x / n for h, x in w.items()}, 0.0
        for r, label in zip(rows, y):
            e = (sigmoid(b + sum(w[h] * ratio[h] for h in r)) - label) / n
            gb += e
            for h in r:
                g[h] += e * ratio[h]
        for h in w:
            v[h] = 0.9 * v[h] - rate * n**0.5 * g[h]
            w[h] += v[h]
        vb = 0.9 * vb - rate * n**0.5 * gb
        b += vb
    return {h: w[h] * ratio[h] for h in w}, b


def plain_scores(rows, y, prior, asked):
    more = 1 + len(rows) // 20
    rows, y = rows + [[]] * more, y + [0] * more
    weights, b = plain_weights(rows, y)
    margin = lambda model, r: model[1] + sum(model[0].get(h, 0.0) for h in r)
    z = [0.0] * len(rows)
    for k in range(toxicity.FOLDS):
        rest = [i for i in range(len(rows)) if i % toxicity.FOLDS != k]
        model = plain_weights([rows[i] for i in rest], [y[i] for i in rest])
        for i in range(k, len(rows), toxicity.FOLDS):
            z[i] = margin(model, rows[i])
    share = sum(y) / len(y)
    weight = [prior / share if label else (1 - prior) / (1 - share) for label in y]
    # the minimum of the penalised loss, by many small Newton steps of two unknowns
    a, c = 1.0, 0.0
    for _ in range(200):
        p = [sigmoid(a * x + c) for x in z]
        ga = sum(u * (q - t) * x for u, q, t, x in zip(weight, p, y, z)) + 1e-2 * (a - 1)
        gc = sum(u * (q - t) for u, q, t in zip(weight, p, y)) + 1e-3 * c
        h = [u * q * (1 - q) for u, q in zip(weight, p)]
        aa, ac, cc = sum(k * x * x for k, x in zip(h, z)) + 1e-2, sum(k * x for k, x in zip(h, z)), sum(h) + 1e-3
        det = aa * cc - ac * ac
        da, dc = (cc * ga - ac * gc) / det, (aa * gc - ac * ga) / det
        most = max(1.0, max(abs(da), abs(dc)) / 2)
        a, c = a - da / most, c - dc / most
    return [sigmoid(max(a, 1e-3) * margin((weights, b), r) + c) for r in asked]


@pytest.mark.parametrize("seed", [0, 1])
def test_fit_is_that_of_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 1 << toxicity.BITS, 60)
    draw = lambda toxic: sorted({int(x) for x in rng.choice(bins[: 40 if toxic else 60], rng.integers(0, 12))} | ({int(bins[0])} if toxic and rng.random() < 0.7 else set()))
    y = [int(rng.random() < 0.4) for _ in range(70)]
    rows = [draw(t) for t in y]
    asked = [draw(t) for t in (0, 1) * 10] + [[], [12345]]
    model = toxicity.fit_rows([np.array(r, np.uint32) for r in rows], y, 0.1)
    want = plain_scores(rows, y, 0.1, asked)
    z = np.array([model.intercept + float(model.weights[r].astype(np.float64).sum()) for r in asked])
    got = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
    assert got == pytest.approx(want, abs=1e-6)


def test_bins_are_hashed_grams_of_four_and_five_characters():
    one, two, none = (set(toxicity.distinct_bins(t).tolist()) for t in ("abcdef", "zbcdef", ""))
    assert one != two and one & two and not none
