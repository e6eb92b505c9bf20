"""Lattice models against enumeration of all hidden states and symbols, and fits on the users' events."""

import itertools

import numpy as np
import pytest

from momenta.plans import estimators, loglinear
from momenta.plans.loglinear import Lattice, Lattices


def features(shape, h, x):
    """h: (rows, cols), x: (rows, cols, seen)."""
    o, t = np.zeros((shape.k, shape.d)), np.zeros((shape.k, shape.k))
    for r, c in np.ndindex(h.shape):
        for v in x[r, c]:
            o[h[r, c], v] += 1
        if r:
            t[h[r - 1, c], h[r, c]] += 1
        if c:
            t[h[r, c - 1], h[r, c]] += 1
    return np.concatenate([o.ravel(), t.ravel()])


def enumerated(shape, theta, symbols, rows):
    """Expected features and log-sum over all h, and over all symbols that are not known."""
    width = shape.cols * shape.seen
    known = [*symbols, *[-1] * (rows * width - len(symbols))]
    total, mean = 0.0, np.zeros(shape.size)
    for x in itertools.product(*[[v] if 0 <= v < shape.d else range(shape.d) for v in known]):
        for h in itertools.product(range(shape.k), repeat=rows * shape.cols):
            f = features(shape, np.array(h).reshape(rows, shape.cols), np.array(x).reshape(rows, shape.cols, shape.seen))
            w = np.exp(theta @ f)
            total, mean = total + w, mean + w * f
    return mean / total, np.log(total)


CHAIN, GRID, WIDE = Lattice(2, 3), Lattice(2, 2, cols=2, seen=2), Lattice(2, 2, cols=3)
DATA = {
    "chain": (CHAIN, [([0, 1, 2, 1, 0], 3), ([2], 1), ([1, -1, 7], 2), ([2, 2], 1)]),
    "grid": (GRID, [([0, 1, 1, 0, 1, 1, 0, 0], 2), ([1, 0, 1], 1)]),
    "wide": (WIDE, [([0, 1, 1, 0, 1, 1], 2), ([1, 0, -1], 1), ([1], 2)]),
}


@pytest.mark.parametrize("name", sorted(DATA))
def test_sums_against_enumeration(spark, name):
    shape, data = DATA[name]
    theta = np.random.default_rng(4).normal(0, 1, shape.size)
    model = Lattices(spark.createDataFrame([*data, ([], 5), (None, 2)], "x array<int>, n int"), shape)
    n = sum(w for _, w in data)
    rows = [-(-len(x) // (shape.cols * shape.seen)) for x, _ in data]
    for got, items in ((model.clamped(theta), [x for x, _ in data]), (model.free(theta), [[] for _ in data])):
        found = [enumerated(shape, theta, x, r) for x, r in zip(items, rows, strict=True)]
        assert np.allclose(got[0], sum(w * f for (_, w), (f, _) in zip(data, found, strict=True)) / n)
        assert np.isclose(got[1], sum(w * z for (_, w), (_, z) in zip(data, found, strict=True)) / n)


@pytest.mark.parametrize("name", sorted(DATA))
def test_gradient_is_that_of_the_likelihood(spark, name):
    shape, data = DATA[name]
    theta = np.random.default_rng(5).normal(0, 0.5, shape.size)
    model = Lattices(spark.createDataFrame(data, "x array<int>, n int"), shape)
    given, alone, _ = model(theta)
    step = np.random.default_rng(6).normal(0, 1, shape.size)
    higher, lower = (model(theta + e * step)[2] for e in (1e-4, -1e-4))
    assert np.isclose((higher - lower) / 2e-4, (given - alone) @ step, rtol=1e-5)


def test_likelihood_never_falls(spark):
    rng = np.random.default_rng(7)
    model = Lattices(spark.createDataFrame([(rng.integers(0, 3, rng.integers(1, 12)).tolist(),) for _ in range(200)], "x array<int>"), CHAIN)
    _, history = estimators.loglinear_em(model, rng.normal(0, 0.1, CHAIN.size), 6)
    assert all(b >= a for a, b in itertools.pairwise(history)) and history[-1] > history[0]


def test_bounds_and_empty_data(spark):
    with pytest.raises(ValueError, match="states"):
        Lattice(10, 3, cols=3)
    with pytest.raises(ValueError, match="symbol"):
        Lattices(spark.createDataFrame([([],), (None,)], "x array<int>"), CHAIN)


def test_long_sequence_keeps_its_scale(spark):
    """Thousands of rows neither overflow nor underflow: with equal weights every feature has its share."""
    model = Lattices(spark.createDataFrame([([0, 1, 2] * 3000,)], "x array<int>"), CHAIN)
    given, log_sum = model.clamped(np.zeros(CHAIN.size))
    assert np.allclose(given[:6], 1500) and np.allclose(given[6:], 8999 / 4) and np.isclose(log_sum, 9000 * np.log(2))


@pytest.mark.parametrize("strength", [4.0, 200.0])
def test_measured_features(spark, strength):
    """The dual's optimum meets the measurements up to beta / strength, its gap closes, and the value falls from step to step."""
    rng = np.random.default_rng(8)
    model = Lattices(spark.createDataFrame([(rng.integers(0, 3, 6).tolist(),) for _ in range(100)], "x array<int>"), CHAIN)
    start = rng.normal(0, 0.3, CHAIN.size)
    tau = np.full(CHAIN.size, np.nan)
    tau[:4] = model.clamped(start + np.r_[1.0, -0.5, 0.3, 0.2, np.zeros(6)])[0][:4]
    fitted = loglinear.fit_measured(model, start, tau, strength, steps=4)
    values, gaps, apart = zip(*fitted.history, strict=True)
    assert max(gaps) < 1e-4
    assert np.isclose(apart[-1], np.abs(fitted.beta).max() / strength, atol=1e-4)
    assert all(b <= a + 1e-6 for a, b in itertools.pairwise(values))
    assert strength < 100 or apart[-1] < 0.02


def test_nothing_measured_is_plain_em(spark):
    rng = np.random.default_rng(9)
    model = Lattices(spark.createDataFrame([(rng.integers(0, 3, 5).tolist(),) for _ in range(50)], "x array<int>"), CHAIN)
    start = rng.normal(0, 0.3, CHAIN.size)
    fitted = loglinear.fit_measured(model, start, np.full(CHAIN.size, np.nan), steps=2)
    score = lambda th: model(th)[2] - 1e-2 * th @ th / 2
    assert np.isclose(-fitted.history[0][0], score(start)) and score(fitted.theta) > score(start)
