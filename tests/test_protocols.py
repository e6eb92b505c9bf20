"""The points where users plug in their own parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momenta.plans import protocols as P


class Ends:
    def features(self, word):
        yield f"first={word[:1]}"
        yield f"last={word[-1:]}"


def test_featurizer(spark):
    words = spark.createDataFrame([("ab",), (None,), ("c",)], "word string")
    assert sorted(tuple(r) for r in P.featurize(words, Ends()).collect()) == [("ab", "first=a"), ("ab", "last=b"), ("c", "first=c"), ("c", "last=c")]


def test_partial_sums(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"))
    got = P.partial_sums(df, lambda b: np.array([len(b), b["x"].to_numpy().sum()]))
    assert {r.i: r.v for r in got.collect()} == {0: 10.0, 1: 45.0}


def test_proximal_gradient(spark):
    rng = np.random.default_rng(0)
    b = np.outer([1.0, -1.0], [0.5, 2.0])
    x = rng.normal(0, 1, (200, 4))
    df = spark.createDataFrame([(float(v @ b.ravel()), v.tolist()) for v in x], "y double, x array<double>").cache()
    seen = []
    got = P.proximal_gradient(P.SquareLoss(df, (2, 2), 1e-3), np.zeros((2, 2)), 0.5, 15, lambda t, m, loss: seen.append(loss))
    assert np.allclose(got, b, atol=0.05) and seen == sorted(seen, reverse=True)


def test_trigram_views(spark):
    counts = spark.createDataFrame([(0, 1, 2, 3), (0, 0, 1, 1)], "w0 int, w1 int, w2 int, n long")
    rows = P.Trigrams(counts).views().collect()
    assert sum(r.p for r in rows) == 4 and {r["view"] for r in rows} == {"12", "13", "32", "123"}


def test_exponential_family(spark):
    """A user's model through its expected counts: that of bags comes to the shares that the bags have."""
    bags = spark.createDataFrame([([0, 0], 30), ([1, 1], 60), ([0, 1], 10)], "x array<int>, n long")
    theta, history = P.fit_exponential(P.BagModel(1, 2), bags, np.zeros(3), 40, penalty=0.0)
    p = np.exp(theta[1:]) / np.exp(theta[1:]).sum()
    assert p == pytest.approx([70 / 200, 130 / 200], abs=1e-3) and history == sorted(history)
