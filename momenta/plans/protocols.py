"""What users plug in: moment providers, features, losses and models of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momenta.plans.small import soft_threshold

#: A row's vector to its embedding.
Embedding = Callable[[Column], Column]


class MomentProvider(Protocol):
    """Anything with the four tables of three views: (view, x1, x2, x3, n, p), view 12, 13, 32 and 123."""

    def views(self) -> DataFrame: ...


class Trigrams:
    """The moments of adjacent words, from counts (w0, w1, w2, n)."""

    def __init__(self, counts: DataFrame, order: tuple[int, int, int] = (0, 2, 1)):
        self.counts, self.order = counts, order

    def views(self) -> DataFrame:
        from momenta.operators.ngrams import views

        return views(self.counts, self.order)


class Featurizer(Protocol):
    def features(self, word: str) -> Iterable[str]: ...


def featurize(words: DataFrame, featurizer: Featurizer, column: str = "word") -> DataFrame:
    """(word, feature) by a featurizer in Python, over Arrow batches; features that are column expressions need none of it."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, f) for w in batch["word"].to_pylist() if w is not None for f in featurizer.features(w)]
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["word", "feature"])

    return words.select(F.col(column).alias("word")).mapInArrow(run, "word string, feature string")


def partial_sums(df: DataFrame, update: Callable[[object], np.ndarray], schema_column: str = "v") -> DataFrame:
    """(i, v): update(Arrow batch) gives a vector; vectors of all batches are added by place. An aggregate of a user's own: partial in the task, merged by a group-by."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                v = np.asarray(update(batch), float)
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    return df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias(schema_column))


class ExponentialFamily(Protocol):
    """A log-linear model with hidden states: its features' expectations with the rows given and without, and the log-likelihood a row."""

    def expected_counts(self, df: DataFrame, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]: ...


class BagModel:
    """Bags of one length from k states with d symbols: weights of states (k), then of (state, symbol) (k d)."""

    def __init__(self, k: int, d: int):
        self.k, self.d = k, d

    def expected_counts(self, df: DataFrame, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        from momenta.plans.estimators import bag_expectations

        return bag_expectations(df, params, self.k, self.d)


def fit_exponential(model: ExponentialFamily, df: DataFrame, start: np.ndarray, steps: int = 30, **options) -> tuple[np.ndarray, list[float]]:
    """The parameters by gradient EM, each step one aggregation over df, and the penalised log-likelihoods."""
    from momenta.plans.estimators import loglinear_em

    return loglinear_em(lambda params: model.expected_counts(df, params), start, steps, **options)


class Proximal(Protocol):
    """A loss over rows: gradient() and loss() are one aggregation each, project() works on the parameters."""

    def gradient(self, b: np.ndarray) -> np.ndarray: ...

    def loss(self, b: np.ndarray) -> float: ...

    def project(self, b: np.ndarray, step: float) -> np.ndarray: ...


class SquareLoss:
    """Mean square of y - <B, x> for B of a given shape (x as long as B has cells), with singular values lowered by `penalty`."""

    def __init__(self, samples: DataFrame, shape: tuple[int, int], penalty: float = 0.0):
        self.samples, self.shape, self.penalty = samples, shape, penalty

    def gradient(self, b: np.ndarray) -> np.ndarray:
        from momenta.operators import mixtures as X

        rows = X.gradient(self.samples, X.linear(b.ravel().tolist()), X.features(1, b.size)).collect()
        return np.array([r.v for r in sorted(rows, key=lambda r: r.i)]).reshape(self.shape)

    def loss(self, b: np.ndarray) -> float:
        from momenta.operators import mixtures as X

        return X.square_loss(self.samples, X.linear(b.ravel().tolist())).first().loss / 2

    def project(self, b: np.ndarray, step: float) -> np.ndarray:
        return soft_threshold(b, step * self.penalty)


def proximal_gradient(problem: Proximal, start: np.ndarray, rate: float, steps: int = 20, on_step: Callable[[int, np.ndarray, float], None] | None = None) -> np.ndarray:
    """Gradient steps, each followed by the projection; the rate is halved when the loss rises."""
    b, value = start, problem.loss(start)
    for t in range(steps):
        while True:
            new = problem.project(b - rate * problem.gradient(b), rate)
            loss = problem.loss(new)
            if loss <= value or rate < 1e-9:
                break
            rate /= 2
        b, value = new, loss
        if on_step:
            on_step(t, b, value)
    return b
