"""Log-linear models with hidden states over lattices: chains and grids, fitted by likelihood or towards measured features.

A lattice has rows of `cols` cells, each with a hidden state and `seen` symbols; a chain has one cell a row and one symbol a cell.
Weights are o (state, symbol) and t (state, state); t counts for neighbours down and across. p(x, h) is proportional to
exp(weights of all cells and edges), normalised over all h and x of the lattice's number of rows. The states of a row together are
one state of a chain over rows (k^cols of them, a checked bound), so sums over h take one pass down and one up; a symbol that isn't
known is summed out, and the normaliser is the same pass over lattices without any symbol, one for each number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.plans.protocols import partial_sums
from momenta.sources.scratch import saved

#: States of a row of cells together, at most.
MOST_STATES = 256
#: Numbers that a task holds at once: lattices times rows times states.
CELLS = 1 << 20


@dataclass
class Lattice:
    """Shape of the model; its weights are one vector, o (k d) before t (k k)."""

    k: int
    d: int
    cols: int = 1
    seen: int = 1
    states: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if self.k**self.cols > MOST_STATES:
            raise ValueError(f"{self.k} states in {self.cols} columns make more than {MOST_STATES} states a row")
        self.states = np.stack(np.unravel_index(np.arange(self.k**self.cols), (self.k,) * self.cols), axis=1)

    @property
    def size(self) -> int:
        return self.k * self.d + self.k * self.k

    def split(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.k * self.d
        return theta[:at].reshape(self.k, self.d), theta[at:].reshape(self.k, self.k)

    def rows(self, x: str = "x"):
        """Column: the number of rows of a lattice whose symbols are listed row by row, cell by cell."""
        return F.ceil(F.size(x) / F.lit(self.cols * self.seen)).cast("int")

    def sums(self, theta: np.ndarray, x: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected features, then the log of the sum over h, both summed with weights; x: (lattice, row, cell, symbol), d where unknown."""
        o, t = self.split(theta)
        s, n, length = self.states, len(x), x.shape[1]
        unknown = np.logaddexp.reduce(o, axis=1)
        cell = np.concatenate([o, unknown[:, None]], axis=1).T[x].sum(axis=3)
        node = sum(cell[:, :, c, s[:, c]] for c in range(self.cols)) + sum(t[s[:, c], s[:, c + 1]] for c in range(self.cols - 1))
        move = np.exp(sum(t[s[:, None, c], s[None, :, c]] for c in range(self.cols)))
        inside = np.arange(length) < size[:, None]
        top = node.max(axis=2)
        e = np.exp(node - top[:, :, None])

        down, logs = np.empty_like(e), np.where(inside, top, 0.0)
        now = e[:, 0]
        for r in range(length):
            if r:
                now = (down[:, r - 1] @ move) * e[:, r]
            z = now.sum(axis=1)
            down[:, r] = now / z[:, None]
            logs[:, r] += np.where(inside[:, r], np.log(z), 0.0)
        edges, up = np.zeros_like(move), np.ones((n, len(s)))
        nodes = np.empty_like(e)
        for r in range(length - 1, -1, -1):
            if r + 1 < length:
                later = e[:, r + 1] * up
                back = later @ move.T
                z = (down[:, r] * back).sum(axis=1)
                w = np.where(inside[:, r + 1], weight / z, 0.0)
                edges += move * np.einsum("na,nb,n->ab", down[:, r], later, w)
                up = np.where(inside[:, r + 1][:, None], back / back.max(axis=1, keepdims=True), 1.0)
            post = down[:, r] * up
            nodes[:, r] = post * (inside[:, r] * weight / post.sum(axis=1))[:, None]

        counts, pairs = np.zeros((self.k, self.d + 1)), np.zeros((self.k, self.k))
        flat = nodes.sum(axis=(0, 1))
        for c in range(self.cols):
            for h in range(self.k):
                p = nodes[:, :, s[:, c] == h].sum(axis=2).ravel()
                for j in range(self.seen):
                    counts[h] += np.bincount(x[:, :, c, j].ravel(), p, self.d + 1)
            np.add.at(pairs, (s[:, None, c].repeat(len(s), 1), s[None, :, c].repeat(len(s), 0)), edges)
            if c + 1 < self.cols:
                np.add.at(pairs, (s[:, c], s[:, c + 1]), flat)
        features = counts[:, : self.d] + counts[:, self.d :] * np.exp(o - unknown[:, None])
        return np.concatenate([features.ravel(), pairs.ravel(), [(weight * logs.sum(axis=1)).sum()]])

    def unpack(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols in the shape of sums(), rows and weights of a batch (x, rows, n)."""
        lists, size, weight = batch["x"].to_pylist(), batch["rows"].to_numpy().astype(np.int64), batch["n"].to_numpy().astype(float)
        width = self.cols * self.seen
        x = np.full((len(lists), max(int(size.max(initial=0)), 1) * width), self.d, np.int64)
        for row, symbols in zip(x, lists, strict=True):
            if symbols:
                row[: len(symbols)] = [self.d if v is None or not 0 <= v < self.d else v for v in symbols]
        return x.reshape(len(lists), -1, self.cols, self.seen), size, weight

    def parts(self, batch: pa.RecordBatch):
        """The batch by number of rows, in parts that stay within CELLS."""
        size = pc.fill_null(batch["rows"], 0).to_numpy().astype(np.int64)
        order, start = np.argsort(size, kind="stable"), 0
        while start < len(order):
            held = np.maximum(size[order[start:]], 1) * np.arange(1, len(order) - start + 1) * len(self.states)
            count = max(1, int(np.searchsorted(held, CELLS, side="right")))
            yield batch.take(pa.array(order[start : start + count]))
            start += count


class Lattices:
    """The data of a model: distinct symbol lists (x, rows, n) and numbers of rows (rows, n), each written once.

    Every evaluation is one aggregation over distinct lattices, and one over distinct numbers of rows for the normaliser; what comes back
    has the weights' size. Lists without symbols say nothing and are left out."""

    def __init__(self, sequences: DataFrame, shape: Lattice):
        self.shape = shape
        n = F.col("n") if "n" in sequences.columns else F.lit(1)
        rows = sequences.select(F.col("x").cast("array<int>").alias("x"), n.cast("long").alias("n")).where(F.size("x") > 0)
        self.clamped_rows = saved(rows.groupBy("x").agg(F.sum("n").alias("n")).withColumn("rows", shape.rows()), "lattices")
        self.free_rows = saved(self.clamped_rows.groupBy("rows").agg(F.sum("n").alias("n")).withColumn("x", F.array().cast("array<int>")), "sizes")
        self.total = self.free_rows.agg(F.sum("n")).first()[0] or 0
        if not self.total:
            raise ValueError("no sequence has a symbol")

    def _mean(self, rows: DataFrame, theta: np.ndarray) -> tuple[np.ndarray, float]:
        shape = self.shape

        def update(batch: pa.RecordBatch) -> np.ndarray:
            return sum(shape.sums(theta, *shape.unpack(part)) for part in shape.parts(batch))

        found = np.zeros(shape.size + 1)
        for r in partial_sums(rows.select("x", "rows", "n"), update).collect():
            found[r.i] = r.v
        return found[:-1] / self.total, found[-1] / self.total

    def clamped(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """Mean expected features given the symbols, and the mean log of the sum over h of exp(weights)."""
        return self._mean(self.clamped_rows, theta)

    def free(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """The same without the symbols: the model's features, and the mean log of its normaliser."""
        return self._mean(self.free_rows, theta)

    def __call__(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """What loglinear_em() asks for: clamped and free features, and the mean log-likelihood."""
        (given, joint), (alone, norm) = self.clamped(theta), self.free(theta)
        return given, alone, joint - norm


def ascend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 40, enough: float = 1e-5) -> tuple[np.ndarray, float, np.ndarray]:
    """The maximum of a concave f (value, gradient) by quasi-Newton steps, until no coordinate of the gradient exceeds `enough`; (point, value, gradient)."""
    at, inverse = start.copy(), None
    value, g = f(at)
    for _ in range(steps):
        if np.abs(g).max(initial=0) <= enough:
            break
        way = g if inverse is None else inverse @ g
        if way @ g <= 0:
            way, inverse = g, None
        rate = 1.0
        while True:
            new, slope = f(at + rate * way)
            if new >= value + 1e-4 * rate * (way @ g) or rate < 1e-8:
                break
            rate /= 2
        if new < value:
            break
        s, y = rate * way, g - slope
        at, value, g = at + s, new, slope
        if s @ y > 1e-12:
            if inverse is None:
                inverse = np.eye(len(at)) * (s @ y) / (y @ y)
            left = np.eye(len(at)) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
    return at, value, g


@dataclass
class Measured:
    """Weights theta, multipliers beta, and one row a step: value after the E-step, duality gap, largest gap between features and measurements."""

    theta: np.ndarray
    beta: np.ndarray
    history: list[tuple[float, float, float]]


def fit_measured(model: Lattices, start: np.ndarray, tau: np.ndarray, strength: float = 10.0, penalty: float = 1e-2, steps: int = 5, inner: int = 30) -> Measured:
    """EM with measured features: tau has mean features a sequence, nan where nothing was measured.

    E-step: the posterior nearest to the model's whose features lie near tau is q = p(h | x; theta + beta), where beta maximises the dual
    tau beta - B(theta + beta) - |beta|^2 / (2 strength), B being the clamped log-sum; there features differ from tau by beta / strength.
    M-step: theta maximises q's features times theta - A(theta) - penalty |theta|^2 / 2, A being the normaliser, which needs numbers of rows only.
    The value, which no step raises, is A(theta) + penalty |theta|^2 / 2 + dual.
    """
    known = ~np.isnan(tau)
    theta, beta, history = start.copy(), np.zeros(int(known.sum())), []

    def tilted(b: np.ndarray) -> np.ndarray:
        out = theta.copy()
        out[known] += b
        return out

    def dual(b: np.ndarray) -> tuple[float, np.ndarray]:
        features, log_sum = model.clamped(tilted(b))
        return float(tau[known] @ b - log_sum - b @ b / (2 * strength)), tau[known] - features[known] - b / strength

    for _ in range(steps):
        beta, value, left = ascend(dual, beta, inner)
        target, _ = model.clamped(tilted(beta))
        _, norm = model.free(theta)
        history.append((value + norm + penalty * theta @ theta / 2, float(strength * left @ left / 2), float(np.abs(tau - target)[known].max(initial=0))))

        def primal(point: np.ndarray) -> tuple[float, np.ndarray]:
            features, log_sum = model.free(point)
            return float(target @ point - log_sum - penalty * point @ point / 2), target - features - penalty * point  # noqa: B023

        theta = ascend(primal, theta, inner)[0]
    return Measured(theta, beta, history)
