"""Hidden chains over packed sequences (seq_id, x ARRAY<INT>): decoding, posteriors, likelihood and EM.

The parameters are K, K x K and K x D arrays and travel with the job; a batch of sequences is worked through position
by position, all its sequences at once, with scaling at each step. Only sums of the parameters' size come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.sources.scratch import saved

#: Positions that are worked through at once: sequences times the longest one's length.
CELLS = 1 << 20


@dataclass
class Chain:
    """pi (K), t (K, K) and o (K, D): rows sum to one."""

    pi: np.ndarray
    t: np.ndarray
    o: np.ndarray

    @classmethod
    def random(cls, k: int, d: int, seed: int = 0) -> Chain:
        draw = np.random.default_rng(seed).dirichlet
        return cls(draw(np.ones(k)), draw(np.ones(k), k), draw(np.ones(d), k))

    @classmethod
    def from_table(cls, params: DataFrame, k: int, d: int) -> Chain:
        """From (kind, h1, h2, p) as supervised_chain() gives it; k and d bound what is collected."""
        out = cls(np.zeros(k), np.zeros((k, k)), np.zeros((k, d)))
        for r in params.collect():
            cell = (int(r.h1),) if r.kind == "pi" else (int(r.h1), int(r.h2))
            {"pi": out.pi, "T": out.t, "O": out.o}[r.kind][cell] = r.p
        return out


def _padded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as rows of one array, -1 behind their ends; null and negative symbols count as unknown (-1) too."""
    rows = [[-1 if v is None else v for v in (x or [])] for x in batch["x"].to_pylist()]
    size = np.array([len(r) for r in rows], np.int64)
    x = np.full((len(rows), max(size.max(initial=0), 1)), -1, np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, size


def _emissions(c: Chain, x: np.ndarray) -> np.ndarray:
    """(sequence, position, state): probability of the symbol; one where there is none."""
    e = np.concatenate([c.o.T, np.ones((1, len(c.pi)))])
    return e[np.where((x >= 0) & (x < c.o.shape[1]), x, -1)]


def forward(c: Chain, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables, the scales' logs, and emissions."""
    e = _emissions(c, x)
    a, logs = np.zeros_like(e), np.zeros(x.shape)
    now = c.pi * e[:, 0]
    for p in range(x.shape[1]):
        if p:
            now = (a[:, p - 1] @ c.t) * e[:, p]
        z = np.maximum(now.sum(axis=1), 1e-300)
        a[:, p], logs[:, p] = now / z[:, None], np.where(p < size, np.log(z), 0)
    return a, logs, e


def posteriors(c: Chain, x: np.ndarray, size: np.ndarray, on_edge: Callable[[np.ndarray], None] | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State posteriors (sequence, position, state), summed edge posteriors (K, K), and log-likelihoods.

    on_edge takes the edge posteriors (sequence, K, K) of each place, the last first. With weights a sequence's edges count so often in the sum.
    """
    a, logs, e = forward(c, x, size)
    b = np.ones(a.shape[::2])
    g, edges = np.zeros_like(a), np.zeros_like(c.t)
    for p in range(x.shape[1] - 1, -1, -1):
        if p + 1 < x.shape[1]:
            inside = (p + 1 < size)[:, None]
            later = e[:, p + 1] * b
            # normalised as a pair, so scales need not be carried
            pair = a[:, p][:, :, None] * c.t * later[:, None, :]
            total = np.maximum(pair.sum(axis=(1, 2)), 1e-300)
            pair = pair / total[:, None, None]
            if on_edge:
                on_edge(pair)
            edges += np.einsum("nab,n->ab", pair, inside[:, 0] * (1.0 if weight is None else weight))
            back = later @ c.t.T
            b = np.where(inside, back / np.maximum(back.max(axis=1, keepdims=True), 1e-300), 1.0)
        now = a[:, p] * b
        g[:, p] = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
    return g, edges, logs.sum(axis=1)


def best_states(c: Chain, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The likeliest states; of equal ones the lowest."""
    with np.errstate(divide="ignore"):
        pi, t, e = np.log(c.pi), np.log(c.t), np.log(_emissions(c, x))
    n, length = x.shape
    back = np.zeros((n, length, len(pi)), np.int64)
    now = pi + e[:, 0]
    for p in range(1, length):
        step = now[:, :, None] + t
        back[:, p] = step.argmax(axis=1)
        new = step.max(axis=1) + e[:, p]
        inside = (p < size)[:, None]
        now = np.where(inside, new, now)
        back[:, p] = np.where(inside, back[:, p], np.arange(len(pi)))
    out = np.zeros((n, length), np.int64)
    at = now.argmax(axis=1)
    for p in range(length - 1, -1, -1):
        out[:, p] = at
        at = back[np.arange(n), p, at]
    return out


def _slices(batch: pa.RecordBatch, cells: int) -> Iterator[pa.RecordBatch]:
    """The rows by length, in parts whose padded arrays have at most so many cells; a longer sequence is a part of its own."""
    size = pc.fill_null(pc.list_value_length(batch["x"]), 0).to_numpy().astype(np.int64)
    order, start = np.argsort(size, kind="stable"), 0
    while start < len(order):
        # lengths rise, so the part's width is its last row's
        width = np.maximum(size[order[start:]], 1) * np.arange(1, len(order) - start + 1)
        n = max(1, int(np.searchsorted(width, cells, side="right")))
        yield batch.take(pa.array(order[start : start + n]))
        start += n


def _over(seq: DataFrame, schema: str, f: Callable[[pa.RecordBatch], pa.RecordBatch], *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from map(f, _slices(batch, CELLS))

    return seq.select(*more, F.col("x").cast("array<int>").alias("x")).mapInArrow(run, schema)


def viterbi(seq: DataFrame, c: Chain) -> DataFrame:
    """(seq_id, h): the best hidden sequence of every row; an empty sequence has none."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, size = _padded(batch)
        h = best_states(c, x, size)
        return pa.record_batch([batch["seq_id"], pa.array([r[:n].tolist() for r, n in zip(h, size, strict=True)], pa.list_(pa.int32()))], ["seq_id", "h"])

    return _over(seq, "seq_id long, h array<int>", f, "seq_id")


def edge_posteriors(seq: DataFrame, c: Chain) -> DataFrame:
    """(seq_id, pos, a, b, p): the probability of states a at pos - 1 and b at pos, for every edge of a sequence."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, size = _padded(batch)
        k, pairs = len(c.pi), []
        posteriors(c, x, size, pairs.append)
        p = np.stack(pairs[::-1], axis=1) if pairs else np.zeros((len(x), 0, k, k))
        row, edge = np.nonzero(np.arange(1, x.shape[1]) < size[:, None])
        ids = batch["seq_id"].take(pa.array(np.repeat(row, k * k)))
        state = np.arange(k, dtype=np.int32)
        places = [np.repeat(edge + 1, k * k).astype(np.int32), np.tile(np.repeat(state, k), len(row)), np.tile(state, k * len(row))]
        return pa.record_batch([ids, *map(pa.array, places), pa.array(p[row, edge].ravel())], ["seq_id", "pos", "a", "b", "p"])

    return _over(seq, "seq_id long, pos int, a int, b int, p double", f, "seq_id")


def state_posteriors(seq: DataFrame, c: Chain) -> DataFrame:
    """(seq_id, pos, state, p)."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, size = _padded(batch)
        g, _, _ = posteriors(c, x, size)
        row, pos = np.nonzero(np.arange(x.shape[1]) < size[:, None])
        k = len(c.pi)
        ids = batch["seq_id"].take(pa.array(np.repeat(row, k)))
        return pa.record_batch([ids, pa.array(np.repeat(pos, k).astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(row))), pa.array(g[row, pos].ravel())], ["seq_id", "pos", "state", "p"])

    return _over(seq, "seq_id long, pos int, state int, p double", f, "seq_id")


def log_likelihood(seq: DataFrame, c: Chain) -> DataFrame:
    """(seq_id, loglik): ln p(x); an empty sequence has 0."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, size = _padded(batch)
        return pa.record_batch([batch["seq_id"], pa.array(forward(c, x, size)[1].sum(axis=1))], ["seq_id", "loglik"])

    return _over(seq, "seq_id long, loglik double", f, "seq_id")


def distinct(seq: DataFrame) -> DataFrame:
    """(x, n): different sequences and how often each comes, written once. Steps of EM then read each once."""
    return saved(seq.groupBy("x").agg(F.count("*").alias("n")), "distinct-sequences")


def expected_counts(seq: DataFrame, c: Chain, weight: str | None = None) -> DataFrame:
    """(kind, i, j, v): the sums over sequences of pi, T and O counts, and the log-likelihood (kind L); a sequence counts as often as its weight says."""
    k, d = c.o.shape
    cells = [("pi", i, 0) for i in range(k)] + [("T", i, j) for i in range(k) for j in range(k)] + [("O", i, j) for i in range(k) for j in range(d)] + [("L", 0, 0)]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, size = _padded(batch)
        n = batch["n"].to_numpy()
        g, edges, ll = posteriors(c, x, size, weight=n)
        g *= n[:, None, None]
        inside = (np.arange(x.shape[1]) < size[:, None]) & (x >= 0) & (x < d)
        o = np.zeros((d, k))
        np.add.at(o, x[inside], g[inside])
        values = np.concatenate([g[size > 0, 0].sum(axis=0), edges.ravel(), o.T.ravel(), [(n * ll).sum()]])
        kind, i, j = zip(*cells, strict=True)
        return pa.record_batch([pa.array(kind), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], ["kind", "i", "j", "v"])

    rows = seq.withColumn("n", (F.col(weight) if weight else F.lit(1)).cast("double"))
    return _over(rows, "kind string, i int, j int, v double", f, "n").groupBy("kind", "i", "j").agg(F.sum("v").alias("v"))


def em_step(seq: DataFrame, c: Chain) -> tuple[Chain, float]:
    """One step of Baum-Welch over sequences x (with n: so often each) and the log-likelihood before it. A state that is never met keeps its row."""
    k, d = c.o.shape
    pi, t, o, ll = np.zeros(k), np.zeros((k, k)), np.zeros((k, d)), 0.0
    for r in expected_counts(seq, c, "n" if "n" in seq.columns else None).collect():
        if r.kind == "L":
            ll = r.v
        else:
            {"pi": pi[:, None], "T": t, "O": o}[r.kind][r.i, r.j] = r.v
    rows = lambda n, old: np.where(n.sum(axis=-1, keepdims=True) > 0, n / np.maximum(n.sum(axis=-1, keepdims=True), 1e-300), old)
    return Chain(rows(pi, c.pi), rows(t, c.t), rows(o, c.o)), ll


def fit(seq: DataFrame, start: Chain, steps: int = 10, on_step: Callable[[int, Chain, float], None] | None = None, gain: float = 0.0, metrics: str | None = None) -> tuple[Chain, list[float]]:
    """Repeats em_step() over distinct sequences, until a step gains no more than that part of the log-likelihood. Returns the chain and the log-likelihoods.

    Each step is appended to the Parquet table `metrics` (step, loglik), where one is named, so a run can be watched.
    """
    spark, rows, history = seq.sparkSession, distinct(seq.select("x")), []
    for n in range(steps):
        start, ll = em_step(rows, start)
        history.append(ll)
        if metrics:
            spark.createDataFrame([(n, ll)], "step int, loglik double").coalesce(1).write.mode("append").parquet(metrics)
        if on_step:
            on_step(n, start, ll)
        if gain and n and history[-1] - history[-2] <= gain * abs(history[-2]):
            break
    return start, history
