"""Composite likelihood of grids over blocks of cells: likelihood, EM sums and information of the blocks' joint state distribution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.plans.protocols import partial_sums

#: Joint states of a block, at most: the information matrix is held by each task.
MOST_STATES = 1 << 10
SEEN = 2
#: Numbers of a task's likelihood matrix at once.
CELLS = 1 << 22


def blocks(grid: DataFrame, cells: list[tuple[int, int]], cols: int = 2) -> DataFrame:
    """(x, n): the SEEN symbols of each of `cells` ((0 or 1 rows down, column), in this order) for every row of grid (seq_id, r, c, d, tok) that has them all, counted.

    The symbols of a row are gathered once; rows meet those below by one join on (sequence, row)."""
    at = [(c, s) for c in range(cols) for s in range(SEEN)]
    row = grid.groupBy("seq_id", "r").agg(F.array(*(F.max(F.when((F.col("c") == c) & (F.col("d") == s), F.col("tok"))) for c, s in at)).alias("row"))
    if any(r for r, _ in cells):
        below = row.select("seq_id", (F.col("r") - 1).alias("r"), F.col("row").alias("below"))
        row = row.join(below, ["seq_id", "r"])
    x = F.array(*(F.col("below" if r else "row")[c * SEEN + s] for r, c in cells for s in range(SEEN)))
    return row.select(x.alias("x")).where(~F.exists("x", lambda v: v.isNull())).groupBy("x").agg(F.count("*").alias("n"))


def _likelihoods(batch: pa.RecordBatch, o: np.ndarray) -> np.ndarray:
    """(block, joint state): the product of the cells' likelihoods; the first cell's state counts most."""
    x = np.array(batch["x"].to_pylist(), np.int64)
    g = np.ones((len(x), 1))
    for c in range(0, x.shape[1], SEEN):
        cell = np.prod([o[:, x[:, c + s]].T for s in range(SEEN)], axis=0)
        g = (g[:, :, None] * cell[:, None, :]).reshape(len(x), -1)
    return g


def block_sums(counts: DataFrame, p: np.ndarray, o: np.ndarray, information: bool = True) -> tuple[float, np.ndarray, np.ndarray | None]:
    """The log-likelihood of blocks (x, n) under joint states p and emissions o (state, symbol), the expected number of blocks in each
    joint state, and the information matrix: the sum of n g g' / q^2, g being a block's likelihoods and q = p g.

    A block costs one vector of joint states, not their square as rows; a task adds up one matrix, and only tasks' sums are exchanged."""
    states = len(p)
    if states > MOST_STATES:
        raise ValueError(f"{states} joint states are more than {MOST_STATES}")

    def update(batch: pa.RecordBatch) -> np.ndarray:
        out, step = 0.0, max(1, CELLS // states)
        for start in range(0, len(batch), step):
            part = batch.slice(start, step)
            g, n = _likelihoods(part, o), part["n"].to_numpy().astype(float)
            q = g @ p
            sums = [np.array([(n * np.log(q)).sum()]), (g * (n / q)[:, None]).sum(axis=0) * p]
            out = out + np.concatenate([*sums, ((g * (n / q**2)[:, None]).T @ g).ravel()] if information else sums)
        return out

    found = np.zeros(1 + states + (states * states if information else 0))
    for r in partial_sums(counts.select("x", "n"), update).collect():
        found[r.i] = r.v
    return float(found[0]), found[1 : 1 + states], found[1 + states :].reshape(states, states) if information else None


def fit_blocks(counts: DataFrame, p: np.ndarray, o: np.ndarray, steps: int) -> tuple[np.ndarray, list[float]]:
    """The joint state distribution after steps of EM with fixed emissions, and the log-likelihood before each."""
    history = []
    for _ in range(steps):
        ll, expected, _ = block_sums(counts, p, o, information=False)
        history.append(ll)
        p = expected / expected.sum()
    return p, history
