"""Hidden chains over sequences of any length: chunks of a sequence are worked on by different tasks.

A chunk's effect on the states is a K x K matrix, the product of its transitions and emissions (sums of products for likelihoods and
posteriors, maxima of sums for best paths). Matrices of neighbouring chunks are multiplied up a tree of groups of FAN, and what
comes in from the left and the right goes down the tree again, so no task sees more than one chunk or FAN matrices. Best paths are
traced by the chunks' maps from last state to last state of the chunk before, composed by the same tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.plans.hmm import Chain, _emissions, _padded, _slices
from momenta.sources.scratch import saved

#: Places of a chunk, and chunks (or groups) of a group, a power of two.
CHUNK, FAN = 4096, 64
#: Numbers that a task's padded chunks have at most.
CELLS = 1 << 19
_SHIFT = FAN.bit_length() - 1


def chunks(tokens: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, at, x): runs of `chunk` places of the tokens (seq_id, pos, tok), whose places count from 0; a missing place is left out."""
    rows = tokens.select("seq_id", F.floor(F.col("pos") / chunk).cast("long").alias("at"), F.struct("pos", F.col("tok").cast("int").alias("tok")).alias("p"))
    rows = rows.groupBy("seq_id", "at").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return saved(rows.select("seq_id", "at", F.transform("p", lambda p: p["tok"]).alias("x")), "chunks")


def _rows(f: Callable[[pa.RecordBatch], Iterator[tuple]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                for part in _slices(batch, CELLS) if "x" in batch.schema.names else [batch]:
                    yield pa.record_batch(f(part), schema=schema)

    return run


_NODE = pa.schema([("seq_id", pa.int64()), ("at", pa.int64()), ("v", pa.list_(pa.float64()))])


def _node(seq: pa.Array, at: pa.Array, v: np.ndarray) -> list:
    flat = pa.array(np.ascontiguousarray(v, float).ravel())
    return [seq, at, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), flat)]


def _matrix_of(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def _groups(level: DataFrame) -> DataFrame:
    up = F.shiftright("at", _SHIFT).alias("up")
    return level.groupBy("seq_id", up).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("kids"))


def climb(leaves: DataFrame, product: Callable[[np.ndarray], np.ndarray]) -> list[DataFrame]:
    """Levels of (seq_id, at, v), the leaves first: product() takes the values of a group in order, as rows. The last level has one row a sequence."""
    levels = [leaves]
    last = leaves.agg(F.max("at")).first()[0] or 0

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = [product(np.array([k["v"] for k in kids], float)) for kids in batch["kids"].to_pylist()]
                yield pa.record_batch(_node(batch["seq_id"], batch["up"], np.stack(v)), schema=_NODE)

    while last:
        levels.append(saved(_groups(levels[-1]).mapInArrow(join, "seq_id long, at long, v array<double>"), "level"))
        last >>= _SHIFT
    return levels


def descend(levels: list[DataFrame], top: DataFrame, hand: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(seq_id, at, v): what each leaf is handed; hand(values of a group in order, what the group was handed) gives a row for each member."""
    handed = top

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, kids, v in zip(batch["seq_id"].to_pylist(), batch["kids"].to_pylist(), batch["handed"].to_pylist(), strict=True):
                out = hand(np.array([k["v"] for k in kids], float), np.array(v, float))
                yield pa.record_batch(_node(pa.array([seq] * len(kids), pa.int64()), pa.array([k["at"] for k in kids], pa.int64()), out), schema=_NODE)

    for level in reversed(levels[:-1]):
        above = handed.select("seq_id", F.col("at").alias("up"), F.col("v").alias("handed"))
        handed = saved(_groups(level).join(above, ["seq_id", "up"]).mapInArrow(give, "seq_id long, at long, v array<double>"), "handed")
    return handed


def _start_and_steps(c: Chain, batch: pa.RecordBatch):
    """Padded symbols, lengths, which chunks begin their sequence, emissions."""
    x, size = _padded(batch)
    return x, size, batch["at"].to_numpy() == 0, _emissions(c, x)


def _sum_matrices(c: Chain, part: pa.RecordBatch) -> np.ndarray:
    x, size, first, e = _start_and_steps(c, part)
    k = len(c.pi)
    m = np.broadcast_to(np.eye(k), (len(x), k, k))
    for p in range(x.shape[1]):
        step = m @ c.t if p else np.where(first[:, None, None], c.pi, m @ c.t)
        step = step * e[:, p][:, None, :]
        step = step / np.maximum(step.max(axis=(1, 2), keepdims=True), 1e-300)
        m = np.where((p < size)[:, None, None], step, m)
    return m.reshape(len(x), -1)


def _normal(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(v.sum(axis=-1, keepdims=True), 1e-300)


def _sum_product(v: np.ndarray) -> np.ndarray:
    k = int(np.sqrt(v.shape[1]))
    out = np.eye(k)
    for m in v.reshape(-1, k, k):
        out = out @ m
        out = out / np.maximum(out.max(), 1e-300)
    return out.ravel()


def _hand_sums(v: np.ndarray, handed: np.ndarray) -> np.ndarray:
    """Row by row: the states' weights before a member, and the weights of what comes behind it by state."""
    k = len(handed) // 2
    m = v.reshape(-1, k, k)
    before, behind = np.empty((len(m), k)), np.empty((len(m), k))
    now = handed[:k]
    for i in range(len(m)):
        before[i], now = now, _normal(now @ m[i])
    now = handed[k:]
    for i in range(len(m) - 1, -1, -1):
        behind[i], now = now, _normal(m[i] @ now)
    return np.concatenate([before, behind], axis=1)


def _with_sums(rows: DataFrame, c: Chain) -> DataFrame:
    """Chunks with v: state weights before them and behind them."""
    k = len(c.pi)
    ones = F.array(*[F.lit(1.0 / k)] * (2 * k))
    if not (rows.agg(F.max("at")).first()[0] or 0):
        return rows.withColumn("v", ones)
    matrices = saved(rows.mapInArrow(_rows(lambda part: _node(part["seq_id"], part["at"], _sum_matrices(c, part)), _NODE), "seq_id long, at long, v array<double>"), "matrices")
    levels = climb(matrices, _sum_product)
    return rows.join(descend(levels, levels[-1].select("seq_id", "at", ones.alias("v")), _hand_sums), ["seq_id", "at"])


def _forward(c: Chain, part: pa.RecordBatch):
    x, size, first, e = _start_and_steps(c, part)
    v, k = _matrix_of(part["v"], len(x)), len(c.pi)
    a, logs = np.zeros_like(e), np.zeros(x.shape)
    for p in range(x.shape[1]):
        now = (a[:, p - 1] @ c.t if p else np.where(first[:, None], c.pi, _normal(v[:, :k]) @ c.t)) * e[:, p]
        z = np.maximum(now.sum(axis=1), 1e-300)
        a[:, p], logs[:, p] = now / z[:, None], np.where(p < size, np.log(z), 0.0)
    return x, size, e, v, a, logs


def log_likelihood(tokens: DataFrame, c: Chain, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, loglik) of tokens (seq_id, pos, tok)."""

    def f(part: pa.RecordBatch) -> list:
        return [part["seq_id"], pa.array(_forward(c, part)[5].sum(axis=1))]

    schema = pa.schema([("seq_id", pa.int64()), ("loglik", pa.float64())])
    return _with_sums(chunks(tokens, chunk), c).mapInArrow(_rows(f, schema), "seq_id long, loglik double").groupBy("seq_id").agg(F.sum("loglik").alias("loglik"))


def state_posteriors(tokens: DataFrame, c: Chain, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, pos, state, p) of tokens (seq_id, pos, tok); places count without gaps."""
    k = len(c.pi)

    def f(part: pa.RecordBatch) -> list:
        x, size, e, v, a, _ = _forward(c, part)
        g, b = np.empty_like(a), v[:, k:]
        for p in range(x.shape[1] - 1, -1, -1):
            if p + 1 < x.shape[1]:
                b = np.where((p + 1 < size)[:, None], _normal((e[:, p + 1] * b) @ c.t.T), v[:, k:])
            g[:, p] = _normal(a[:, p] * b)
        row, pos = np.nonzero(np.arange(x.shape[1]) < size[:, None])
        start = part["at"].to_numpy()[row] * chunk
        ids = part["seq_id"].take(pa.array(np.repeat(row, k)))
        return [ids, pa.array(np.repeat(start + pos, k).astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(row))), pa.array(g[row, pos].ravel())]

    schema = pa.schema([("seq_id", pa.int64()), ("pos", pa.int32()), ("state", pa.int32()), ("p", pa.float64())])
    return _with_sums(chunks(tokens, chunk), c).mapInArrow(_rows(f, schema), "seq_id long, pos int, state int, p double")


# ---- best paths


def _logs(c: Chain) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(c.pi), np.log(c.t)


def _log_emissions(e: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(e)


def _lowered(v: np.ndarray, axis) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    return v - np.where(np.isfinite(top), top, 0.0)


def _max_matrices(c: Chain, part: pa.RecordBatch) -> np.ndarray:
    x, size, first, e = _start_and_steps(c, part)
    (pi, t), e, k = _logs(c), _log_emissions(e), len(c.pi)
    m = np.broadcast_to(np.where(np.eye(k) > 0, 0.0, -np.inf), (len(x), k, k))
    for p in range(x.shape[1]):
        step = (m[:, :, :, None] + t).max(axis=2)
        step = (step if p else np.where(first[:, None, None], pi, step)) + e[:, p][:, None, :]
        m = np.where((p < size)[:, None, None], _lowered(step, (1, 2)), m)
    return m.reshape(len(x), -1)


def _max_product(v: np.ndarray) -> np.ndarray:
    k = int(np.sqrt(v.shape[1]))
    out = np.where(np.eye(k) > 0, 0.0, -np.inf)
    for m in v.reshape(-1, k, k):
        out = _lowered((out[:, :, None] + m).max(axis=1), (0, 1))
    return out.ravel()


def _hand_scores(v: np.ndarray, handed: np.ndarray) -> np.ndarray:
    k = len(handed)
    out, now = np.empty((len(v), k)), handed
    for i, m in enumerate(v.reshape(-1, k, k)):
        out[i], now = now, _lowered((now[:, None] + m).max(axis=0), 0)
    return out


def _hand_ends(v: np.ndarray, handed: np.ndarray) -> np.ndarray:
    """The last states of members: the last member's is the group's, the others come through the maps of those behind."""
    out, now = np.empty((len(v), 1)), handed
    for i in range(len(v) - 1, -1, -1):
        out[i], now = now, v[i][int(now[0])][None]
    return out


def _composed(v: np.ndarray) -> np.ndarray:
    now = np.arange(v.shape[1])
    for m in v[::-1]:
        now = m[now].astype(int)
    return now.astype(float)


def _trace(c: Chain, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, lengths, pointers back, last scores, and scores before the chunk, of which the pointers at place 0 choose."""
    x, size, first, e = _start_and_steps(c, part)
    (pi, t), e = _logs(c), _log_emissions(e)
    before = _matrix_of(part["v"], len(x))
    back = np.zeros(e.shape, np.int64)
    now = before
    for p in range(x.shape[1]):
        step = now[:, :, None] + t
        new = (step.max(axis=1) if p else np.where(first[:, None], pi, step.max(axis=1))) + e[:, p]
        inside = (p < size)[:, None]
        back[:, p] = np.where(inside, step.argmax(axis=1), np.arange(len(pi)))
        now = np.where(inside, _lowered(new, 1), now)
    return x, size, back, now, before


def viterbi(tokens: DataFrame, c: Chain, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, pos, h): the best states of tokens (seq_id, pos, tok); of equal paths that with the lowest last state, then the lowest one before, and so on."""
    k, node = len(c.pi), "seq_id long, at long, v array<double>"
    rows = chunks(tokens, chunk)
    zeros = F.array(*[F.lit(0.0)] * k)
    alone = not (rows.agg(F.max("at")).first()[0] or 0)
    if alone:
        scored, ends = rows.withColumn("v", zeros), None
    else:
        matrices = saved(rows.mapInArrow(_rows(lambda part: _node(part["seq_id"], part["at"], _max_matrices(c, part)), _NODE), node), "matrices")
        levels = climb(matrices, _max_product)
        scored = saved(rows.join(descend(levels, levels[-1].select("seq_id", "at", zeros.alias("v")), _hand_scores), ["seq_id", "at"]), "scored")

        def maps(part: pa.RecordBatch) -> list:
            _, size, back, now, _ = _trace(c, part)
            state = np.tile(np.arange(k), (len(size), 1))
            for p in range(back.shape[1] - 1, -1, -1):
                state = np.take_along_axis(back[:, p], state, axis=1)
            return _node(part["seq_id"], part["at"], state)

        steps = climb(saved(scored.mapInArrow(_rows(maps, _NODE), node), "maps"), _composed)
        # every row of a whole sequence's matrix is its last scores
        final = levels[-1].select("seq_id", "at", F.slice("v", 1, k).alias("s"))
        best = F.array((F.array_position("s", F.array_max("s")) - 1).cast("double"))
        ends = descend(steps, final.select("seq_id", "at", best.alias("v")), _hand_ends).select("seq_id", "at", F.col("v")[0].cast("int").alias("end"))
        scored = scored.join(ends, ["seq_id", "at"])

    def f(part: pa.RecordBatch) -> list:
        x, size, back, now, _ = _trace(c, part)
        state = now.argmax(axis=1) if alone else part["end"].to_numpy().astype(np.int64)
        h, n = np.zeros(x.shape, np.int32), np.arange(len(x))
        for p in range(x.shape[1] - 1, -1, -1):
            h[:, p] = state
            state = back[n, p, state] if p else state
        row, pos = np.nonzero(np.arange(x.shape[1]) < size[:, None])
        return [part["seq_id"].take(pa.array(row)), pa.array((part["at"].to_numpy()[row] * chunk + pos).astype(np.int32)), pa.array(h[row, pos])]

    schema = pa.schema([("seq_id", pa.int64()), ("pos", pa.int32()), ("h", pa.int32())])
    return scored.mapInArrow(_rows(f, schema), "seq_id long, pos int, h int")
