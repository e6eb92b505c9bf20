"""Regressions from sufficient statistics, low-rank refinement, clusters by mutual information and log-linear fitting."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.functions import vectors as V
from momenta.operators import mixtures as X
from momenta.operators import moments as M
from momenta.operators import ngrams as N
from momenta.plans.small import soft_threshold
from momenta.sources.scratch import saved


#: Cells of a Gram matrix that are held on the driver at most.
MOST_CELLS = 1 << 21


def statistics(samples: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """E[x x'] and E[x y] of (y, x) in one pass."""
    g = M.collect_matrix(X.normal_equations(samples), d, d + 1)
    return g[:, :d], g[:, d]


def ridge(samples: DataFrame, d: int, penalty: float = 0.0) -> np.ndarray:
    """The coefficients of (E[x x'] + penalty I) b = E[x y]."""
    a, b = statistics(samples, d)
    return np.linalg.lstsq(a + penalty * np.eye(d), b, rcond=None)[0]


def white(samples: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """pinv(X) y and pinv(X) X of the sample's rows X: the normal equations' solution, and the projection on the directions that X has."""
    a, b = statistics(samples, d)
    inverse = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
    return inverse @ b, inverse @ a


def direction(points: DataFrame, d: int) -> DataFrame:
    """(id, v): points (id, x, y) projected on S^-1 s_xy, the direction that goes with y most."""
    rows = points.select("id", F.col("x").alias("x1"), F.concat("x", F.array("y")).alias("x2"))
    s = M.collect_matrix(M.covariance(rows), d, d + 1)
    w = np.linalg.lstsq(s[:, :d], s[:, d], rcond=None)[0]
    return points.select("id", V.dot(F.col("x"), F.array(*map(F.lit, map(float, w)))).alias("v"))


def prox_low_rank(samples: DataFrame, d: int, degree: int, start: np.ndarray | None = None, penalty: float = 0.1, rate: float | None = None, steps: int = 50, schedule: str = "const") -> tuple[np.ndarray, list[float]]:
    """A symmetric matrix (degree 2) or tensor (3) B of low rank for y = B(x, .., x): gradient steps on the mean square, then singular values lowered.

    The gradient is linear in B, so one pass gives all that the steps need: E[z z'] and E[z y] of the products z.
    schedule is const, 1/t or 1/sqrt(t). Returns B and the losses, each with the penalty.
    """
    x = F.col("x")
    z = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    if degree == 3:
        z = F.flatten(F.transform(x, lambda a: F.flatten(F.transform(x, lambda b: F.transform(x, lambda c: a * b * c)))))
    size = d**degree
    if size**2 > MOST_CELLS:
        raise ValueError(f"{size} products of {d} coordinates have too many pairs for the driver")
    rows = samples.select(z.alias("x"), "y")
    a, b = statistics(rows, size)
    yy = rows.agg(F.avg(F.col("y") * F.col("y"))).first()[0]
    rate = rate or 1 / max(np.linalg.eigvalsh(a)[-1], 1e-12)
    value = np.zeros(size) if start is None else start.ravel().copy()
    losses = []
    for t in range(1, steps + 1):
        eta = rate / {"const": 1, "1/t": t, "1/sqrt(t)": t**0.5}[schedule]
        m = soft_threshold((value - eta * (a @ value - b)).reshape(d, -1), eta * penalty)
        if degree == 2:
            m = (m + m.T) / 2
        else:
            c = m.reshape(d, d, d)
            m = sum(c.transpose(o) for o in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))) / 6
        value = m.ravel()
        losses.append(float((yy - 2 * b @ value + value @ a @ value) / 2 + penalty * np.linalg.svd(value.reshape(d, -1), compute_uv=False).sum()))
    return value.reshape((d,) * degree), losses


def mutual_information_costs(bigrams: DataFrame) -> DataFrame:
    """(c1, c2, q): each cell's share of the mutual information of neighbouring clusters, from counts (c1, c2, n)."""
    p = N.share(bigrams, "n").select("c1", "c2", "p")
    left, right = p.groupBy("c1").agg(F.sum("p").alias("l")), p.groupBy("c2").agg(F.sum("p").alias("r"))
    q = F.col("p") * F.ln(F.col("p") / (F.col("l") * F.col("r")))
    return p.join(left, "c1").join(right, "c2").select("c1", "c2", q.alias("q"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def merge_losses(p: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """(a, b): the mutual information of p (cluster, next cluster) that merging a and b loses; infinite unless a < b.

    row[a, b] is the sum over j of f(p[a, j] + p[b, j]) with f(x) = x ln x, col the same over columns; all else is a few terms a pair.
    """
    f = _xlogx(p)
    d, sums, left, right = np.diag(f), (f.sum(axis=1), f.sum(axis=0)), p.sum(axis=1), p.sum(axis=0)
    pair = lambda v: v[:, None] + v[None, :]
    own = np.diag(p)[:, None]
    inner = pair(d) + f + f.T
    rows, cols = _xlogx(own + p.T), _xlogx(own + p)
    gain = row - pair(sums[0]) - rows - rows.T + inner + col - pair(sums[1]) - cols - cols.T + inner
    gain += _xlogx(pair(np.diag(p)) + p + p.T) - inner
    for m in (left, right):
        gain -= _xlogx(pair(m)) - pair(_xlogx(m))
    return np.where(np.triu(np.ones_like(p), 1) > 0, -gain, np.inf)


def _sums_with(p: np.ndarray, a: int) -> np.ndarray:
    return _xlogx(p[a] + p).sum(axis=1)


def merge_down(p: np.ndarray, k: int) -> list[list[int]]:
    """Members of the k clusters left when the pair of least loss (of equal ones the first) is merged again and again.

    The tables behind the losses are kept: a merge changes one term of every other pair, and only the merged cluster's row is summed anew,
    so a merge costs the square of the number of clusters.
    """
    groups = [[i] for i in range(len(p))]
    row = np.stack([_sums_with(p, a) for a in range(len(p))]) if len(p) else np.zeros((0, 0))
    col = np.stack([_sums_with(p.T, a) for a in range(len(p))]) if len(p) else np.zeros((0, 0))
    while len(groups) > k:
        loss = np.round(merge_losses(p, row, col), 12)
        a, b = np.unravel_index(loss.argmin(), loss.shape)
        for table, m in ((row, p), (col, p.T)):
            x, y = m[:, a], m[:, b]
            table += _xlogx(np.add.outer(x + y, x + y)) - _xlogx(np.add.outer(x, x)) - _xlogx(np.add.outer(y, y))
        p = p.copy()
        p[a] += p[b]
        p[:, a] += p[:, b]
        p, row, col = (np.delete(np.delete(m, b, 0), b, 1) for m in (p, row, col))
        for table, m in ((row, p), (col, p.T)):
            table[a] = table[:, a] = _sums_with(m, a)
        groups[a] += groups.pop(b)
    return groups


#: Words that begin as clusters of their own, at most: their table is held on the driver.
MOST_WORDS = 1400


def bigram_table(bigrams: DataFrame, words: list[int]) -> np.ndarray:
    """Shares of neighbours (c1, c2, n) among `words`, in this order, and all other words together as the last: one aggregation, (words + 1)^2 cells at most."""
    if len(words) > MOST_WORDS:
        raise ValueError(f"{len(words)} words have too many pairs for the driver: {MOST_WORDS} at most")
    known = bigrams.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words)], "tok int, at int")
    place = lambda c, name: known.select(F.col("tok").alias(c), F.col("at").alias(name))
    rows = bigrams.join(F.broadcast(place("c1", "l")), "c1", "left").join(F.broadcast(place("c2", "r")), "c2", "left").fillna(len(words), ["l", "r"])
    p = np.zeros((len(words) + 1,) * 2)
    for r in rows.groupBy("l", "r").agg(F.sum("n").alias("n")).collect():
        p[r.l, r.r] = r.n
    return p / max(p.sum(), 1.0)


def top_word_clusters(bigrams: DataFrame, words: list[int], k: int) -> dict[int | None, int]:
    """word -> cluster (numbered by first word): `words` begin as clusters of their own and all others as one more (key None, if there are any), and merge by least loss of
    mutual information down to k. The bigrams are read once."""
    p = bigram_table(bigrams, words)
    if not (p[-1].any() or p[:, -1].any()):
        p = p[:-1, :-1]
    names = [*words, None]
    return {names[i]: c for c, members in enumerate(sorted(merge_down(p, k), key=min)) for i in members}


def brown_clusters(bigrams: DataFrame, order: list[int], k: int, batch: int = 64) -> dict[int, int]:
    """word -> cluster: words (in `order`, most frequent first) come in one by one, and the two clusters whose merging loses least mutual information merge.

    bigrams is (c1, c2, n) over words. The words by words table stays in Spark: for each batch of words it is summed to
    the clusters so far and the batch's words, (k + batch)^2 cells at most, which is all that the driver holds besides
    the words' clusters. top_word_clusters() reads the bigrams once.
    """
    spark = bigrams.sparkSession
    place = lambda df, c, name: df.select(F.col("tok").alias(c), F.col("c").alias(name))
    words = spark.createDataFrame([(w, 0) for w in order], "tok int, c int")
    inside = bigrams.join(place(words, "c1", "_l"), "c1").join(place(words, "c2", "_r"), "c2").select("c1", "c2", "n")
    inside = saved(inside, "bigrams")
    total = inside.agg(F.sum("n")).first()[0] or 1
    cluster: dict[int, int] = {}
    for at in range(0, len(order), batch):
        new, n = order[at : at + batch], max(cluster.values(), default=-1) + 1
        known = spark.createDataFrame([*cluster.items(), *((w, n + i) for i, w in enumerate(new))], "tok int, c int")
        sums = inside.join(place(known, "c1", "l"), "c1").join(place(known, "c2", "r"), "c2").groupBy("l", "r").agg(F.sum("n").alias("n"))
        p = np.zeros((n + len(new),) * 2)
        for r in sums.collect():
            p[r.l, r.r] = r.n / total
        groups = [[c] for c in range(n)]
        for c in range(n, n + len(new)):
            groups.append([c])
            if len(groups) > k:
                m = np.array([[p[np.ix_(a, b)].sum() for b in groups] for a in groups])
                groups = [[i for g in members for i in groups[g]] for members in merge_down(m, k)]
        now = {c: g for g, members in enumerate(groups) for c in members}
        cluster = {w: now[c] for w, c in cluster.items()} | {w: now[n + i] for i, w in enumerate(new)}
    return cluster


def loglinear_em(expected: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]], start: np.ndarray, steps: int = 30, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, list[float]]:
    """Gradient EM for an exponential family with hidden states: expected(theta) gives the expected features with the data clamped, without, and the log-likelihood.

    The first is one aggregation over distinct sequences; steps go up the penalised likelihood and are halved when it falls.
    """
    theta, history = start.copy(), []
    clamped, free, ll = expected(theta)
    score = ll - penalty * theta @ theta / 2
    for _ in range(steps):
        history.append(score)
        g = clamped - free - penalty * theta
        while True:
            new = theta + rate * g
            c, f, l = expected(new)  # noqa: E741
            s = l - penalty * new @ new / 2
            if s >= score or rate < 1e-8:
                break
            rate /= 2
        theta, clamped, free, score, rate = new, c, f, s, rate * 1.5
    return theta, history


def bag_expectations(bags: DataFrame, theta: np.ndarray, k: int, d: int, sizes: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected features of a log-linear mixture of independent symbols over distinct bags (x ARRAY<INT>, n) of one length, clamped and free, and the log-likelihood a bag: weights h (k), then (h, x) (k d)."""
    from momenta.plans.em import categorical_step

    total, length = sizes or bags.agg(F.sum("n"), F.max(F.size("x"))).first()
    w, o = theta[:k], theta[k:].reshape(k, d)
    norm = np.log(np.exp(o).sum(axis=1))
    joint = w + length * norm
    pw = np.exp(joint - np.logaddexp.reduce(joint))
    po = np.exp(o - norm[:, None])
    nw, no, ll = categorical_step(bags, pw, po)
    clamped = np.concatenate([nw, (nw[:, None] * no * length).ravel()])
    free = np.concatenate([pw, (pw[:, None] * po * length).ravel()])
    return clamped, free, ll / total


def bag_features(bags: DataFrame, k: int, d: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]]:
    """bag_expectations() of a table that is written once."""
    bags = saved(bags, "bags")
    sizes = tuple(bags.agg(F.sum("n"), F.max(F.size("x"))).first())
    return lambda theta: bag_expectations(bags, theta, k, d, sizes)
