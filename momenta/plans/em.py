"""EM loops: each step is one aggregation over the rows; the parameters stay on the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momenta.functions import vectors as V
from momenta.operators import mixtures as X
from momenta.sources.row_files import RowFiles, write_rows
from momenta.sources.scratch import saved

OnStep = Callable[[int, object, float], None]


def kmeans_pp(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(k, m): k centres of points (id, x). Each further one is drawn with odds of its squared distance to the nearest so far.

    A draw takes the point with the greatest log(u) / d^2, u from a hash of id: such odds without any running sum.
    """
    spark = points.sparkSession
    picked = [_first_point(points, seed)]
    for n in range(1, k):
        centres = spark.createDataFrame([(i, m) for i, m in enumerate(picked)], "k int, m array<double>")
        u = (X.dealt(seed + n, "id") + 0.5) / float(1 << 28)
        near = X.nearest(points, centres, "x").where("dist > 0")
        top = near.orderBy((F.ln(u) / (F.col("dist") * F.col("dist"))).desc(), "id").select("x").first()
        if top is None:
            break
        picked.append(list(top.x))
    return spark.createDataFrame([(i, m) for i, m in enumerate(picked)], "k int, m array<double>")


def least_distances(state: DataFrame, centres: list[list[float]]) -> DataFrame:
    """state (id, x, d2) with d2 lowered to the squared distance from the nearest of the new centres, written: earlier ones are in it already."""
    new = state.sparkSession.createDataFrame(list(enumerate(centres)), "k int, m array<double>")
    found = X.nearest(state, new, "x", "d2")
    return saved(found.select("id", "x", F.least("d2", F.col("dist") * F.col("dist")).alias("d2")), "distances")


def round_odds(state: DataFrame, most: float) -> DataFrame:
    """(id, x, d2, p): the odds that a round takes each point: in proportion to d2, and `most` points in the mean."""
    total = state.agg(F.sum("d2").alias("total"))
    return state.crossJoin(F.broadcast(total)).withColumn("p", F.least(F.lit(1.0), most * F.col("d2") / F.greatest("total", F.lit(1e-300)))).drop("total")


def _first_point(points: DataFrame, seed: int) -> list[float]:
    return list(points.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").select("x").first().x)


def _reduced(c: np.ndarray, n: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    """k centres of weighted candidates (a few hundred): drawn by weight times squared distance, then moved to their members' means."""
    rng = np.random.default_rng(seed)
    picked, d2 = [], np.ones(len(c))
    for _ in range(min(k, len(c))):
        odds = n * d2
        if odds.sum() <= 0:
            break
        picked.append(int(rng.choice(len(c), p=odds / odds.sum())))
        near = ((c - c[picked[-1]]) ** 2).sum(axis=1)
        d2 = near if len(picked) == 1 else np.minimum(d2, near)
    m = c[picked]
    for _ in range(steps):
        owner = ((c[:, None] - m) ** 2).sum(axis=2).argmin(axis=1)
        m = np.array([np.average(c[owner == i], axis=0, weights=n[owner == i]) if n[owner == i].sum() else m[i] for i in range(len(m))])
    return m


def kmeans_parallel(points: DataFrame, k: int, seed: int = 0, rounds: int = 5, oversample: float = 2.0) -> tuple[DataFrame, float]:
    """((k, m, w), variance) to start a mixture of points (id, x): k centres with uniform weights, and the mean squared distance from them a coordinate.

    A few rounds take some oversample * k points each by odds of their squared distance to the nearest taken before, which is carried in the row; so the
    rows are read `rounds` times, not k times. Taken points, weighted by how many points are nearest to them, are reduced to k on the driver.
    """
    spark = points.sparkSession
    taken = [_first_point(points, seed)]
    state = points.select("id", "x", F.lit(float("inf")).alias("d2"))
    new = taken
    for n in range(rounds):
        state = least_distances(state, new)
        u = (X.dealt(seed + n + 1, "id") + 0.5) / float(1 << 28)
        new = [list(r.x) for r in round_odds(state, oversample * k).where(u < F.col("p")).select("x").distinct().collect()]
        taken = taken + new
        if not new and n + 1 < rounds and not state.where("d2 > 0").limit(1).count():
            break
    candidates = spark.createDataFrame(list(enumerate(taken)), "k int, m array<double>")
    weight = {r.k: r["count"] for r in X.nearest(points, candidates).groupBy("k").count().collect()}
    m = _reduced(np.array(taken), np.array([weight.get(i, 0) for i in range(len(taken))], float), k, seed)
    centres = spark.createDataFrame([(i, v.tolist(), 1.0 / len(m)) for i, v in enumerate(m)], "k int, m array<double>, w double")
    spread = X.nearest(points, centres).agg(F.avg(F.col("dist") * F.col("dist"))).first()[0]
    return centres, float(spread / m.shape[1])


def _settled(history: list[float], gain: float) -> bool:
    """Whether the last step raised the log-likelihood by no more than that part of it."""
    return gain > 0 and len(history) > 1 and history[-1] - history[-2] <= gain * abs(history[-2])


def multiview_step(points: DataFrame, centres: DataFrame, sigmas: list[float], sizes: tuple[int, ...]) -> tuple[DataFrame, list[float]]:
    """((k, w, m), variances): one step of EM over points (id, x1, x2, ...), each view with a variance of its own; weights count one more point."""
    scored = X.multiview_scores(points, centres, sigmas, sizes)
    names = [f"x{v + 1}" for v in range(len(sizes))]
    rows = X.responsibilities(scored).select("k", "r", F.concat(*names).alias("x"))
    r, x = F.col("r"), F.col("x")
    sums = rows.groupBy("k").agg(F.sum(r).alias("n"), F.array(*(F.sum(r * x[i]) for i in range(sum(sizes)))).alias("s"), F.array(*(F.sum(r * x[i] * x[i]) for i in range(sum(sizes)))).alias("q"))
    found = sums.collect()
    total, spread = sum(c.n for c in found), np.zeros(sum(sizes))
    for c in found:
        spread += np.array(c.q) - np.array(c.s) ** 2 / max(c.n, 1e-300)
    cuts = np.cumsum(sizes)[:-1]
    variances = [max(float(part.sum()) / (total * n), 1e-9) for part, n in zip(np.split(spread, cuts), sizes, strict=True)]
    weight = sum(c.n + 1 for c in found)
    rows = [(c.k, float((c.n + 1) / weight), [float(v / max(c.n, 1e-300)) for v in c.s]) for c in found]
    return points.sparkSession.createDataFrame(rows, "k int, w double, m array<double>"), variances


def fit_multiview(points: DataFrame, k: int, sizes: tuple[int, ...], steps: int = 10, seed: int = 0, gain: float = 0.0) -> tuple[DataFrame, list[float], list[float]]:
    """((k, w, m), variances, log-likelihoods) of a mixture over views, until a step gains less than that part of the log-likelihood."""
    points = points.persist()
    try:
        joined = points.select("id", F.concat(*(f"x{v + 1}" for v in range(len(sizes)))).alias("x"))
        centres = kmeans_pp(joined, k, seed).withColumn("w", F.lit(1.0 / k))
        spread = X.nearest(joined, centres).agg(F.avg(F.col("dist") * F.col("dist")) / sum(sizes)).first()[0] or 1.0
        sigmas, history = [spread] * len(sizes), []
        for _ in range(steps):
            history.append(X.loglik(X.multiview_scores(points, centres, sigmas, sizes)).first().loglik)
            if _settled(history, gain):
                break
            centres, sigmas = multiview_step(points, centres, sigmas, sizes)
        return centres, sigmas, history
    finally:
        points.unpersist()


def fit_gmm(points: DataFrame, k: int, steps: int = 10, seed: int = 0, on_step: OnStep | None = None, gain: float = 0.0) -> tuple[DataFrame, float, list[float]]:
    """((k, m, w), variance, log-likelihoods) of a mixture of spherical Gaussians over points (id, x), until a step gains less than that part of the log-likelihood."""
    spark, points = points.sparkSession, points.select("id", "x").persist()
    try:
        centres = kmeans_pp(points, k, seed)
        n = centres.count()
        centres = centres.withColumn("w", F.lit(1.0 / n))
        d = len(points.select("x").first().x)
        sigma2 = X.nearest(points, centres).agg(F.avg(F.col("dist") * F.col("dist")) / d).first()[0] or 1.0
        history = []
        for step in range(steps):
            history.append(X.loglik(X.gaussian_scores(points, centres, sigma2)).first().loglik)
            if _settled(history, gain):
                break
            rows = X.gmm_step(points, centres, sigma2, d).collect()
            centres = spark.createDataFrame([(r.k, list(r.m), r.w) for r in rows], "k int, m array<double>, w double")
            sigma2 = max(sum(r.n * r["var"] for r in rows) / sum(r.n for r in rows), 1e-9)
            if on_step:
                on_step(step, rows, history[-1])
        return centres, sigma2, history
    finally:
        points.unpersist()


def regression_step(spark: SparkSession, rows: RowFiles, b: np.ndarray, w: np.ndarray, sigma2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The weighted Gram matrices of rows (x, y) by component (k, d + 1, d + 1), the sums of responsibilities and the log-likelihood, in one pass."""
    k, d = b.shape
    const = (np.log(w) - 0.5 * np.log(2 * np.pi * sigma2))[:, None]

    def update(z: np.ndarray) -> np.ndarray:
        lp = z[d] - b @ z[:d]
        lp *= lp
        lp *= -0.5 / sigma2
        lp += const
        top = lp.max(axis=0)
        lp -= top
        r = np.exp(lp, out=lp)
        total = r.sum(axis=0)
        r /= total
        return np.concatenate([*(((z * r[c]) @ z.T).ravel() for c in range(k)), r.sum(axis=1), [top.sum() + np.log(total).sum()]])

    found = rows.sums(spark, update, k * (d + 1) ** 2 + k + 1)
    return found[: -k - 1].reshape(k, d + 1, d + 1), found[-k - 1 : -1], float(found[-1])


def fit_regressions(df: DataFrame, k: int, steps: int = 10, seed: int = 0, betas: list[list[float]] | None = None, on_step: OnStep | None = None, gain: float = 0.0) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
    """(betas, weights, variance, log-likelihoods) of a mixture of linear regressions over (y, x), until a step gains less than that part of the log-likelihood."""
    df = df.select("y", "x")
    d = len(df.select("x").first().x)
    b = np.array(betas, float) if betas is not None else np.random.default_rng(seed).standard_normal((k, d))
    w, sigma2, history = np.full(k, 1 / k), float(df.agg(F.var_pop("y")).first()[0] or 1.0), []
    rows = write_rows(df.where(F.size("x") == d), *(F.get("x", F.lit(i)) for i in range(d)), F.col("y"))
    for step in range(steps):
        g, n, loglik = regression_step(df.sparkSession, rows, b, w, sigma2)
        history.append(loglik)
        if _settled(history, gain):
            break
        b = np.array([np.linalg.lstsq(m[:d, :d], m[:d, d], rcond=None)[0] for m in g])
        error = sum(m[d, d] - 2 * c @ m[:d, d] + c @ m[:d, :d] @ c for m, c in zip(g, b, strict=True))
        w, sigma2 = np.maximum(n / n.sum(), 1e-9), max(error / n.sum(), 1e-9)
        if on_step:
            on_step(step, (b, w, sigma2), history[-1])
    return b, w, sigma2, history


def categorical_step(bags: DataFrame, w: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step for a mixture whose components emit independent symbols, over distinct bags (x ARRAY<INT>, n)."""
    k, d = o.shape
    logo = F.array(*(F.array(*(F.lit(float(v)) for v in np.log(np.maximum(row, 1e-300)))) for row in o))
    score = lambda c: F.lit(float(np.log(max(w[c], 1e-300)))) + V.vsum(F.transform("x", lambda s: logo[c][s]))
    rows = bags.withColumn("s", F.array(*(F.struct(F.lit(c).alias("k"), score(c).alias("lp")) for c in range(k))))
    ll = rows.agg(F.sum(F.col("n") * V.logsumexp(F.transform("s", lambda c: c["lp"])))).first()[0] or 0.0
    r = X.responsibilities(rows).withColumn("r", F.col("r") * F.col("n"))
    counts = r.select("k", "r", F.explode("x").alias("s")).groupBy("k", "s").agg(F.sum("r").alias("v"))
    nw, no = np.zeros(k), np.zeros((k, d))
    for q in r.groupBy("k").agg(F.sum("r").alias("v")).collect():
        nw[q.k] = q.v
    for q in counts.collect():
        no[q.k, q.s] = q.v
    return nw / nw.sum(), no / np.maximum(no.sum(axis=1, keepdims=True), 1e-300), ll


def fit_categorical(bags: DataFrame, k: int, d: int, steps: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    rng = np.random.default_rng(seed)
    w, o, history = np.full(k, 1 / k), rng.dirichlet(np.ones(d), k), []
    bags = bags.persist()
    try:
        for _ in range(steps):
            w, o, ll = categorical_step(bags, w, o)
            history.append(ll)
        return w, o, history
    finally:
        bags.unpersist()


def state_step(counts: DataFrame, z: DataFrame, o: DataFrame) -> DataFrame:
    """(k, w): one EM step for the states' distribution z (k, w) with emissions o (k, x, p) fixed, from counts (x, n)."""
    joint = counts.join(o, "x").join(z, "k").withColumn("v", F.col("w") * F.col("p"))
    post = joint.withColumn("r", F.col("n") * F.col("v") / F.sum("v").over(Window.partitionBy("x")))
    total = counts.agg(F.sum("n").alias("t"))
    return post.groupBy("k").agg(F.sum("r").alias("r")).crossJoin(F.broadcast(total)).select("k", (F.col("r") / F.col("t")).alias("w"))


def pair_step(counts: DataFrame, z: DataFrame, o: DataFrame) -> DataFrame:
    """(k1, k2, w): the same for the distribution of neighbouring states z (k1, k2, w), from counts (x1, x2, n)."""
    a, b = (o.select(F.col("k").alias(f"k{i}"), F.col("x").alias(f"x{i}"), F.col("p").alias(f"p{i}")) for i in (1, 2))
    joint = counts.join(a, "x1").join(b, "x2").join(z, ["k1", "k2"]).withColumn("v", F.col("w") * F.col("p1") * F.col("p2"))
    post = joint.withColumn("r", F.col("n") * F.col("v") / F.sum("v").over(Window.partitionBy("x1", "x2")))
    total = counts.agg(F.sum("n").alias("t"))
    return post.groupBy("k1", "k2").agg(F.sum("r").alias("r")).crossJoin(F.broadcast(total)).select("k1", "k2", (F.col("r") / F.col("t")).alias("w"))


def mixing_fit(counts: DataFrame, z: dict[tuple, float], o: DataFrame, keys: list[str], steps: int, least: float = 0.0) -> dict[tuple, float]:
    """The weights w of hidden states after steps of EM, emissions o (k, x, p) fixed; keys are the counts' symbol columns (x, or x1 and x2), and z maps a state for each of them to its first weight.

    The likelihoods of a row's symbols by state are put beside its count once; a step is then one sum over the rows, as
    many numbers as there are states. It ends as no weight moves by more than least.
    """
    states = sorted(z)
    rows = counts.select(*keys, "n")
    for i, c in enumerate(keys):
        # a symbol's likelihoods by state, as a map of some states
        one = o.groupBy(F.col("x").alias(c)).agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias(f"p{i}"))
        rows = rows.join(one, c)
    product = lambda s: reduce(lambda a, b: a * b, (F.coalesce(F.try_element_at(f"p{i}", F.lit(k)), F.lit(0.0)) for i, k in enumerate(s)))
    rows = saved(rows.select("n", *(product(s).alias(f"g{j}") for j, s in enumerate(states))), "likelihoods")
    w = [z[s] for s in states]
    for _ in range(steps):
        parts = [F.col(f"g{j}") * float(v) for j, v in enumerate(w)]
        total = reduce(lambda a, b: a + b, parts)
        new = rows.agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * p / total).alias(f"w{j}") for j, p in enumerate(parts))).first()
        old, w = w, [float(new[f"w{j}"] / new.n) for j in range(len(states))]
        if max(abs(a - b) for a, b in zip(old, w, strict=True)) <= least:
            break
    return dict(zip(states, w, strict=True))


def composite_loglik(counts: DataFrame, z: DataFrame, o: DataFrame) -> DataFrame:
    """One row (loglik): sum over x of n ln p(x) for states z (k, w) and emissions o (k, x, p)."""
    p = counts.join(o, "x").join(z, "k").groupBy("x", "n").agg(F.sum(F.col("w") * F.col("p")).alias("q"))
    return p.agg(F.sum(F.col("n") * F.ln("q")).alias("loglik"))


def pair_loglik(counts: DataFrame, z: DataFrame, o: DataFrame) -> DataFrame:
    a, b = (o.select(F.col("k").alias(f"k{i}"), F.col("x").alias(f"x{i}"), F.col("p").alias(f"p{i}")) for i in (1, 2))
    p = counts.join(a, "x1").join(b, "x2").join(z, ["k1", "k2"]).groupBy("x1", "x2", "n").agg(F.sum(F.col("w") * F.col("p1") * F.col("p2")).alias("q"))
    return p.agg(F.sum(F.col("n") * F.ln("q")).alias("loglik"))


def pair_information(counts: DataFrame, z: DataFrame, o: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2, v): the information matrix of the pair distribution, sum of n g g' / q^2 with g = o(x1|k1) o(x2|k2)."""
    a, b = (o.select(F.col("k").alias(f"k{i}"), F.col("x").alias(f"x{i}"), F.col("p").alias(f"p{i}")) for i in (1, 2))
    g = counts.join(a, "x1").join(b, "x2").withColumn("g", F.col("p1") * F.col("p2"))
    q = g.join(z, ["k1", "k2"]).groupBy("x1", "x2").agg(F.sum(F.col("w") * F.col("g")).alias("q"))
    left = g.join(q, ["x1", "x2"]).select("x1", "x2", "n", "q", F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("g").alias("ga"))
    right = g.select("x1", "x2", F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("g").alias("gb"))
    v = F.col("n") * F.col("ga") * F.col("gb") / (F.col("q") * F.col("q"))
    return left.join(right, ["x1", "x2"]).groupBy("a1", "a2", "b1", "b2").agg(F.sum(v).alias("v"))


def repeat(step: Callable[[DataFrame], DataFrame], z: DataFrame, steps: int, least: float = 0.0) -> DataFrame:
    """step() applied over and over to a small table (keys, w), which is collected between steps, so plans don't grow; it ends as no w moves by more than least."""
    keys = [c for c in z.columns if c != "w"]
    old = {tuple(r[c] for c in keys): r.w for r in z.collect()}
    for _ in range(steps):
        rows = step(z).select(z.columns).collect()
        z = z.sparkSession.createDataFrame(rows, z.schema)
        new = {tuple(r[c] for c in keys): r.w for r in rows}
        if max((abs(w - old.get(k, 0.0)) for k, w in new.items()), default=0.0) <= least:
            break
        old = new
    return z
