"""Estimators by the method of moments: moments are Spark aggregations, the rest works on k by k by k objects."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.functions import vectors as V
from momenta.operators import coo as C
from momenta.operators import mixtures as X
from momenta.operators import moments as M
from momenta.operators import ngrams as N
from momenta.plans.hmm import Chain
from momenta.plans.small import power_method, to_simplex, whitener
from momenta.sources.scratch import saved


def _frame(spark, m: np.ndarray) -> DataFrame:
    """A matrix of thin size as (i, j, v)."""
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, v double")


def gaussian_factor(index: DataFrame, p: int, seed: int = 0) -> DataFrame:
    """(i, j, v): a row of p normal numbers for every index (i), drawn from hashes, so any task draws the same."""
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed + s), "i", "j"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cells = index.select("i").distinct().select("i", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("j"))
    return cells.withColumn("v", F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * np.pi * u(1)))


def _gram(y: DataFrame, p: int) -> np.ndarray:
    """Y'Y of a tall factor (i, j, v) with p columns."""
    rows = y.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    x = F.array(*(F.coalesce(F.try_element_at("m", F.lit(j)), F.lit(0.0)) for j in range(p)))
    n = rows.count()
    return M.collect_matrix(M.pairs(rows.select(x.alias("x1"), x.alias("x2"))), p, p) * n


def orthonormal(y: DataFrame, p: int) -> DataFrame:
    """The columns of a tall factor made orthonormal through its Gram matrix; directions of no size are left out."""
    values, vectors = np.linalg.eigh(_gram(y, p))
    keep = values > 1e-12 * values.max()
    return C.multilinear(y, {"j": _frame(y.sparkSession, vectors[:, keep] / np.sqrt(values[keep]))})


def randomized_svd(m: DataFrame, k: int, extra: int = 4, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(U, s, V) of the leading k directions of a sparse matrix (i, j, v), by products with thin factors alone."""
    p = k + extra
    turned = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    y = C.contract(m, gaussian_factor(turned, p, seed), "j", "_j").withColumnRenamed("_j", "j")
    q = saved(orthonormal(saved(y, "range"), p), "basis")
    b = saved(C.contract(turned, q, "j", "_j").withColumnRenamed("_j", "j"), "small")
    values, vectors = np.linalg.eigh(_gram(b, p))
    values, vectors = np.sqrt(np.maximum(values[::-1][:k], 0)), vectors[:, ::-1][:, :k]
    u = C.multilinear(q, {"j": _frame(m.sparkSession, vectors)})
    v = C.multilinear(b, {"j": _frame(m.sparkSession, vectors / np.maximum(values, 1e-300))})
    return u, values, v


def decompose_views(p12: np.ndarray, p32: np.ndarray, p13: np.ndarray, p123: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (k) and third-view means (d3, k) from exact or sampled moments: the other views are turned into the third, whitened, and split by power steps.

    Moments of rank below k are an error.
    """
    u1, u2, u3 = (np.linalg.svd(a, full_matrices=False)[s][:, :k] if s == 0 else np.linalg.svd(a, full_matrices=False)[2].T[:, :k] for a, s in ((p12, 0), (p12, 2), (p13, 2)))
    a12, a32, a13 = u1.T @ p12 @ u2, u3.T @ p32 @ u2, u1.T @ p13 @ u3
    a123 = np.einsum("abc,ai,bj,ck->ijk", p123, u1, u2, u3)
    to3_1 = a32 @ np.linalg.pinv(a12)
    to3_2 = a13.T @ np.linalg.pinv(a12.T)
    pairs = to3_1 @ a12 @ to3_2.T
    values = np.linalg.eigvalsh((pairs + pairs.T) / 2)
    rank = int((values > 1e-12 * max(values[-1], 1e-300)).sum())
    if rank < k:
        raise ValueError(f"the moments have rank {rank}: no {k} components can be told apart")
    triples = np.einsum("abc,ia,jb->ijc", a123, to3_1, to3_2)
    w = whitener((pairs + pairs.T) / 2, k)
    t = np.einsum("abc,ai,bj,ck->ijk", triples, w, w, w)
    t = sum(t.transpose(o) for o in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))) / 6
    values, vectors = power_method(t, seed=seed)
    means = u3 @ (np.linalg.pinv(w.T) @ (vectors * values[:, None]).T)
    weights = 1 / np.maximum(values, 1e-300) ** 2
    return weights, means


#: Cells of a tensor that are held on the driver at most.
MOST_CELLS = 1 << 21


def view_moments(views: DataFrame, d: int) -> dict[str, np.ndarray]:
    """The four arrays of a views table (view, x1, x2, x3, p) over d symbols; for more than d^3 = MOST_CELLS cells there is three_view()."""
    if d**3 > MOST_CELLS:
        raise ValueError(f"{d} symbols are too many for full moments; three_view() projects them first")
    out = {v: np.zeros((d,) * len(v)) for v in ("12", "13", "32", "123")}
    for r in views.collect():
        cell = {"12": (r.x1, r.x2), "13": (r.x1, r.x3), "32": (r.x3, r.x2), "123": (r.x1, r.x2, r.x3)}[r["view"]]
        out[r["view"]][cell] += r.p
    return out


def three_view_exact(views: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and symbol distributions (d, k) of the third view from full moments."""
    m = view_moments(views, d)
    weights, means = decompose_views(m["12"], m["32"], m["13"], m["123"], k)
    return weights / weights.sum(), to_simplex(means)


def three_view(trigrams: DataFrame, k: int, extra: int = 2, seed: int = 0, order: tuple[int, int, int] = (0, 2, 1)) -> tuple[np.ndarray, DataFrame]:
    """Weights and the third view's means (i, j, v) for a vocabulary of any size: all moments are projected to k + extra directions before they are held.

    trigrams is (w0, w1, w2, n).
    """
    t = N.share(trigrams, "n", name="v").select(*(F.col(f"w{o}").alias(c) for o, c in zip(order, "ijk", strict=True)), "v")
    t = saved(t, "trigrams")
    p = k + extra

    def basis(a: str, b: str, s: int) -> DataFrame:
        """Leading directions of view a in its moment with view b."""
        m = t.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.sum("v").alias("v"))
        return saved(randomized_svd(m, p, extra, seed + s)[0], "view")

    u1, u2, u3 = basis("i", "j", 0), basis("j", "i", 1), basis("k", "j", 2)
    projected = M.collect_matrix(C.multilinear(t, {"i": u1, "j": u2, "k": u3}), p, p, p)
    two = lambda a, b, ua, ub: M.collect_matrix(C.multilinear(t.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.sum("v").alias("v")), {"i": ua, "j": ub}), p, p)
    weights, means = decompose_views(two("i", "j", u1, u2), two("k", "j", u3, u2), two("i", "k", u1, u3), projected, k, seed)
    return weights / weights.sum(), C.multilinear(u3, {"j": _frame(t.sparkSession, means)})


def projected(points: DataFrame, **factors: tuple[str, np.ndarray]) -> DataFrame:
    """points with further columns: name=(view, thin factor) is the view's rows times the factor, worked out where they lie."""
    used = sorted({c for c, _ in factors.values()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                new = [M._dense(batch[c]) @ u for c, u in factors.values()]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in new]
                yield pa.record_batch([*batch.columns, *lists], [*batch.schema.names, *factors])

    rows = points.withColumns({c: F.col(c).cast("array<double>") for c in used}).where(" AND ".join(f"{c} IS NOT NULL" for c in used))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} array<double>" for n in factors])
    return rows.mapInArrow(run, schema)


def leading_directions(points: DataFrame, x: str, y: str, d: tuple[int, int], k: int, extra: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k leading left and right directions of E[x (x) y], from three passes that each contract one side in the rows: what comes back has k + extra columns."""
    p = min(k + extra, *d)
    thin = np.random.default_rng(seed).standard_normal((d[1], p))
    sums = lambda a, b, u, size: M.collect_matrix(M.pairs(projected(points, _u=(b, u)), a, "_u"), size, u.shape[1])
    left = np.linalg.qr(sums(x, y, thin, d[0]))[0]
    right = np.linalg.svd(sums(y, x, left, d[1]), full_matrices=False)[0][:, :k]
    return np.linalg.svd(sums(x, y, right, d[0]), full_matrices=False)[0][:, :k], right


def _weighted(points: DataFrame) -> DataFrame:
    """Points with w take part by weight: a view times w / mean(w), once in every product of a moment, gives the weighted moment."""
    if "w" not in points.columns:
        return points.select("*", F.col("x1").alias("y1"), F.col("x3").alias("y3"))
    mean = points.agg(F.avg("w")).first()[0] or 1.0
    by = lambda c: F.transform(c, lambda v: v * F.col("w") / mean)
    return points.select("*", by("x1").alias("y1"), by("x3").alias("y3"))


def simultaneous_diag(points: DataFrame, d: tuple[int, int, int], k: int, seed: int = 0, restarts: int = 20) -> np.ndarray:
    """Means (d3, k) of the third view of points (x1, x2, x3, and w: a weight): the moments along random directions share eigenvectors, and the eigenvalues are the means' coordinates.

    The first two views are turned to their k leading directions in the rows, so k k d3 cells come back and nothing of d1 d2.
    """
    points = _weighted(points)
    u1, u2 = leading_directions(points, "y1", "x2", d[:2], k, seed=seed)
    rows = projected(points, _a=("y1", u1), _b=("x2", u2))
    inverse = np.linalg.inv(M.collect_matrix(M.pairs(rows, "_a", "_b"), k, k))
    t = M.collect_matrix(M.triples(rows, "_a", "_b", "x3"), k, k, d[2])
    rng = np.random.default_rng(seed)
    for _ in range(restarts):
        thetas = np.linalg.qr(rng.standard_normal((d[2], d[2])))[0]
        b = np.einsum("abc,tc->tab", t, thetas) @ inverse
        values, r = np.linalg.eig(b[0])
        if np.abs(values.imag).max() < 1e-9:
            lam = np.einsum("ij,tjk,ki->ti", np.linalg.inv(r.real), b, r.real)
            return np.linalg.solve(thetas, lam)
    raise ValueError("no direction gave real eigenvalues: the moments are too noisy for this many components")


#: Numbers of a vocabulary's thin factor that the driver and every task hold at most.
MOST_FACTOR = 1 << 23


#: Words of documents that are worked on at once.
STEP = 1 << 17


def _slices(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Places of documents, from and to, that hold some STEP words together."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    cuts = np.flatnonzero(np.diff(ends // STEP)) + 1
    return itertools.pairwise([0, *cuts.tolist(), len(ends)])


def bags(docs: DataFrame, d: int) -> DataFrame:
    """(x, n), written: the words that each document (x ARRAY<INT>) has, and how many of each. Words outside the vocabulary are left out, documents of fewer than three too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch["x"]):
                lists = batch["x"].slice(a, b - a)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                x = pc.fill_null(lists.flatten(), -1).to_numpy().astype(np.int64)
                key = (np.repeat(np.arange(len(size)), size) * d + x)[(x >= 0) & (x < d)]
                if len(size) * d <= 4 * len(key):
                    n = np.bincount(key, minlength=len(size) * d)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(key, return_counts=True)
                doc = key // d
                whole = np.bincount(doc, n, len(size)) >= 3
                keep = whole[doc]
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(size))[whole])].astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(v[keep].astype(np.int32))) for v in (key % d, n))
                yield pa.record_batch(list(lists), ["x", "n"])

    return saved(docs.select(F.col("x").cast("array<int>").alias("x")).mapInArrow(run, "x array<int>, n array<int>"), "bags")


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of some documents of bags() in a row, how many there are of each, where each document begins, and how many words it has."""
    for a, b in _slices(batch["x"]):
        x, n = (batch[c].slice(a, b - a) for c in ("x", "n"))
        start = np.r_[0, np.cumsum(pc.list_value_length(x).to_numpy())][:-1]
        x, n = x.flatten().to_numpy(), n.flatten().to_numpy().astype(float)
        if len(x):
            yield x, n, start, np.add.reduceat(n, start)


def pair_products(docs: DataFrame, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Word shares, the pair moment times a thin factor (d, p), and the number of documents x, or bags() of them: for every two places of a document one word's row gets the other's.

    The pair moment itself, d x d, is never made: a document adds its sum of factor rows, less a word's own, to each of its words. A task gives a row for each word it met.
    """
    d, p = factor.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((d, p + 1)), 0
        for x, c, start, n in itertools.chain.from_iterable(map(_counted, batches)):
            rows, words = factor[x], np.diff(np.r_[start, len(x)])
            size, c = np.repeat(n, words)[:, None], c[:, None]
            sums = np.repeat(np.add.reduceat(rows * c, start), words, axis=0)
            parts = np.concatenate([c / size, c * (sums - rows) / (size * (size - 1))], axis=1)
            for i in range(p + 1):
                total[:, i] += np.bincount(x, parts[:, i], d)
            count += len(n)
        met = np.flatnonzero(total[:, 0])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[met].ravel()), p + 1).cast(pa.list_(pa.float64()))
        yield pa.record_batch([pa.array(np.append(met, -1).astype(np.int32)), pa.concat_arrays([lists, pa.array([[float(count)] * (p + 1)], pa.list_(pa.float64()))])], ["i", "v"])

    sums = _bagged(docs, d).mapInArrow(run, "i int, v array<double>").groupBy("i").agg(*(F.sum(F.col("v")[c]).alias(f"v{c}") for c in range(p + 1)))
    out, count = np.zeros((d, p + 1)), 0
    for r in sums.collect():
        if r.i < 0:
            count = int(r.v0)
        else:
            out[r.i] = r[1:]
    return out[:, 0] / max(count, 1), out[:, 1:] / max(count, 1), count


def _bagged(docs: DataFrame, d: int) -> DataFrame:
    return docs if "n" in docs.columns else bags(docs, d)


def triple_products(docs: DataFrame, factor: np.ndarray) -> np.ndarray:
    """The triple moment (over three different places of a document) turned by a thin factor (d, k) on all sides: k^3 cells, added up in the rows."""
    from momenta.plans.protocols import partial_sums

    d, k = factor.shape

    def update(batch: pa.RecordBatch) -> np.ndarray:
        out, count = np.zeros((k, k, k)), 0
        for x, c, start, n in _counted(batch):
            rows, w = factor[x], 1 / (n * (n - 1) * (n - 2))
            many = rows * c[:, None]
            a = np.add.reduceat(many, start)
            g = np.add.reduceat(many[:, :, None] * rows[:, None, :], start)
            own = np.einsum("ni,nj,nl,n->ijl", many, rows, rows, np.repeat(w, np.diff(np.r_[start, len(x)])), optimize=True)
            mixed = np.einsum("nij,nl,n->ijl", g, a, w, optimize=True)
            out += np.einsum("ni,nj,nl,n->ijl", a, a, a, w, optimize=True) - mixed - mixed.transpose(0, 2, 1) - mixed.transpose(2, 1, 0) + 2 * own
            count += len(n)
        return np.append(out.ravel(), count)

    found = np.zeros(k**3 + 1)
    for r in partial_sums(_bagged(docs, d).select("x", "n"), update).collect():
        found[r.i] = r.v
    return found[:-1].reshape(k, k, k) / max(found[-1], 1)


def lda(docs: DataFrame, d: int, k: int, alpha0: float = 1.0, seed: int = 0, extra: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights and word distributions (d, k) from the moments of two and three places of encoded documents (x ARRAY<INT>), with the Dirichlet correction.

    Documents are read once and kept as bags of words. Every pass multiplies the moments by a factor of a few columns: two passes find the leading
    directions, one the moment among them, one the whitened triples; what the driver holds is d times k + extra and k^3.
    The moments are over documents of three words and more.
    """
    p = min(k + extra, d)
    if d * p > MOST_FACTOR:
        raise ValueError(f"{d} words times {p} directions are too many to hold")
    docs = bags(docs, d)
    ratio = alpha0 / (alpha0 + 1)

    def times(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m1, product, _ = pair_products(docs, factor)
        return m1, product - ratio * np.outer(m1, m1 @ factor)

    basis = np.random.default_rng(seed).standard_normal((d, p))
    for _ in range(2):
        basis = np.linalg.qr(times(basis)[1])[0]
    m1, product = times(basis)
    small = whitener(basis.T @ product, k)
    w = basis @ small
    back = basis @ np.linalg.pinv(small.T)
    t = triple_products(docs, w)
    t = sum(t.transpose(o) for o in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))) / 6
    a = w.T @ m1
    pairs = np.eye(k) + ratio * np.outer(a, a)
    cross = np.einsum("ab,c->abc", pairs, a) + np.einsum("ac,b->abc", pairs, a) + np.einsum("bc,a->abc", pairs, a)
    t = t - alpha0 / (alpha0 + 2) * cross + 2 * alpha0**2 / ((alpha0 + 1) * (alpha0 + 2)) * np.einsum("a,b,c->abc", a, a, a)
    values, vectors = power_method(t, seed=seed)
    topics = to_simplex(back @ (vectors * values[:, None]).T)
    weights = 1 / np.maximum(values, 1e-300) ** 2
    return weights / weights.sum(), topics


def spherical_gmm(points: DataFrame, d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, means (d, k) and variance of spherical Gaussians over points (id, x): the least eigenvalue of the covariance is the variance, which is taken off the second and third moments.

    A hash of id halves the points: the second moment is one half's and the third the other's, so their errors are independent.
    """
    half = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2))
    all_rows = points.select("id", F.col("x").alias("x1"), F.col("x").alias("x2"), half.alias("half"))
    rows, other = all_rows.where("half = 0"), all_rows.where("half = 1")
    m1 = M.collect_matrix(M.first_moment(rows), d)
    e2 = M.collect_matrix(M.pairs(rows), d, d)
    sigma2 = float(max(np.linalg.eigvalsh(e2 - np.outer(m1, m1))[0], 0.0))
    w = whitener(e2 - sigma2 * np.eye(d), k)
    thin = F.array(*(V.dot(F.col("x1"), F.array(*map(F.lit, map(float, w[:, j])))) for j in range(k)))
    white = other.select(thin.alias("x1")).select("x1", F.col("x1").alias("x2"), F.col("x1").alias("x3"))
    t = M.collect_matrix(M.triples(white), k, k, k)
    a, s = M.collect_matrix(M.first_moment(white), k), sigma2 * (w.T @ w)
    t = t - (np.einsum("a,bc->abc", a, s) + np.einsum("b,ac->abc", a, s) + np.einsum("c,ab->abc", a, s))
    values, vectors = power_method(t, seed=seed)
    means = np.linalg.pinv(w.T) @ (vectors * values[:, None]).T
    weights = 1 / np.maximum(values, 1e-300) ** 2
    return weights / weights.sum(), means, sigma2


def hmm_from_views(views: DataFrame, first: np.ndarray, d: int, k: int, smoothing: float = 1e-6) -> Chain:
    """A chain from the views (t, t+2, t+1): the third view has the emissions, the second is emission after transition."""
    m = view_moments(views, d)
    weights, o = decompose_views(m["12"], m["32"], m["13"], m["123"], k)
    o = to_simplex(o, smoothing)
    # columns of view 2 given the state: P32 = O diag(w) (O T')'
    w = to_simplex(weights[:, None], smoothing)[:, 0]
    after = (np.linalg.pinv(o @ np.diag(w)) @ m["32"]).T
    t = to_simplex(np.linalg.pinv(o) @ after, smoothing).T
    pi = to_simplex((np.linalg.pinv(o) @ first)[:, None], smoothing)[:, 0]
    return Chain(pi, t, o.T)


def gmm_from_views(points: DataFrame, d: tuple[int, int, int], k: int, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray], DataFrame]:
    """Weights, the three views' means and each component's variance for points (id, x1, x2, x3, and w: a weight).

    All views are turned to their k leading directions in the rows; the moments that come back have k columns or k^3 cells.
    """
    rows = _weighted(points)
    u1, u2 = leading_directions(rows, "y1", "x2", d[:2], k, seed=seed)
    _, u3 = leading_directions(rows, "y1", "x3", (d[0], d[2]), k, seed=seed + 1)
    rows = projected(rows, _a=("y1", u1), _b=("x2", u2), _c=("x3", u3), _e=("y3", u3))
    m = {n: M.collect_matrix(M.pairs(rows, *c), k, k) for n, c in {"12": ("_a", "_b"), "32": ("_e", "_b"), "13": ("_a", "_c")}.items()}
    weights, thin = decompose_views(m["12"], m["32"], m["13"], M.collect_matrix(M.triples(rows, "_a", "_b", "_c"), k, k, k), k)
    weights = np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum()
    right = np.linalg.pinv(thin * weights).T
    means = [M.collect_matrix(M.pairs(rows, "y1", "_c"), d[0], k) @ right, M.collect_matrix(M.pairs(rows, "x2", "_e"), d[1], k) @ right, u3 @ thin]
    spark = points.sparkSession
    centres = spark.createDataFrame([(j, [float(v) for x in means for v in x[:, j]], float(weights[j])) for j in range(len(weights))], "k int, m array<double>, w double")
    joined = points.select("id", F.concat("x1", "x2", "x3").alias("x"))
    sigma2 = joined.agg(F.avg(V.dot(F.col("x"), F.col("x"))) / sum(d)).first()[0]
    step = X.gmm_step(joined, centres, float(sigma2), sum(d))
    return weights, means, step.select("k", "n", "var")


def regression_moments(samples: DataFrame, d: int, ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, second and third moments of the coefficients of a mixture of regressions over (y, x): y, y^2 and y^3 on the products of x, by normal equations.

    Noise of y adds its variance to y^2 and three times that times the mean to y^3, which a constant and x beside the
    products take up; so x itself has no constant coordinate.
    """
    from momenta.plans.estimators import ridge as solve

    x, y = F.col("x"), F.col("y")
    n2, n3 = d * (d + 1) // 2, d * (d + 1) * (d + 2) // 6
    b1 = solve(samples, d, ridge)
    b2 = solve(samples.select(F.concat(V.sym_expand2(x, d), F.array(F.lit(1.0))).alias("x"), (y * y).alias("y")), n2 + 1, ridge)
    b3 = solve(samples.select(F.concat(V.sym_expand3(x, d), x).alias("x"), (y * y * y).alias("y")), n3 + d, ridge)
    m2, m3 = np.zeros((d, d)), np.zeros((d, d, d))
    for (i, j), v in zip(itertools.combinations_with_replacement(range(d), 2), b2, strict=False):
        m2[i, j] = m2[j, i] = v
    for cell, v in zip(itertools.combinations_with_replacement(range(d), 3), b3, strict=False):
        for o in itertools.permutations(cell):
            m3[o] = v
    return b1, m2, m3


def regression_mixture(samples: DataFrame, d: int, k: int, ridge: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and coefficients (k, d) of a mixture of regressions from its moments; em.fit_regressions() goes on from them."""
    _, m2, m3 = regression_moments(samples, d, ridge)
    w = whitener(m2, k)
    t = np.einsum("abc,ai,bj,ck->ijk", m3, w, w, w)
    values, vectors = power_method(t, seed=seed)
    betas = (np.linalg.pinv(w.T) @ (vectors * values[:, None]).T).T
    weights = 1 / np.maximum(values, 1e-300) ** 2
    return weights / weights.sum(), betas


def word_clusters(trigrams: DataFrame, words: DataFrame, k: int, p: int = 8, seed: int = 0) -> DataFrame:
    """(tok, c, dist): words projected to p random directions, centres from their three views, each word to its nearest centre.

    trigrams is (w0, w1, w2, n), words (tok).
    """
    z = saved(gaussian_factor(words.select(F.col("tok").alias("i")), p, seed), "projection")
    row = z.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"] / np.sqrt(p)).alias("x"))
    t = trigrams
    for n in range(3):
        t = t.join(row.select(F.col("i").alias(f"w{n}"), F.col("x").alias(f"x{n + 1}")), f"w{n}")
    # counts as weights: the moments over windows are weighted sums over distinct trigrams
    total = t.agg(F.sum("n")).first()[0]
    weighted = t.select(F.transform("x1", lambda v: v * F.col("n")).alias("x1"), "x2", "x3", F.col("n"))
    scale = t.count() / total
    order = {"12": ("x1", "x3"), "13": ("x1", "x2")}
    p12, p13 = (M.collect_matrix(M.pairs(weighted, *c), p, p) * scale for c in order.values())
    p32 = M.collect_matrix(M.pairs(t.select(F.transform("x2", lambda v: v * F.col("n")).alias("x2"), "x3"), "x2", "x3"), p, p) * scale
    p123 = M.collect_matrix(M.triples(weighted, "x1", "x3", "x2"), p, p, p) * scale
    _, means = decompose_views(p12, p32, p13, p123, k, seed)
    centres = t.sparkSession.createDataFrame([(j, [float(v) for v in means[:, j]]) for j in range(means.shape[1])], "k int, m array<double>")
    return X.nearest(row.select(F.col("i").alias("id"), "x"), centres).select(F.col("id").alias("tok"), F.col("k").alias("c"), "dist")


def first_tokens(tokens: DataFrame, d: int) -> np.ndarray:
    """Shares of the first tokens of sequences (d symbols)."""
    out = np.zeros(d)
    for r in N.share(tokens.where("pos = 0").groupBy("tok").agg(F.count("*").alias("n")), "n").collect():
        out[r.tok] = r.p
    return out
