"""Mixtures and regressions: scores, responsibilities, losses and the sums of one EM step.

Components are few (a table (k, m, w) of at most hundreds of rows, or constants), so they travel to the rows; the rows'
contributions are partial sums of the parameters' size.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momenta.functions import vectors as V


def linear(beta: list[float]):
    return lambda x: V.dot(x, F.array(*map(F.lit, map(float, beta))))


def _sum(terms: list[Column]) -> Column:
    return V.vsum(F.array(*terms))


def bilinear(x: Column, y: Column, m: list[list[float]]) -> Column:
    return _sum([F.lit(float(v)) * x[i] * y[j] for i, row in enumerate(m) for j, v in enumerate(row)])


def trilinear(x: Column, y: Column, z: Column, t: list[list[list[float]]]) -> Column:
    return _sum([F.lit(float(v)) * x[i] * y[j] * z[k] for i, a in enumerate(t) for j, b in enumerate(a) for k, v in enumerate(b)])


def _squared(x: Column, m: Column) -> Column:
    return V.vsum(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)))


def _components(centres: DataFrame) -> DataFrame:
    """The components as one row with an array, in the order of k."""
    return centres.agg(F.array_sort(F.collect_list(F.struct("k", "m", *([c] if (c := "w") in centres.columns else [])))).alias("_c"))


def distances(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, k, dist) for every point and centre; the pairs are the result."""
    rows = points.crossJoin(F.broadcast(_components(centres))).select("*", F.explode("_c").alias("c"))
    return rows.select("id", F.col("c.k").alias("k"), F.sqrt(_squared(F.col("x"), F.col("c.m"))).alias("dist"))


def nearest(points: DataFrame, centres: DataFrame, *carry: str) -> DataFrame:
    """(id, k, dist) and the carried columns of the nearest centre; of equally near ones the lowest k. Found in the row, without a shuffle of points."""
    best = F.array_min(F.transform("_c", lambda c: F.struct(F.round(_squared(F.col("x"), c["m"]), 9).alias("r"), c["k"].alias("k"), _squared(F.col("x"), c["m"]).alias("d"))))
    return points.crossJoin(F.broadcast(_components(centres))).select("id", *carry, best.alias("b")).select("id", F.col("b.k").alias("k"), F.sqrt("b.d").alias("dist"), *carry)


def gaussian_scores(points: DataFrame, centres: DataFrame, sigma2: float, *carry: str) -> DataFrame:
    """points with s, an array of (k, lp): the log of each component's weight times density, spherical with variance sigma2."""
    d = F.size("x")
    one = lambda c: F.struct(c["k"].alias("k"), (F.ln(c["w"]) - _squared(F.col("x"), c["m"]) / (2 * sigma2) - d / 2 * math.log(2 * math.pi * sigma2)).alias("lp"))
    return points.crossJoin(F.broadcast(_components(centres))).withColumn("s", F.transform("_c", one)).drop("_c")


def _evidence(s: str = "s") -> Column:
    return V.logsumexp(F.transform(s, lambda c: c["lp"]))


def responsibilities(scored: DataFrame) -> DataFrame:
    """scored rows with k and r, the share of each component."""
    rows = scored.withColumn("_z", _evidence())
    rows = rows.select("*", F.explode("s").alias("c"))
    return rows.select(*(c for c in scored.columns if c != "s"), F.col("c.k").alias("k"), F.exp(F.col("c.lp") - F.col("_z")).alias("r"))


def loglik(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum(_evidence()).alias("loglik"))


def gmm_step(points: DataFrame, centres: DataFrame, sigma2: float, d: int) -> DataFrame:
    """(k, w, m, n, var): one step of EM for spherical Gaussians; weights count one more point for each component, var is its mean squared distance a coordinate."""
    r = F.col("r")
    rows = responsibilities(gaussian_scores(points, centres, sigma2))
    x = F.col("x")
    sums = rows.groupBy("k").agg(F.sum(r).alias("n"), F.sum(r * V.dot(x, x)).alias("q"), *(F.sum(r * x[i]).alias(f"s{i}") for i in range(d)))
    m = F.array(*(F.col(f"s{i}") / F.col("n") for i in range(d)))
    out = sums.withColumns({"m": m, "w": (F.col("n") + 1) / F.sum(F.col("n") + 1).over(Window.partitionBy(F.lit(0)))})
    return out.select("k", "w", "m", "n", ((F.col("q") / F.col("n") - V.dot(F.col("m"), F.col("m"))) / d).alias("var"))


def multiview_scores(points: DataFrame, centres: DataFrame, sigmas: list[float], sizes: tuple[int, ...]) -> DataFrame:
    """points (id, x1, x2, ...) with s as gaussian_scores() gives it; a centre's m has the views one after the other, each view its own variance."""
    start = [sum(sizes[:v]) + 1 for v in range(len(sizes))]
    const = sum(-n / 2 * math.log(2 * math.pi * s) for n, s in zip(sizes, sigmas, strict=True))

    def one(c: Column) -> Column:
        near = [_squared(F.col(f"x{v + 1}"), F.slice(c["m"], start[v], n)) / (2 * sigmas[v]) for v, n in enumerate(sizes)]
        return F.struct(c["k"].alias("k"), (F.ln(c["w"]) + const - sum(near[1:], near[0])).alias("lp"))

    return points.crossJoin(F.broadcast(_components(centres))).withColumn("s", F.transform("_c", one)).drop("_c")


def least_residual(y: Column, x: Column, betas: list[list[float]]) -> Column:
    return F.array_min(F.array(*((y - linear(b)(x)) * (y - linear(b)(x)) for b in betas)))


def square_loss(df: DataFrame, predict) -> DataFrame:
    e = F.col("y") - predict(F.col("x"))
    return df.agg(F.avg(e * e).alias("loss"))


def features(degree: int, d: int) -> list[tuple[int, ...]]:
    return list(itertools.product(range(d), repeat=degree))


def gradient(df: DataFrame, predict, cells: list[tuple[int, ...]]) -> DataFrame:
    """(i, v): the mean of residual times product, for the products of coordinates in cells; one row of sums, then its columns as rows."""
    x, e = F.col("x"), F.col("_e")
    rows = df.select("x", (predict(F.col("x")) - F.col("y")).alias("_e"))

    def product(c: tuple[int, ...]) -> Column:
        out = e
        for i in c:
            out = out * x[i]
        return out

    means = rows.agg(F.array(*(F.avg(product(c)) for c in cells)).alias("g"))
    return means.select(F.posexplode("g").alias("i", "v"))


def normal_equations(df: DataFrame) -> DataFrame:
    """(i, j, v): the means of x_i x_j, and of x_i y in the column after the last."""
    from momenta.operators import moments as M

    rows = df.select("x", F.concat("x", F.array("y")).alias("_xy"))
    return M.pairs(rows, "x", "_xy")


def regression_scores(df: DataFrame, betas: list[list[float]], weights: list[float], sigma2: float) -> DataFrame:
    y, x = F.col("y"), F.col("x")

    def lp(b: list[float], w: float) -> Column:
        e = y - linear(b)(x)
        return F.lit(math.log(w) - 0.5 * math.log(2 * math.pi * sigma2)) - e * e / (2 * sigma2)

    return df.withColumn("s", F.array(*(F.struct(F.lit(k).alias("k"), lp(b, w).alias("lp")) for k, (b, w) in enumerate(zip(betas, weights, strict=True)))))


def regression_loglik(df: DataFrame, betas: list[list[float]], weights: list[float], sigma2: float) -> DataFrame:
    return loglik(regression_scores(df, betas, weights, sigma2))


def regression_gram(df: DataFrame, betas: list[list[float]], weights: list[float], sigma2: float) -> DataFrame:
    """(k, i, j, v): for each component the sums of r x_i x_j, r x_i y (j = d) and r y y (i = j = d)."""
    d = len(betas[0])
    rows = responsibilities(regression_scores(df, betas, weights, sigma2))
    z = F.concat("x", F.array("y"))
    rows = rows.select("k", "r", z.alias("z"))
    z, r = F.col("z"), F.col("r")
    cells = [(i, j) for i in range(d + 1) for j in range(d + 1)]
    sums = rows.groupBy("k").agg(F.array(*(F.sum(r * z[i] * z[j]) for i, j in cells)).alias("g"), F.sum(r).alias("n"))
    at = sums.select("k", "n", F.posexplode("g").alias("p", "v"))
    return at.select("k", F.floor(F.col("p") / (d + 1)).cast("int").alias("i"), (F.col("p") % (d + 1)).cast("int").alias("j"), "v", "n")


def kernel_smooth(df: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(k, y): for every landmark (k, m) the mean of y with weights exp(-|m - x|^2)."""
    rows = df.crossJoin(F.broadcast(_components(landmarks))).select("x", "y", F.explode("_c").alias("c"))
    w = F.exp(-_squared(F.col("x"), F.col("c.m")))
    return rows.select(F.col("c.k").alias("k"), "y", w.alias("w")).groupBy("k").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))


def kernel_smooth_all(points: DataFrame, landmarks: DataFrame, d: int) -> DataFrame:
    """(k, j, y): for every landmark (k, m) the mean of each of the d coordinates of points (id, x) with weights exp(-|m - x|^2)."""
    rows = points.crossJoin(F.broadcast(_components(landmarks))).select("x", F.explode("_c").alias("c"))
    rows = rows.select(F.col("c.k").alias("k"), "x", F.exp(-_squared(F.col("x"), F.col("c.m"))).alias("w"))
    sums = rows.groupBy("k").agg(F.array(*(F.sum(F.col("w") * F.col("x")[j]) for j in range(d))).alias("s"), F.sum("w").alias("w"))
    return sums.select("k", F.posexplode("s").alias("j", "s"), "w").select("k", "j", (F.col("s") / F.col("w")).alias("y"))


def dealt(seed: int, *columns: str) -> Column:
    """A number of 28 bits from the md5 of the seed and the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))), 1, 7), 16, 10).cast("long")


def smooth(df: DataFrame, m: int, d: int, seed: int = 0) -> DataFrame:
    """(g, y, x, n): the averages of m groups of rows, dealt by a hash of id and n."""
    g = (dealt(seed, "id", "n") % m).alias("g")
    return df.groupBy(g).agg(F.avg("y").alias("y"), F.array(*(F.avg(F.col("x")[i]) for i in range(d))).alias("x"), F.count("*").alias("n"))


def smooth_random(df: DataFrame, m: int, d: int, seed: int = 0) -> DataFrame:
    """(g, y, x): m averages over all rows, each with its own weights from a hash."""
    w = lambda k: dealt(seed, k, "id", "n") % 1000 / 1000.0
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("g")).withColumn("w", w("g"))
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    return rows.groupBy("g").agg(mean(F.col("y")).alias("y"), F.array(*(mean(F.col("x")[i]) for i in range(d))).alias("x"))
