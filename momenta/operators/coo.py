"""Matrices (i, j, v) and tensors (i, j, k, v) as tables of coordinates: absent cells are 0."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.operators.ngrams import dense_index, share, within


def contract(t: DataFrame, factor: DataFrame, axis: str, to: str, index: str = "i", out: str = "j") -> DataFrame:
    """Sum over axis of t * factor: the axis gives way to the column `to`, the factor's other index.

    Rows are summed before they are joined again, so a frequent index is a partial sum and no hot group.
    """
    rest = [c for c in t.columns if c not in (axis, "v")]
    f = factor.select(F.col(index).alias(axis), F.col(out).alias(to), F.col("v").alias("_f"))
    return t.join(f, axis).groupBy(*rest, to).agg(F.sum(F.col("v") * F.col("_f")).alias("v"))


def multilinear(t: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """t contracted with a factor (i, j, v) on each named axis; the axis keeps its name."""
    for axis, f in factors.items():
        t = contract(t, f, axis, f"_{axis}").withColumnRenamed(f"_{axis}", axis)
    return t


def exact_moments(weights: DataFrame, views: list[DataFrame]) -> DataFrame:
    """Sum over states k of w_k times the product of the views' columns k: (x1, x2[, x3], v) from weights (k, w) and views (i, k, v)."""
    t = weights.select("k", F.col("w").alias("_w"))
    for n, m in enumerate(views, 1):
        t = t.join(m.select("k", F.col("i").alias(f"x{n}"), F.col("v").alias(f"_v{n}")), "k")
    value = reduce(lambda a, n: a * F.col(f"_v{n}"), range(1, len(views) + 1), F.col("_w"))
    return t.groupBy(*(f"x{n}" for n in range(1, len(views) + 1))).agg(F.sum(value).alias("v"))


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of two vectors (i, v); their product is the result's size."""
    return a.select("i", F.col("v").alias("_a")).crossJoin(b.select(F.col("i").alias("j"), F.col("v").alias("_b"))).select("i", "j", (F.col("_a") * F.col("_b")).alias("v"))


def axpy(a: DataFrame, b: DataFrame, s: float) -> DataFrame:
    keys = [c for c in a.columns if c != "v"]
    return a.unionByName(b.withColumn("v", F.col("v") * s)).groupBy(*keys).agg(F.sum("v").alias("v"))


def marginal(t: DataFrame, *keep: str) -> DataFrame:
    return t.groupBy(*keep).agg(F.sum("v").alias("v"))


def symmetrize(t: DataFrame) -> DataFrame:
    """The mean over all orders of the indices."""
    keys = [c for c in t.columns if c != "v"]
    orders = list(itertools.permutations(keys))
    parts = [t.select(*(F.col(a).alias(b) for a, b in zip(o, keys, strict=True)), "v") for o in orders]
    return reduce(DataFrame.unionAll, parts).groupBy(*keys).agg((F.sum("v") / len(orders)).alias("v"))


def skew(m: DataFrame) -> DataFrame:
    """One row (skew): the sum of |m_ij - m_ji| over all cells of a matrix."""
    other = m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("u"))
    return m.join(other, ["i", "j"], "full").agg(F.sum(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("u", F.lit(0.0)))).alias("skew"))


def unfold(t: DataFrame, mode: str, sizes: dict[str, int]) -> DataFrame:
    """A tensor as a matrix: rows are the mode's index, columns count the other two, the later one fastest."""
    a, b = (c for c in ("i", "j", "k") if c != mode)
    return t.select(F.col(mode).alias("i"), (F.col(a) * sizes[b] + F.col(b)).alias("j"), "v")


def fold(m: DataFrame, mode: str, sizes: dict[str, int]) -> DataFrame:
    a, b = (c for c in ("i", "j", "k") if c != mode)
    index = {mode: F.col("i"), a: F.floor(F.col("j") / sizes[b]).cast("int"), b: (F.col("j") % sizes[b]).cast("int")}
    return m.select(*(index[c].alias(c) for c in ("i", "j", "k")), "v")


def rows_of(m: DataFrame, picked: list[int]) -> DataFrame:
    """The picked rows of a matrix, renumbered in that order."""
    place = F.array_position(F.array(*map(F.lit, picked)), F.col("i").cast("int")) - 1
    return m.where(F.col("i").isin(picked)).withColumn("i", place.cast("int"))


def stack(a: DataFrame, b: DataFrame, offset: int, axis: str = "i") -> DataFrame:
    return a.unionByName(b.withColumn(axis, F.col(axis) + offset))


def permute(m: DataFrame, axis: str, permutation: DataFrame) -> DataFrame:
    """m with the axis' index replaced by permutation (a -> b)."""
    p = permutation.select(F.col("a").alias(axis), F.col("b").alias("_b"))
    return m.join(p, axis).drop(axis).withColumnRenamed("_b", axis).select(m.columns)


def normalized(m: DataFrame, *group: str) -> DataFrame:
    """v over its sum in the group: stochastic rows or columns."""
    return share(m, "v", *group, name="v").select(m.columns)


def minmax_rows(m: DataFrame, row: str = "i") -> DataFrame:
    """Rows scaled to [-1, 1] by their least and greatest values, with both; a constant row becomes 0."""
    return within(m, [row], F.min("v").alias("low"), F.max("v").alias("high")).withColumn("v", F.when(F.col("high") > F.col("low"), 2 * (F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) - 1).otherwise(F.lit(0.0)))


def maxabs(m: DataFrame, by: str) -> DataFrame:
    """v over the greatest |v| of its row or column, with that factor; an all-zero one stays."""
    return within(m, [by], F.max(F.abs("v")).alias("factor")).withColumn("v", F.when(F.col("factor") > 0, F.col("v") / F.col("factor")).otherwise(F.col("v")))


def simplex_columns(m: DataFrame, smoothing: float = 0.0, column: str = "j") -> DataFrame:
    """Columns onto the simplex: sign turned if fewer than half the entries are positive, clipped, smoothed, normalised."""
    sums = within(m, [column], F.count_if(F.col("v") > 0).alias("_up"), F.count("*").alias("_n"))
    sign = F.when(2 * F.col("_up") < F.col("_n"), -1.0).otherwise(1.0)
    turned = sums.withColumn("v", F.greatest(F.col("v") * sign, F.lit(0.0)) + smoothing).select(m.columns)
    return normalized(turned, column)


def allclose(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    keys = [c for c in a.columns if c != "v"]
    joined = a.join(b.withColumnRenamed("v", "_u"), keys, "full")
    close = F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("_u", F.lit(0.0))) <= eps
    return joined.agg(F.coalesce(F.bool_and(close), F.lit(True)).alias("close"))


def column_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(j, error, relative): the distance between the columns of two matrices, and over the length of a's."""
    joined = a.join(b.withColumnRenamed("v", "_u"), ["i", "j"], "full").fillna(0.0, ["v", "_u"])
    d = F.col("v") - F.col("_u")
    sums = joined.groupBy("j").agg(F.sqrt(F.sum(d * d)).alias("error"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    return sums.select("j", "error", F.when(F.col("size") > 0, F.col("error") / F.col("size")).alias("relative"))


def column_gap(m: DataFrame) -> DataFrame:
    """One row (gap): the least distance between two columns."""
    other = m.select("i", F.col("j").alias("_j"), F.col("v").alias("_u"))
    d = F.col("v") - F.col("_u")
    # columns are few: pairs of columns are the result's own size
    pairs = m.join(other, "i").where("j < _j").groupBy("j", "_j").agg(F.sqrt(F.sum(d * d)).alias("d"))
    return pairs.agg(F.min("d").alias("gap"))


def precondition(t: DataFrame, eps: float) -> DataFrame:
    """A tensor of probabilities with eps added on its diagonal, summing to 1 again; the diagonal's indices are those that occur."""
    diagonal = t.select("i").distinct().select("i", F.col("i").alias("j"), F.col("i").alias("k"), F.lit(eps).alias("v"))
    raised = t.select("i", "j", "k", "v").unionAll(diagonal).groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    total = raised.agg(F.sum("v").alias("_t"))
    return raised.join(F.broadcast(total)).select("i", "j", "k", (F.col("v") / F.col("_t")).alias("v"))


def canonical(m: DataFrame) -> DataFrame:
    """m with its rows in the order of the column through the least element and its columns in the order of the row through it."""
    least = m.agg(F.min(F.struct("v", "i", "j")).alias("_m")).select(F.col("_m.i").alias("_i"), F.col("_m.j").alias("_j"))
    at = m.join(F.broadcast(least))
    order = lambda line, c, name: dense_index(line.select(c, "v").repartitionByRange("v", c).sortWithinPartitions("v", c), name).select(c, name)
    rows, columns = order(at.where("j = _j"), "i", "_r"), order(at.where("i = _i"), "j", "_c")
    return m.join(rows, "i").join(columns, "j").select(F.col("_r").alias("i"), F.col("_c").alias("j"), "v")


def from_rows(df: DataFrame, id_: str, x: str) -> DataFrame:
    """(i, j, v) of arrays: i is the row's id, j the place."""
    return df.select(F.col(id_).alias("i"), F.posexplode(x).alias("j", "v"))
