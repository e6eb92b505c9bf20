"""Co-moments of numeric views: arrays x1, x2, x3 (and weights q) of one row are the views of one point.

Points are summed where they lie: a task turns its rows into one partial block by numpy and the blocks are added by a
group-by of the result's size, so no d x d rows per point are ever made. Means are sums over the number of points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix or tensor that are collected at most.
MOST_CELLS = 1 << 21


def _dense(column: pa.Array) -> np.ndarray:
    """Numbers as they lie, or arrays of one length as rows of a matrix; arrays of several lengths are refused, as they have no common shape."""
    if pa.types.is_list(column.type):
        sizes = pc.min_max(pc.list_value_length(column)).as_py()
        if sizes["min"] != sizes["max"]:
            raise ValueError(f"arrays of {sizes['min']} to {sizes['max']} numbers in one column")
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _blocks(df: DataFrame, columns: list[str], weight: str | None, spec: str, out: list[str], mean: bool) -> DataFrame:
    """einsum of the columns (and the weight, as n) summed over all rows: (out, v)."""
    names = [*columns, *([weight] if weight else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            if not len(batch):
                continue
            arrays = [_dense(batch[c]) for c in names]
            part = np.einsum(spec, *arrays)
            total, count = part if total is None else total + part, count + len(batch)
        if total is not None:
            index = [pa.array(x.ravel().astype(np.int32)) for x in np.indices(total.shape)]
            yield pa.record_batch([*index, pa.array(total.ravel()), pa.array(np.full(total.size, count, np.int64))], [*out, "v", "n"])

    rows = df.select(*(F.col(c).cast("array<double>").alias(c) for c in columns), *([F.col(weight).cast("double").alias(weight)] if weight else []))
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in names))
    parts = rows.mapInArrow(run, ", ".join(f"{c} int" for c in out) + ", v double, n long")
    value = F.sum("v") / F.sum("n") if mean else F.sum("v")
    return parts.groupBy(*out).agg(value.alias("v"))


def join_views(x1: DataFrame, x2: DataFrame, x3: DataFrame, id_: str = "id") -> DataFrame:
    """(id, x1, x2, x3) of the points that all three tables (id, x1), (id, x2), (id, x3) have; one exchange by id for each."""
    return x1.select(id_, "x1").join(x2.select(id_, "x2"), id_).join(x3.select(id_, "x3"), id_)


def first_moment(df: DataFrame, x: str = "x1") -> DataFrame:
    return _blocks(df, [x], None, "na->a", ["i"], True)


def pairs(df: DataFrame, x: str = "x1", y: str = "x2") -> DataFrame:
    """E[x (x) y]: (i, j, v)."""
    return _blocks(df, [x, y], None, "na,nb->ab", ["i", "j"], True)


def pairs_squared(df: DataFrame, x: str = "x1", y: str = "x2") -> DataFrame:
    """E[(x (x) x) (x) (y (x) y)]: i and j count the products, the later index fastest."""
    sq = lambda c: F.flatten(F.transform(c, lambda a: F.transform(F.col(c), lambda b: a * b)))
    return pairs(df.select(sq(x).alias("_x"), sq(y).alias("_y")), "_x", "_y")


def pairs_weighted(df: DataFrame, x: str = "x1", q: str = "q") -> DataFrame:
    """The sum of q x (x) x."""
    return _blocks(df.withColumn("_y", F.col(x)), [x, "_y"], q, "na,nb,n->ab", ["i", "j"], False)


def triples(df: DataFrame, x: str = "x1", y: str = "x2", z: str = "x3") -> DataFrame:
    """E[x (x) y (x) z]: (i, j, k, v)."""
    return _blocks(df, [x, y, z], None, "na,nb,nc->abc", ["i", "j", "k"], True)


def triples_weighted(df: DataFrame, x: str = "x1", q: str = "q") -> DataFrame:
    """The sum of q x (x) x (x) x."""
    views = df.withColumns({"_y": F.col(x), "_z": F.col(x)})
    return _blocks(views, [x, "_y", "_z"], q, "na,nb,nc,n->abc", ["i", "j", "k"], False)


def _along(x: str, theta: list[float]):
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, theta)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def triples_projected(df: DataFrame, theta: list[float], x: str = "x1", y: str = "x2", z: str = "x3") -> DataFrame:
    """E[x (x) y (z . theta)]: the third view is contracted in each row before anything is summed."""
    return _blocks(df.withColumn("_q", _along(z, theta)), [x, y], "_q", "na,nb,n->ab", ["i", "j"], True)


def triples_projected_weighted(df: DataFrame, theta: list[float], x: str = "x1", q: str = "q") -> DataFrame:
    """E[q x (x) x (x . theta)]."""
    rows = df.withColumns({"_q": F.col(q) * _along(x, theta), "_y": F.col(x)})
    return _blocks(rows, [x, "_y"], "_q", "na,nb,n->ab", ["i", "j"], True)


def covariance(df: DataFrame, x: str = "x1", y: str = "x2") -> DataFrame:
    """The covariance of two views: E[xy] - E[x]E[y]."""
    m = pairs(df, x, y)
    a = first_moment(df, x).select("i", F.col("v").alias("_a"))
    b = first_moment(df, y).select(F.col("i").alias("j"), F.col("v").alias("_b"))
    return m.join(a, "i").join(b, "j").select("i", "j", (F.col("v") - F.col("_a") * F.col("_b")).alias("v"))


def collect_matrix(m: DataFrame, *shape: int) -> np.ndarray:
    """A matrix or tensor of at most MOST_CELLS cells on the driver."""
    if math.prod(shape) > MOST_CELLS:
        raise ValueError(f"{' x '.join(map(str, shape))} cells are too many for the driver: project first")
    out = np.zeros(shape)
    keys = [c for c in m.columns if c in ("i", "j", "k")]
    for r in m.select(*keys, "v").collect():
        out[tuple(r[c] for c in keys)] = r["v"]
    return out
