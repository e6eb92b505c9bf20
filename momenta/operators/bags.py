"""Bags (key, w) and named parameters (name, w): weighted multisets and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, w): the sum of weights, or the number of rows."""
    return df.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("w"))


def add_all(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key, "w").unionAll(b.select(key, "w")).groupBy(key).agg(F.sum("w").alias("w"))


def remove_all(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def contains_all(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (contains): whether every key of b is in a."""
    return b.join(a.select(key), key, "left_anti").agg((F.count("*") == 0).alias("contains"))


def both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, a, b) over the union of keys; a missing key weighs 0."""
    joined = a.select(key, F.col("w").alias("a")).join(b.select(key, F.col("w").alias("b")), key, "full")
    return joined.fillna(0, ["a", "b"])


def squared_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    d = F.col("a") - F.col("b")
    return both(a, b, key).agg(F.sum(d * d).alias("distance"))


def merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The union of parameters; where both have one, the right one's value."""
    joined = left.select(key, F.col("w").alias("l")).join(right.select(key, F.col("w").alias("r")), key, "full")
    return joined.select(key, F.coalesce("r", "l").alias("w"))


def axpy(left: DataFrame, right: DataFrame, key: str, s: float) -> DataFrame:
    """left + s * right on the left one's parameters."""
    joined = left.join(right.select(key, F.col("w").alias("r")), key, "left")
    return joined.select(key, (F.col("w") + s * F.coalesce("r", F.lit(0.0))).alias("w"))


def overwrite(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the right one's values where both have the parameter."""
    joined = left.join(right.select(key, F.col("w").alias("r")), key, "left")
    return joined.select(key, F.coalesce("r", "w").alias("w"))


def restrict(df: DataFrame, to: DataFrame, key: str) -> DataFrame:
    return df.join(to.select(key), key, "left_semi")


def dot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    joined = left.select(key, F.col("w").alias("l")).join(right.select(key, F.col("w").alias("r")), key)
    return joined.agg(F.sum(F.col("l") * F.col("r")).alias("dot"))
