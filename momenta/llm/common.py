"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, which outlives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long: one row (node, root) per node of an edge.

    Each round every node moves to the neighbour (or itself) of the lowest random rank, and the edges follow; the
    graph shrinks by a constant factor in expectation. No group is gathered: rounds are aggregations with partial
    sums and equi-joins, each written to the shared folder. Self loops, nulls and repeated edges are ignored.
    """
    a, b = F.col("a"), F.col("b")
    left = saved(edges.where((a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(moves))
        ranked = lambda c: F.struct(F.xxhash64(c, seed).alias("r"), c.alias("n"))  # noqa: E731, B023
        both = left.select("a", "b").union(left.select(b.alias("a"), a.alias("b")))
        move = both.groupBy("a").agg(F.min(ranked(b)).alias("m")).select(a.alias("node"), F.least(ranked(a), F.col("m"))["n"].alias("root"))
        moves.append(move := saved(move, "moves"))
        ma, mb = move.select(F.col("node").alias("a"), F.col("root").alias("ra")), move.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = left.join(ma, "a").join(mb, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = saved(left, "edges")
    if not moves:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    label = moves[-1]
    for move in reversed(moves[:-1]):
        later = label.select(F.col("node").alias("root"), F.col("root").alias("last"))
        label = move.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return saved(label, "labels")
