"""Counting and scoring with labels: supervised chains, confusion and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momenta.operators.ngrams import share, transitions
from momenta.plans.small import best_matching


def _stochastic(counts: DataFrame, smoothing: float, group: list[str]) -> DataFrame:
    return share(counts.withColumn("n", F.col("n") + smoothing), "n", *group)


def supervised_chain(tokens: DataFrame, smoothing: float = 0.0, first_only: bool = False) -> DataFrame:
    """(kind, h1, h2, p) from labelled tokens (seq_id, pos, tok, tag): kind pi over tags, T over (tag, next tag), O over (tag, token).

    pi counts every position, or only the first of a sequence. With smoothing every cell of the grid of tags and
    tokens that occur counts that much more; the grid is of the parameters' own size.
    """
    tags = tokens.select(F.col("tag").alias("h1")).distinct()
    words = tokens.select(F.col("tok").alias("h2")).distinct()
    seen = tokens.where("pos = 0") if first_only else tokens
    pi = seen.groupBy(F.col("tag").alias("h1")).agg(F.count("*").alias("n"))
    t = transitions(tokens, "tag").groupBy(F.col("prev").alias("h1"), F.col("cur").alias("h2")).agg(F.count("*").alias("n"))
    o = tokens.groupBy(F.col("tag").alias("h1"), F.col("tok").alias("h2")).agg(F.count("*").alias("n"))
    if smoothing:
        pi = tags.join(pi, "h1", "left").fillna(0, ["n"])
        t = tags.crossJoin(tags.withColumnRenamed("h1", "h2")).join(t, ["h1", "h2"], "left").fillna(0, ["n"])
        o = tags.crossJoin(words).join(o, ["h1", "h2"], "left").fillna(0, ["n"])
    cells = [("pi", pi.withColumn("h2", F.lit(None).cast("string")), []), ("T", t, ["h1"]), ("O", o, ["h1"])]
    parts = [_stochastic(df, smoothing, g).select(F.lit(k).alias("kind"), F.col("h1").cast("string").alias("h1"), F.col("h2").cast("string").alias("h2"), "p") for k, df, g in cells]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def feature_counts(tokens: DataFrame) -> DataFrame:
    """(kind, h1, h2, n): counts of (tag, token) and (previous tag, tag)."""
    o = tokens.groupBy(F.col("tag").cast("string").alias("h1"), F.col("tok").cast("string").alias("h2")).agg(F.count("*").alias("n"))
    t = transitions(tokens, "tag").groupBy(F.col("prev").cast("string").alias("h1"), F.col("cur").cast("string").alias("h2")).agg(F.count("*").alias("n"))
    return o.select(F.lit("unary").alias("kind"), "*").unionAll(t.select(F.lit("binary").alias("kind"), "*"))


def bag_feature_counts(rows: DataFrame) -> DataFrame:
    """(kind, h1, h2, n): counts of (label, token) and of labels over labelled bags (seq_id, bag, place, tok, tag); a bag's label is that at place 0."""
    rows = rows.withColumn("h", F.max(F.when(F.col("place") == 0, F.col("tag"))).over(Window.partitionBy("seq_id", "bag")).cast("string"))
    o = rows.groupBy(F.col("h").alias("h1"), F.col("tok").cast("string").alias("h2")).agg(F.count("*").alias("n"))
    bags = rows.where("place = 0").groupBy(F.col("h").alias("h1")).agg(F.count("*").alias("n"))
    return o.select(F.lit("unary").alias("kind"), "h1", "h2", "n").unionAll(bags.select(F.lit("state"), "h1", F.lit(None).cast("string"), "n"))


def grid_feature_counts(rows: DataFrame) -> DataFrame:
    """(kind, h1, h2, n): counts of (label, token) and of neighbouring labels, down and across, over grids (seq_id, r, c, d, tok, tag); a cell's label is that of its symbol 0.

    Cells are gathered once, so a cell's symbols and label need no join; cells meet their neighbours by one equality join.
    """
    cells = rows.groupBy("seq_id", "r", "c").agg(F.max(F.when(F.col("d") == 0, F.col("tag"))).cast("string").alias("h"), F.collect_list("tok").alias("x")).where("h IS NOT NULL")
    o = cells.select("h", F.explode("x").alias("tok")).groupBy(F.col("h").alias("h1"), F.col("tok").cast("string").alias("h2")).agg(F.count("*").alias("n"))
    shifted = F.explode(F.array(F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c")), F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c"))))
    first = cells.select("seq_id", F.col("h").alias("h1"), shifted.alias("to")).select("seq_id", "h1", "to.*")
    pairs = first.join(cells.select("seq_id", "r", "c", F.col("h").alias("h2")), ["seq_id", "r", "c"]).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return o.select(F.lit("unary").alias("kind"), "h1", "h2", "n").unionAll(pairs.select(F.lit("binary"), "h1", "h2", "n"))


def top_emissions(emissions: DataFrame, m: int) -> DataFrame:
    """The m likeliest tokens of each state, their probabilities summing to 1 again; of equal ones the smaller token. Tasks pass on m rows of a state."""
    best = emissions.withColumn("_r", F.row_number().over(Window.partitionBy("h1").orderBy(F.col("p").desc(), "h2"))).where(F.col("_r") <= m).drop("_r")
    return best.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("h1")))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def many_to_one(conf: DataFrame) -> DataFrame:
    """One row (accuracy): every predicted label stands for the gold label it meets most often."""
    return conf.groupBy("pred").agg(F.max("n").alias("best"), F.sum("n").alias("n")).agg((F.sum("best") / F.sum("n")).alias("accuracy"))


def one_to_one(conf: DataFrame) -> DataFrame:
    """(gold, pred, n, accuracy) of the matching of labels with the most hits; the table of labels, of which there are some thousands at most, is matched on the driver."""
    rows = conf.collect()
    gold, pred = sorted({r.gold for r in rows}, key=str), sorted({r.pred for r in rows}, key=str)
    n = {(r.gold, r.pred): r.n for r in rows}
    pairs = best_matching([[-n.get((g, p), 0) for p in pred] for g in gold])
    total = sum(n.values()) or 1
    accuracy = sum(n.get((gold[a], pred[b]), 0) for a, b in pairs) / total
    out = [(str(gold[a]), str(pred[b]), n.get((gold[a], pred[b]), 0), accuracy) for a, b in pairs]
    return conf.sparkSession.createDataFrame(out, "gold string, pred string, n long, accuracy double")
