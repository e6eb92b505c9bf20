"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash of its id. Sizes are summed by source and the hash's first bits; running sums find
the bucket in which a source's budget ends, and only that bucket is opened with the next bits, down to one hash. The
result is a threshold for each source, and the mix is the documents whose hash lies below it: nothing is sorted, a
smaller budget takes a subset of what a larger one takes, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momenta.llm.common import saved

#: Bits opened by each histogram; together the 60 bits of the hash.
LEVELS = (12, 12, 12, 12, 12)
BITS = sum(LEVELS)
#: No source is taken more often than this, and no document.
MAX_EPOCHS = 3
#: Weights of the sources, in order of code points, null last, repeating.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def hash60(doc_id: Column, seed: int = 0) -> Column:
    """The first 60 bits of md5(seed:doc_id), from 0 to 2^60 - 1."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The whole of all sizes is shared by weight. A source whose share is above max_epochs times its size gets that, and
    the excess is shared anew by weight until none is above: with sources by size / weight, smallest first, those in
    front of the first that stays below are capped, and running sums tell which. A table of sources, not of documents:
    one task orders all of them, which suits up to some millions of sources.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    df = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    before = every.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "capped": max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "rest_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(every),
        }
    )
    level = (F.col("total") - F.col("capped")) / F.col("rest_weight")
    df = df.withColumn("level", F.max(F.when(level * F.col("weight") <= max_epochs * F.col("source_size"), level)).over(every))
    # the first source that stays below its cap sets the level of all; with none below, every source is at its cap
    cap = (max_epochs * F.col("source_size")).cast("double")
    return df.select("source", "source_size", F.when(F.col("level").isNull(), cap).otherwise(F.least(F.col("level") * F.col("weight"), cap)).alias("target"))


def _bucket(level: int) -> Column:
    below = BITS - sum(LEVELS[: level + 1])
    return F.shiftright("h", below)


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): documents with h < cut make up the source's budget as nearly as whole hashes can.

    rows is (source, h, size), budgets (source, budget). A level sums sizes by bucket, adds what lies before the opened
    bucket, and opens the bucket in which the budget ends; the last level's buckets are single hashes, and the one in
    which the budget ends is taken if that comes nearer to it.
    """
    inside, state = rows, budgets.withColumns({"open": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for level in range(len(LEVELS)):
        hist = inside.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("size").over(upto)).withColumnRenamed("source", "hist_source")
        state = state.select("source", "budget", "before")
        joined = state.join(hist, state["source"].eqNullSafe(hist["hist_source"]), "left").withColumn("upto", F.col("before") + F.col("upto"))
        # the first bucket whose running sum passes the budget; none: all is taken
        passing = F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "upto"))
        state = joined.groupBy("source", "budget").agg(F.min(passing).alias("p"))
        state = state.select("source", "budget", F.col("p.bucket").alias("open"), F.col("p.before").alias("before"), F.col("p.upto").alias("upto"))
        state = saved(state, "thresholds")
        if level < len(LEVELS) - 1:
            s = state.select(F.col("source").alias("s"), "open")
            inside = inside.join(s, inside["source"].eqNullSafe(s["s"]) & (_bucket(level) == s["open"]), "left_semi")
            if level == 0:
                inside = saved(inside, "boundary")
    near = F.col("upto") - F.col("budget") < F.col("budget") - F.col("before")
    cut = F.when(F.col("open").isNull(), F.lit(2**BITS)).when(near, F.col("open") + 1).otherwise(F.col("open"))
    return state.select("source", cut.alias("cut"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, h) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("h", hash60(F.col("doc_id"), seed))


def _plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(plan_source, source_size, target, whole, cut): a row for each source, from the rows of _sized."""
    plan = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "targets")
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.least(whole, F.lit(max_epochs))).otherwise(F.lit(0)).cast("long"))
    budgets = plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = _thresholds(rows.select("source", "h", "size"), budgets).withColumnRenamed("source", "cut_source")
    plan = plan.join(cuts, plan["source"].eqNullSafe(cuts["cut_source"])).drop("cut_source").withColumnRenamed("source", "plan_source")
    return saved(plan, "plan")


def _copies(max_epochs: int) -> Column:
    """How often a row (h) with its source's plan is taken.

    A source at its limit has no budget beyond the whole copies, so its cut is 0 and nothing exceeds max_epochs.
    """
    once_more = F.when((F.col("whole") < max_epochs) & (F.col("h") < F.col("cut")), 1).otherwise(0)
    return F.when(F.col("source_size") > 0, F.col("whole") + once_more).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of docs (doc_id, text, source).

    size counts words of the whole text (null: 0), target is the words that the row's source is to give, copies how
    often the mix takes the document: the whole part of target / source_size for all documents of a source, and once
    more for those below its threshold. taken = copies * size. Rows that repeat a doc_id have one hash and go together;
    so do rows without doc_id. A null source is a source of its own, last in order. A source without words takes none
    of the total; its documents have no copies. An empty table gives none.
    """
    rows = saved(_sized(docs, seed), "sizes")
    plan = _plan(rows, weights, max_epochs)
    out = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).withColumn("copies", _copies(max_epochs))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as mix() takes it; all columns stay.

    A row's copies follow from its doc_id and its source's threshold, so texts are read with the plan of the sources
    (a small table) and never meet by doc_id.
    """
    plan = _plan(saved(_sized(docs, seed), "sizes"), weights, max_epochs)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("source").cast("string").alias("own_source"), hash60(F.col("doc_id").cast("long"), seed).alias("h"))
    out = rows.join(plan, rows["own_source"].eqNullSafe(plan["plan_source"])).withColumn("copies", _copies(max_epochs)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
