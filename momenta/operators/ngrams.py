"""Vocabularies, encodings and n-gram windows of token tables (seq_id, pos, ...)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momenta.functions.text import DIGIT, LOWER, MISC, UPPER, word_class
from momenta.sources.scratch import saved


def word_counts(tokens: DataFrame, word: str = "word") -> DataFrame:
    """(word, n): partial counts meet, so a frequent word is no hot group."""
    return tokens.groupBy(word).agg(F.count("*").alias("n"))


def top_words(counts: DataFrame, k: int) -> DataFrame:
    """(word, n, tok) of the k most frequent words; of equal counts the smaller word. tok is the rank from 0."""
    best = counts.orderBy(F.col("n").desc(), "word").limit(k)
    return best.withColumn("tok", (F.row_number().over(Window.orderBy(F.col("n").desc(), "word")) - 1).cast("int"))


def sorted_ids(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, tok): tok is a word's rank in sorted order, from 0.

    Ranks come from the place in a range of the sort plus the words in the ranges before, so no task sees all words.
    """
    ranged = words.select(word).distinct().repartitionByRange(word).sortWithinPartitions(word)
    return dense_index(ranged, "tok")


def dense_index(df: DataFrame, name: str) -> DataFrame:
    """df with the number of a row in the order of partitions and the rows in them, from 0.

    Places are written down first, so that sizes and numbers are of one and the same partitioning.
    """
    place = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.expr("_at & 8589934591"))
    place = saved(place, "places")
    sizes = place.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return place.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def first_seen_ids(tokens: DataFrame, sentinels: list[str] | None = None) -> DataFrame:
    """(word, tok): ids in the order of a word's first place, behind the sentinels."""
    first = tokens.groupBy("word").agg(F.min(F.struct("seq_id", "pos")).alias("first"))
    ranked = dense_index(first.repartitionByRange("first").sortWithinPartitions("first").select("word"), "tok")
    shift = len(sentinels or [])
    ranked = ranked.select("word", (F.col("tok") + shift).alias("tok"))
    if shift:
        head = tokens.sparkSession.createDataFrame([(w, i) for i, w in enumerate(sentinels)], "word string, tok long")
        ranked = head.union(ranked)
    return ranked


def encode_top(tokens: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """(seq_id, pos, tok): the k top words keep their rank, all others get their class's number, k to k + 3."""
    number = F.create_map(*(F.lit(x) for c, i in ((UPPER, k), (DIGIT, k + 1), (LOWER, k + 2), (MISC, k + 3)) for x in (c, i)))
    # the top words are k rows by construction
    joined = tokens.join(F.broadcast(top.select("word", "tok")), "word", "left")
    return joined.select("seq_id", "pos", F.coalesce("tok", number[word_class(F.col("word"))]).cast("int").alias("tok"))


def encode_packed(docs: DataFrame, words: list[str]) -> DataFrame:
    """(seq_id, x) of docs (seq_id, ws ARRAY<STRING>) as encode_top() encodes with these words, in order of rank.

    A batch's distinct words are looked up once and its tokens take their numbers by place.
    """
    k = len(words)
    classes = {"Lu": k, "Nd": k + 1, "Ll": k + 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {w: i for i, w in enumerate(words)}
        for batch in batches:
            ws = batch["ws"]
            flat = ws.flatten().dictionary_encode()
            known = [rank.get(w, classes.get(unicodedata.category(w[0]), k + 3)) for w in flat.dictionary.to_pylist()]
            x = pa.array(known, pa.int32()).take(flat.indices)
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ws), 0).to_numpy())].astype(np.int32)
            yield pa.record_batch([batch["seq_id"], pa.ListArray.from_arrays(pa.array(ends), x)], ["seq_id", "x"])

    return docs.select(F.col("seq_id").cast("long").alias("seq_id"), "ws").mapInArrow(run, "seq_id long, x array<int>")


#: Texts whose words are held at once.
TEXTS = 500


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """Pieces of batches with text, the numbers of pieces of their texts between blanks, and the pieces, of which the empty ones are no words: text.tokenize() without a row or object for each word."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            part = batch.slice(at, TEXTS)
            text = pc.fill_null(part["text"], "")
            for blank in "\n\t\r":
                text = pc.replace_substring(text, blank, " ")
            pieces = pc.split_pattern(text, " ")
            yield part, pc.list_value_length(pieces).to_numpy(), pieces.flatten().dictionary_encode()


def text_word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (text): word_counts() of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, flat in _words(batches):
            n = np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary))
            counts = pa.record_batch([flat.dictionary, pa.array(n, pa.int64())], ["word", "n"])
            yield counts.filter(pc.not_equal(counts["word"], ""))

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_texts(docs: DataFrame, words: list[str]) -> DataFrame:
    """(seq_id, x) of docs (seq_id, text): encode_packed() of their tokens."""
    k = len(words)
    classes = {"Lu": k, "Nd": k + 1, "Ll": k + 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {w: i for i, w in enumerate(words)}
        for part, lengths, flat in _words(batches):
            known = np.array([(rank.get(w, classes.get(unicodedata.category(w[0]), k + 3)) if w else -1) for w in flat.dictionary.to_pylist()], np.int32)
            x = known[flat.indices.to_numpy()]
            before = np.r_[0, np.cumsum(x >= 0)]
            ends = before[np.r_[0, np.cumsum(lengths)]].astype(np.int32)
            yield pa.record_batch([part["seq_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(x[x >= 0]))], ["seq_id", "x"])

    return docs.select(F.col("seq_id").cast("long").alias("seq_id"), "text").mapInArrow(run, "seq_id long, x array<int>")


def pack(tokens: DataFrame, value: str = "tok", name: str = "x") -> DataFrame:
    """(seq_id, x): each sequence's values in order as an array."""
    packed = F.array_sort(F.collect_list(F.struct("pos", value)))
    return tokens.groupBy("seq_id").agg(F.transform(packed, lambda s: s[value]).alias(name))


def packed_windows(seq: DataFrame, n: int, x: str = "x") -> DataFrame:
    """(seq_id, pos, w0 .. w{n-1}) from packed sequences: windows are cut inside a row, without a shuffle."""
    col = F.col(x)
    starts = F.when(F.size(col) >= n, F.sequence(F.lit(0), F.size(col) - n)).otherwise(F.array().cast("array<int>"))
    rows = seq.select("*", F.explode(starts).alias("pos"))
    return rows.select("seq_id", "pos", *(F.get(col, F.col("pos") + k).alias(f"w{k}") for k in range(n)))


def windows(tokens: DataFrame, n: int, value: str = "tok") -> DataFrame:
    """(seq_id, pos, w0 .. w{n-1}) of a token table: every run of n values within a sequence."""
    by = Window.partitionBy("seq_id").orderBy("pos")
    out = tokens.select("seq_id", "pos", F.col(value).alias("w0"), *(F.lead(value, k).over(by).alias(f"w{k}") for k in range(1, n)), F.lead("pos", n - 1).over(by).alias("_end") if n > 1 else F.col("pos").alias("_end"))
    return out.where(F.col("_end").isNotNull()).drop("_end")


def transitions(tokens: DataFrame, value: str = "tag") -> DataFrame:
    """(seq_id, pos, prev, cur): neighbouring values."""
    by = Window.partitionBy("seq_id").orderBy("pos")
    out = tokens.select("seq_id", "pos", F.lag(value).over(by).alias("prev"), F.col(value).alias("cur"), F.lag("pos").over(by).alias("_p"))
    return out.where(F.col("_p").isNotNull()).drop("_p")


def counts(windows_: DataFrame, *keys: str) -> DataFrame:
    return windows_.groupBy(*keys).agg(F.count("*").alias("n"))


def views(trigrams: DataFrame, order: tuple[int, int, int] = (0, 2, 1)) -> DataFrame:
    """(view, x1, x2, x3, n, p): the four count tables of three views, from one table of trigram counts and one pass.

    trigrams is (w0, w1, w2, n); view 1, 2 and 3 are w[order]. Tables: 13, 12, 32 and 123; a column that a table lacks is
    null. Each table's counts sum to the number of all trigrams, so that is one row for all four.
    """
    t = trigrams.select(*(F.col(f"w{o}").alias(f"x{i + 1}") for i, o in enumerate(order)), "n")
    sets = t.groupingSets([["x1", "x3"], ["x1", "x2"], ["x2", "x3"], ["x1", "x2", "x3"]], "x1", "x2", "x3").agg(F.sum("n").alias("n"), F.grouping_id("x1", "x2", "x3").alias("g"))
    name = F.create_map(*(F.lit(v) for k in ((2, "13"), (1, "12"), (4, "32"), (0, "123")) for v in k))
    total = t.agg(F.sum("n").alias("_total"))
    sets = sets.join(F.broadcast(total))
    return sets.select(name[F.col("g").cast("int")].alias("view"), "x1", "x2", "x3", "n", (F.col("n") / F.col("_total")).alias("p"))


def share(df: DataFrame, value: str, *partition: str, name: str = "p") -> DataFrame:
    """df with value over its sum within the partition (all rows if none is named). Partitions are summed and joined, so a large one isn't gathered."""
    if not partition:
        total = df.agg(F.sum(value).alias("_total"))
        return df.join(F.broadcast(total)).withColumn(name, F.col(value) / F.col("_total")).drop("_total")
    return within(df, list(partition), F.sum(value).alias("_total")).withColumn(name, F.col(value) / F.col("_total")).drop("_total")


def within(df: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    """df with aggregates of its groups as columns behind its own; null keys are a group."""
    totals = df.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(*sums)
    joined = df.join(totals, [df[c].eqNullSafe(totals[f"_by_{c}"]) for c in by])
    return joined.drop(*(f"_by_{c}" for c in by))


def rank_in(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
