"""Line deduplication by overlapping three-line windows.

Consecutive lines are hashed, windows that occur more than once are found by an aggregation over all texts, and the
windows behind the first occurrence mark their lines; overlapping marks merge into spans, which are cut out. Texts
meet only their own marks, by doc_id; what is shuffled for the search is 16 bytes of hash and a place for each window.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import let, saved

WINDOW = 3
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, j, s, e, h1, h2): each run of `window` lines that hold a word; j counts such lines, s and e are the run's first and last line in the text."""
    full = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"].rlike(_WORD))
    hashed = F.transform(full, lambda y: F.struct(y["i"].alias("i"), F.xxhash64(y["x"]).alias("a"), F.xxhash64(F.lit(1), y["x"]).alias("b")))
    rows = docs.select("doc_id", hashed.alias("l")).where(F.size("l") >= window)
    at = lambda j, k: F.get(F.col("l"), j + k)
    run = lambda j: F.struct(
        j.alias("j"),
        at(j, 0)["i"].alias("s"),
        at(j, window - 1)["i"].alias("e"),
        F.xxhash64(*(at(j, k)["a"] for k in range(window))).alias("h1"),
        F.xxhash64(*(at(j, k)["b"] for k in range(window))).alias("h2"),
    )
    return rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - window), run)).alias("w")).select("doc_id", "w.*")


def _spans(marks: Column, window: int) -> Column:
    """Merged spans (s, e) of the sorted marks (j, s, e): windows that overlap or touch are one span."""

    def merged(m: Column) -> Column:
        starts = F.filter(m, lambda x, i: (i == 0) | (x["j"] > F.get(m, i - 1)["j"] + window))
        ends = F.filter(m, lambda x, i: F.coalesce(F.get(m, i + 1)["j"] > x["j"] + window, F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e")))

    return let(marks, merged)


def _kept(lines: Column, spans: Column) -> Column:
    """The lines outside the spans: slices between them, so the work is linear in the text."""
    edge = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))

    def pieces(s: Column) -> Column:
        gaps = F.transform(s, lambda x, i: F.struct((x["e"] + 1).alias("from"), F.get(s, i + 1)["s"].alias("to")))
        return let(lines, lambda all_: F.flatten(F.transform(gaps, lambda g: F.slice(all_, g["from"] + 1, F.greatest(F.coalesce(g["to"], F.size(all_)) - g["from"], F.lit(0))))))

    return let(F.concat(F.array(edge), spans), pieces)


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, spans) of every row of docs (doc_id, text; other columns are not read).

    A window is `window` consecutive lines that hold a word; lines without one are passed over. Of equal windows the
    one with the smallest doc_id, then the earliest, stays; the lines of all others go, with the empty lines between
    them. text is what is left, joined by newlines; n_lines counts lines that hold a word; spans are the first and last
    lines cut out, from 0. Texts with fewer such lines than a window, empty and null texts stay as they are (null as
    null). Rows that repeat a doc_id are one document: they share its windows and its spans. Rows without doc_id stay
    whole and make nothing else go. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = saved(windows(rows.where("doc_id is not null"), window), "windows")
    place = F.struct("doc_id", "j")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    marks = found.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    marks = marks.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("j", "s", "e"))).alias("marks"))
    spans = marks.select(F.col("doc_id").alias("mark_id"), _spans(F.col("marks"), window).alias("spans"))
    out = rows.join(spans, rows["doc_id"] == spans["mark_id"], "left").drop("mark_id")
    has_word = lambda x: x.rlike(_WORD)
    counted = F.size(F.filter(_lines(F.col("text")), has_word)).cast("long")
    left = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(_kept(_lines(F.col("text")), F.col("spans")), "\n"))
    out = out.select("doc_id", left.alias("text"), counted.alias("n_lines"), "spans")
    removed = F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size(F.filter(F.split("text", "\n"), has_word)))
    return out.select("doc_id", "text", "n_lines", removed.cast("long").alias("n_removed"), F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"))
