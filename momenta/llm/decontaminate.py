"""Benchmark decontamination with suffix arrays over the training text.

A task's batch of documents is a shard. Its words are numbered by the benchmark's vocabulary; runs of known words long
enough to hold a window are laid end to end and their suffixes sorted by prefix doubling. Every suffix of every
benchmark item is then found by binary search, all of them at once and word by word, which gives its longest verbatim
match and the places of it. Suffixes that start at words the benchmark doesn't have cannot match and are left out of
the array, so nothing is lost by that. Shards need no shuffle: only the benchmark travels, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import saved

WINDOW = 13
#: Contaminated from one hit word in this many.
SHARE = 20
#: Bytes of benchmark text that a task holds at a time; a larger benchmark is matched in several passes.
BLOCK_BYTES = 32 << 20

_WORD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, then runs of digits, letters a-z and anything beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


@dataclass
class Items:
    """The benchmark as arrays: its suffixes, each with its item, its words' numbers and the window that starts there."""

    ids: list[str | None]
    vocabulary: dict[bytes, int]
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    least: int
    window: int = WINDOW
    need: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = np.bincount(self.item, minlength=len(self.ids)) if len(self.item) else np.zeros(0, np.int64)
        whole = np.minimum(size, self.window)
        #: Words that a match from here has to have; more than there are if no window starts here.
        self.need = whole[self.item] if len(self.item) else np.zeros(0, np.int64)


def build_items(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, text, start, length, item, least = [], [], [], [], [], window
    for name, value in rows:
        w = words(value)
        if not w:
            continue
        least = min(least, len(w))
        start += range(len(text), len(text) + len(w))
        length += range(len(w), 0, -1)
        item += [len(ids)] * len(w)
        ids.append(None if name is None else str(name))
        text += [vocabulary.setdefault(x, len(vocabulary)) for x in w]
    as_int = lambda x: np.array(x, np.int64)
    return Items(ids, vocabulary, as_int(text), as_int(start), as_int(length), as_int(item), least, window)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text, which ends in -1, in the order of their first depth numbers at least; a -1 ends a run and sorts first."""
    n = len(text)
    rank = text + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth:
        later = np.zeros(n, np.int64)
        later[: max(n - k, 0)] = rank[k:]
        later[rank == 0] = 0
        key = rank * (rank.max() + 1) + later
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        k *= 2
    return order


def _bound(column, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """For each i the first place in [low, high) whose number is not less (right: greater) than value; column(places) gives numbers."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        x = column(np.where(open_, mid, 0))
        less = open_ & ((x <= value) if right else (x < value))
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def search(text: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every benchmark suffix: the length of its longest match, a place of it in text, and the range of the suffix array where its window (or item) is.

    The range is empty where the window doesn't occur; matches go on to the suffix's end, beyond the window.
    """
    n, m = len(text), len(items.start)
    padded = np.r_[text, -1]
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    longest, where, first, last = (np.zeros(m, np.int64) for _ in range(4))
    live, depth = np.arange(m), 0
    while len(live):
        value = items.text[items.start[live] + depth]
        column = lambda at: padded[np.minimum(order[at] + depth, n)]  # noqa: E731, B023
        a = _bound(column, low[live], high[live], value, False)
        b = _bound(column, a, high[live], value, True)
        low[live], high[live] = a, b
        live, depth = live[b > a], depth + 1
        longest[live] = depth
        where[live] = order[low[live]]
        full = live[items.need[live] == depth]
        first[full], last[full] = low[full], high[full]
        live = live[items.length[live] > depth]
    return longest, where, first, last


class Shard:
    """The suffix array of a batch of texts, as far as it can match the items."""

    def __init__(self, texts: list[str | None], items: Items):
        self.items = items
        known = [np.fromiter(map(items.vocabulary.get, w := words(t), [-1] * len(w)), np.int64, len(w)) for t in texts]
        self.n_words = np.array([len(k) for k in known], np.int64)
        self.offset = np.r_[0, np.cumsum(self.n_words + 1)]
        flat = np.full(self.offset[-1], -1, np.int64)
        for at, k in zip(self.offset, known, strict=False):
            flat[at : at + len(k)] = k
        # runs of known words that can hold a window, with the -1 after each
        edge = np.flatnonzero(np.diff(np.r_[False, flat >= 0, False].astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        long_enough = end - start >= items.least
        start, end = start[long_enough], end[long_enough] + 1
        size = end - start
        self.place = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        self.text = flat[self.place]
        self.order = suffix_array(self.text, int(items.length.max(initial=1))) if len(self.text) else np.zeros(0, np.int64)

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix of the benchmark, document of the batch, word in it) of every occurrence of a window."""
        _, _, first, last = search(self.text, self.order, self.items)
        count = last - first
        suffix = np.repeat(np.arange(len(count)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = self.place[self.order[first[suffix] + inner]] if len(suffix) else np.zeros(0, np.int64)
        doc = np.searchsorted(self.offset, at, side="right") - 1
        return suffix, doc, at - self.offset[doc]

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(suffix of the benchmark, length, document of the batch, word in it) of the longest match of each suffix that has one of a window's length or more."""
        length, where, _, _ = search(self.text, self.order, self.items)
        suffix = np.flatnonzero((length >= self.items.need) & (length > 0))
        at = self.place[where[suffix]] if len(suffix) else np.zeros(0, np.int64)
        doc = np.searchsorted(self.offset, at, side="right") - 1
        return suffix, length[suffix], doc, at - self.offset[doc]


def _contained(doc: np.ndarray, at: np.ndarray, n: int, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Marks of all words of the shard that lie in [at, at + size) of their document."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, offset[doc] + at, 1)
    np.add.at(marks, offset[doc] + at + size, -1)
    return np.cumsum(marks[:-1]) > 0


def _pass(items: Items, last: bool):
    """One block of the benchmark against a batch. spans (start, end of hit words) and items gather over the passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = Shard(batch["text"].to_pylist(), items)
            suffix, doc, at = shard.matches()
            found: list[set[str | None]] = [set(x or ()) for x in batch["items"].to_pylist()]
            for d, i in {*zip(doc.tolist(), items.item[suffix].tolist(), strict=True)}:
                found[d].add(items.ids[i])
            size = items.need[suffix]
            old = [(d, s, e) for d, x in enumerate(batch["spans"].to_pylist()) for s, e in zip(x[::2], x[1::2], strict=True)] if batch["spans"].null_count < len(batch) else []
            if old:
                o = np.array(old, np.int64)
                doc, at, size = np.r_[doc, o[:, 0]], np.r_[at, o[:, 1]], np.r_[size, o[:, 2] - o[:, 1]]
            hit = _contained(doc, at, int(shard.offset[-1]), size, shard.offset)
            cut = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).reshape(-1, 2)
            of = np.searchsorted(shard.offset, cut[:, 0], side="right") - 1
            spans: list[list[int]] = [[] for _ in range(len(batch))]
            for d, (s, e) in zip(of.tolist(), (cut - shard.offset[of][:, None]).tolist(), strict=True):
                spans[d] += [s, e]
            ordered = [sorted(x, key=lambda i: (i is not None, i or "")) for x in found]
            keep = [batch["row"], batch["text"] if not last else pa.nulls(len(batch), pa.string())]
            yield pa.record_batch(
                [*keep, pa.array(shard.n_words), pa.array(spans, pa.list_(pa.int64())), pa.array(ordered, pa.list_(pa.string()))],
                ["row", "text", "n_words", "spans", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark as Items in blocks of about block_bytes of text, and whether it is the last."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield build_items([tuple(r) for r in part.collect()], window), k == blocks - 1


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, at, length, doc_id, place): for every benchmark suffix (item_id, word at) its longest verbatim match in docs and where that is.

    Only matches of a window (or a whole shorter item) and more are given; of equally long ones that of the smallest
    doc_id, then place. A shard sends one row for a suffix at most; the rows meet by aggregation.
    """
    parts = []
    for items, _ in _blocks(benchmark, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            use = shared.value
            inside = np.arange(len(use.item)) - np.searchsorted(use.item, use.item)
            for batch in batches:
                suffix, length, doc, place = Shard(batch["text"].to_pylist(), use).longest()
                names = pa.array([use.ids[i] for i in use.item[suffix]], pa.string())
                yield pa.record_batch([names, pa.array(inside[suffix]), pa.array(length), batch["doc_id"].take(pa.array(doc)), pa.array(place)], ["item_id", "at", "length", "doc_id", "place"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        parts.append(rows.mapInArrow(run, "item_id string, at long, length long, doc_id long, place long"))
    best = reduce(DataFrame.unionAll, parts).groupBy("item_id", "at").agg(F.min(F.struct((-F.col("length")).alias("n"), "doc_id", "place")).alias("b"))
    return best.select("item_id", "at", (-F.col("b.n")).alias("length"), "b.doc_id", "b.place")


def _matched(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(row, n_words, spans, items) of rows (row, text), where row is a struct that goes through the tasks as it is."""
    spark = rows.sparkSession
    df = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<long>"), "items": F.lit(None).cast("array<string>")})
    for items, last in _blocks(benchmark, window, block_bytes):
        # a block of the benchmark is a broadcast variable of bounded size
        shared = spark.sparkContext.broadcast(items)
        df = df.mapInArrow(lambda it, shared=shared, last=last: _pass(shared.value, last)(it), df.schema)
        if not last:
            df = saved(df, "matches")
    return df.drop("text")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of docs (doc_id, text): hit words and the items whose windows occur.

    spans holds starts and ends of runs of hit words, in turn; items are item_ids as strings, sorted. benchmark is
    (item_id, text); a window is `window` consecutive words of an item, or a whole item of fewer. Null and empty texts
    have no words and no windows. Rows that repeat a doc_id each come back; items that repeat an item_id are one. Items
    without item_id hit like others and are together one item, null, which comes first in items. The benchmark is read
    to the tasks in blocks of about block_bytes of text (or one row), one pass over docs for each.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    return _matched(rows, benchmark, window, block_bytes).select("row.doc_id", "n_words", "spans", "items")


def _hits() -> Column:
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def _contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """matches() summed up: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (one hit word in `share` or more).

    n_items counts the item without item_id; items_sha256 is of the others.
    """
    found = matches(docs, benchmark, window)
    found = found.select("doc_id", "n_words", _hits().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", _contaminated(share))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs without the contaminated rows; all columns stay. Each row is judged by its own text, in the task that reads it."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    found = _matched(rows, benchmark, window, BLOCK_BYTES).withColumn("n_hit", _hits())
    return found.where(~_contaminated(share)).select("row.*")
