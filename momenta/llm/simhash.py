"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most three bits, one
segment differs in at most one, so both have that segment with the same bit wildcarded: 2 x 32 one-wildcard variants
are indexed for every distinct fingerprint, equal keys meet, and each meeting is verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import components, saved

SEGMENT = 32
MAX_BITS = 3
#: Fingerprints of a key beyond which it is split.
HOT = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes that are unpacked to bits at a time.
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles, repeats included; fewer words make one shingle, none give zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[k : k + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.uint64, len(batch))
            yield pa.record_batch([batch["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among the distinct fps: breadth first, each step compares with what isn't reached yet."""
    rest, queue = fps, []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        near = np.bitwise_count(rest ^ at) <= max_bits
        for x in rest[near]:
            yield at, x
            queue.append(x)
        rest = rest[~near]


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the rows of the last key of a batch wait for the next."""
        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []

        def groups(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(key)) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(key)]
            pair = start[end - start == 2]
            pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= max_bits]
            edges = [np.stack([fp[pair], fp[pair + 1]], axis=1)]
            for s, e in zip(start[end - start > 2], end[end - start > 2], strict=True):
                if found := list(_forest(fp[s:e], max_bits)):
                    edges.append(np.array(found, np.uint64))
            both = np.concatenate(edges)
            yield pa.record_batch([pa.array(both[:, k].astype(np.uint64).view(np.int64)) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])
            if last or (keys and keys[-1][-1] != key[-1]):
                yield from groups(np.concatenate([*keys, key[:last]]), np.concatenate([*fps, fp[:last]]))
                keys, fps = [], []
            keys.append(key[last:])
            fps.append(fp[last:])
        if keys:
            yield from groups(np.concatenate(keys), np.concatenate(fps))

    return run


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the one-wildcard variants of both segments; key holds the segment, the wildcard's place and the other bits."""
    k = F.col("k")
    segment = F.expr(f"(CASE WHEN k < {SEGMENT} THEN shiftrightunsigned(fp, {SEGMENT}) ELSE fp & {2**SEGMENT - 1} END)")
    masked = segment.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, k % {SEGMENT})")))
    return fps.select("fp", F.explode(F.expr(f"sequence(0, {2 * SEGMENT - 1})")).alias("k")).select(
        F.shiftleft(k.cast("long"), SEGMENT).bitwiseOR(masked).alias("key"), "fp"
    )


def _hot_keys(fps: DataFrame, hot: int) -> DataFrame:
    """(key): keys that more than `hot` fingerprints may have, and all that have so many.

    A variant joins two values of a segment, so one of the two is on more than half as many fingerprints; two rows a
    fingerprint are counted instead of 64.
    """
    mask = 2**SEGMENT - 1
    values = fps.select(F.explode(F.expr(f"array(struct(0 AS s, shiftrightunsigned(fp, {SEGMENT}) AS v), struct(1 AS s, fp & {mask} AS v))")).alias("x")).select("x.s", "x.v")
    many = values.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot // 2)
    bit = F.explode(F.expr(f"sequence(0, {SEGMENT - 1})")).alias("b")
    key = F.expr(f"shiftleft(cast(s * {SEGMENT} + b AS bigint), {SEGMENT}) | (v & ~shiftleft(1L, b))")
    return many.select("s", "v", bit).select(key.alias("key")).distinct()


def _split(index: DataFrame, keys: DataFrame) -> DataFrame:
    """index with the rows of the keys dealt to sub-keys: two that differ in at most three bits have one of the four bytes of the segment that the key doesn't hold in common."""
    other = F.expr(f"CASE WHEN key >= 0 AND shiftright(key, {SEGMENT}) < {SEGMENT} THEN fp & {2**SEGMENT - 1} ELSE shiftrightunsigned(fp, {SEGMENT}) END")
    rows = index.join(keys.withColumn("hot", F.lit(True)), "key", "left").withColumn("other", other)
    parts = F.array(*(F.expr(f"xxhash64(key, {b}, shiftright(other, {8 * b}) & 255)") for b in range(SEGMENT // 8)))
    return rows.select(F.explode(F.when(F.col("hot"), parts).otherwise(F.array("key"))).alias("key"), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links at max_bits or fewer connect.

    Of the rows of a key, only a spanning forest of the verified links is given, not all pairs. fps holds each fp once,
    so copies of a text add nothing. Keys of more than `hot` fingerprints are split for several tasks.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments find links of 0 to 3 bits")
    index, keys = variants(fps), saved(_hot_keys(fps, hot), "hot-keys")
    if not keys.isEmpty():
        index = _split(index, keys)
    index = index.repartition("key").sortWithinPartitions("key")
    return index.mapInArrow(_links(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable by links of at most max_bits differing bits, itself included.
    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id each count and come
    back each. A null doc_id never is a component_id unless all of its component are null. An empty table gives none.
    """
    rows = saved(fingerprints(docs, shingle), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    root = components(links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = classes.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    component = linked.join(lowest, "root").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the rows whose component holds a smaller doc_id; all columns stay.

    Rows that repeat the kept doc_id are one document and all stay; rows without doc_id go if their component has one.
    """
    found = near_duplicates(docs, shingle, max_bits)
    gone = found.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")).where("not kept").drop("kept")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
