"""Near copies by five-word shingles: long SimHash prints, deletion-variant signatures, exact similarity.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. At that similarity a
64-bit print of shingles differs in too many bits for two segments, so the print is longer and steadier: nine segments
of 32 bits over the distinct words (which count threefold) and word pairs of a text, as a change of one word changes
five shingles. Most linked texts have a segment that differs in at most one bit; its one-wildcard variants meet by
equality, and what meets is verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import components, saved

SHINGLE = 5
SEGMENT = 32
SEGMENTS = 9
#: Differing bits of 32 further ones, up to which texts of one key are compared (linked texts differ in 2 or 3 of them).
CHECK = 9
#: Bits of a mask over ids, at most (a power of two: 8 MB).
MASK_BITS = 26
#: Votes of a word in the print; a pair of words has one.
WEIGHT = 3
#: Runs of edges that are handed on at once.
MANY = 1024
#: Rounds in which the pieces of a family meet again; in the last one all that counts leave room for is verified.
ROUNDS = 2
#: Parts of the shingles, by hash, that a sketch counts.
PARTS = 64
PRINT = [f"p{i}" for i in range((SEGMENTS + 1) // 2)]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEPS = np.arange(1, len(PRINT) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Features whose bits are unpacked at a time.
_BLOCK = 1 << 13


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hashes(grams) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)


def text_hash(words: list[bytes]) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(b" ".join(words), 42)


def long_print(words: list[bytes]) -> np.ndarray:
    """Majority bits over the distinct words (WEIGHT votes each) and word pairs (one each), 64 in each number; no words give zeros."""
    single, pairs = _hashes(set(words)), _hashes(set(map(b" ".join, zip(words, words[1:], strict=False))))
    return np.packbits(2 * (WEIGHT * _ones(single) + _ones(pairs)) > WEIGHT * len(single) + len(pairs)).view(">u8").astype(np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit of the print set."""
    ones = np.zeros(64 * len(PRINT), np.int64)
    for k in range(0, len(h), _BLOCK):
        x = h[k : k + _BLOCK, None] ^ _STEPS
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the five-word shingles; fewer words make one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_hashes(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]))


def _id(prints: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The last 32 bits of the print, then 32 of the words' hash: equal for equal words, and fit for a first comparison."""
    return (prints[..., -1] << np.uint64(32)) | hashes


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, id, p0 ..) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, hashes = np.zeros((len(b), len(PRINT)), np.uint64), np.zeros(len(b), np.uint64)
            for i, t in enumerate(b["text"]):
                w = words_of(t.as_py())
                found[i], hashes[i] = long_print(w), text_hash(w)
            ids = _id(found, hashes)
            yield pa.record_batch([b["doc_id"], *(pa.array(c.view(np.int64)) for c in (ids, *np.ascontiguousarray(found.T)))], ["doc_id", "id", *PRINT])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "id", *PRINT))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def variants(classes: DataFrame, *more: str) -> DataFrame:
    """(key, id, ..): the one-wildcard variants of all segments; key holds the segment and the wildcard's place, and the other bits."""
    half = f"element_at(array({', '.join(PRINT)}), cast(k div {2 * SEGMENT} AS int) + 1)"
    segment = f"(CASE WHEN (k div {SEGMENT}) % 2 = 0 THEN shiftrightunsigned({half}, {SEGMENT}) ELSE {half} & {2**SEGMENT - 1} END)"
    key = F.expr(f"shiftleft(cast(k AS bigint), {SEGMENT}) | ({segment} & ~shiftleft(1L, k % {SEGMENT}))")
    return classes.select("id", *PRINT, *more, F.explode(F.expr(f"sequence(0, {SEGMENTS * SEGMENT - 1})")).alias("k")).select(key.alias("key"), "id", *more)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b) >> np.uint64(32)) > CHECK


def _room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether counts leave room for a similarity of 4/5: no more shingles are common than the lesser counts of all parts make together."""
    if not b.shape[-1]:
        return np.ones(len(b), bool)
    return 9 * np.minimum(a[..., 1:], b[..., 1:]).sum(axis=-1) >= 4 * (a[..., 0] + b[..., 0])


def _near(ids: np.ndarray, counts: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Those of the places `among` that may be linked to place k."""
    among = among[~_far(ids[among], ids[k])]
    return among[_room(counts[k], counts[among])]


def _stars(seed: int) -> Callable:
    """Edges among the near ids of a key, in steps: the first id in an order by seed meets all others that are not of its piece, the first of those
    meets all of the first one's piece; what only an id so reached is near to meets that one. No more edges than ids for each step, and ids of one
    family share their first."""

    def edges(ids: np.ndarray, roots: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        mixed = (ids ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 2**64 - 1)) * np.uint64(0xD6E8FEB86659FD93)
        rest, queue = np.argsort(mixed ^ (mixed >> np.uint64(32))), []
        away = np.ones(len(ids), bool)
        while len(rest):
            if begins := not queue:
                queue, rest = [rest[0]], rest[1:]
            first = queue.pop(0)
            near = _near(ids, counts, rest, first)
            met_by = near[roots[near] != roots[first]]
            yield _edges(ids[met_by], ids[first])
            if begins and len(met_by):
                yield _edges(ids[_near(ids, counts, rest[roots[rest] == roots[first]], met_by[0])], ids[met_by[0]])
            queue.extend(near)
            away[near] = False
            rest = rest[away[rest]]

    return edges


def _between(ids: np.ndarray, roots: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """All near ids of different pieces."""
    for i in range(len(ids) - 1):
        yield _edges(ids[_near(ids, counts, i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i]), i)], ids[i])


def _edges(ids: np.ndarray, at: np.uint64) -> np.ndarray:
    return np.stack([np.minimum(ids, at), np.maximum(ids, at)], axis=1)


def _sketch(held: np.ndarray, size: int) -> bytes:
    """size, a unit, and how many units (rounded up) of the shingles in held fall in each part."""
    counts = np.bincount((held.view(np.uint64) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
    unit = max(1, -(-int(counts.max()) // 255))
    return np.array([size, unit], "<u4").tobytes() + (-(-counts // unit)).astype(np.uint8).tobytes()


def _counts(sketches: np.ndarray) -> np.ndarray:
    """From sketches, a row of bytes each: the size and the counts of the parts, none of them too small. Rows without bytes give none."""
    if not sketches.shape[1]:
        return np.zeros((len(sketches), 0), np.int64)
    size, unit = np.ascontiguousarray(sketches[:, :8]).view("<u4").astype(np.int64).T
    return np.column_stack([size, sketches[:, 8:].astype(np.int64) * unit[:, None]])


def sketches(sets: DataFrame, family: DataFrame) -> DataFrame:
    """(id, sketch) of those ids of family (id, family) that may be linked to another of theirs; sets has the shingles of all.

    A shingle that no other id of the family has is common to no two of them. A sketch counts the others, so the lesser
    counts of two sketches bound how many are common; who holds less than 4/5 of its shingles with others has no link.
    """
    of = sets.join(family, "id")
    each = of.select("id", "family", F.explode("grams").alias("gram")).groupBy("family", "gram").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    lone = each.where("n = 1").groupBy("id").agg(F.collect_list("gram").alias("lone"))
    held = F.array_except("grams", F.coalesce("lone", F.array().cast("array<bigint>")))
    some = of.join(lone, "id", "left").select("id", F.size("grams").alias("size"), held.alias("held")).where(5 * F.size("held") >= 4 * F.col("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_sketch(np.array(h.values.to_numpy(), np.int64), n.as_py()) for h, n in zip(b["held"], b["size"], strict=True)]
            yield pa.record_batch([b["id"], pa.array(found, pa.binary())], ["id", "sketch"])

    return some.mapInArrow(run, "id long, sketch binary")


def met(index: DataFrame, edges: Callable) -> DataFrame:
    """(a, b) distinct: the edges among the ids of each key of index (key, id, root; sketch, if it has any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the rows of the last key of a batch wait for the next."""
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def as_batch(found: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate([np.zeros((0, 2), np.uint64), *found])
            return pa.record_batch([pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

        def groups(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            (keys, ids, roots), sketch = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
            ids, cut = ids.view(np.uint64), np.flatnonzero(np.diff(keys)) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(keys)]
            several = np.minimum.reduceat(roots, start) != np.maximum.reduceat(roots, start)
            start, end = start[several], end[several]
            pair = start[end - start == 2]
            pair = pair[~_far(ids[pair], ids[pair + 1])]
            pair = pair[_room(_counts(sketch[pair]), _counts(sketch[pair + 1]))]
            found = [np.sort(np.stack([ids[pair], ids[pair + 1]], axis=1), axis=1)]
            for s, e in zip(start[end - start > 2], end[end - start > 2], strict=True):
                for new in edges(ids[s:e], roots[s:e], _counts(sketch[s:e])):
                    if len(new):
                        found.append(new)
                    if len(found) == MANY:
                        yield as_batch(found)
                        found = []
            yield as_batch(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch[c].to_numpy() for c in ("key", "id", "root")])
            sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            last = np.searchsorted(rows[0], rows[0][-1])
            if last or (kept and kept[-1][0][0][-1] != rows[0][-1]):
                yield from groups([*kept, (rows[:, :last], sketch[:last])])
                kept = []
            kept.append((rows[:, last:], sketch[last:]))
        if kept:
            yield from groups(kept)

    if "root" not in index.columns:
        index = index.withColumn("root", F.col("id"))
    by_key = index.repartition("key").sortWithinPartitions("key")
    if "sketch" not in index.columns:
        by_key = by_key.withColumn("sketch", F.lit(b""))
    return by_key.select("key", "id", "root", "sketch").mapInArrow(run, "a long, b long").distinct()


def _slot(c: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - bits)


def mask_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A mask of at most 8 MB with a bit set for every id of ids (id; null too), and the bits of a place in it."""
    bits = min(max(10, math.ceil(math.log2(16 * ids.count() + 1))), MASK_BITS)
    place = _slot(F.col("id"), bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), {64 - bits}) & 63 AS int))")
    found = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    mask = np.zeros(1 << (bits - 6), np.int64)
    mask[found["word"].to_numpy()] = found["bits"].to_numpy()
    return mask, bits


def _row(df: DataFrame, mask: np.ndarray) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(pa.table({"mask__": pa.array([mask], pa.list_(pa.int64()))})))


def _bit(c: Column, bits: int) -> Column:
    """The bit of mask__ that belongs to c."""
    return F.getbit(F.get("mask__", F.shiftright(_slot(c, bits), 6).cast("int")), _slot(c, bits).bitwiseAND(F.lit(63)).cast("int"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among gone (id; null too); only texts that a mask of these ids lets through are shuffled."""
    mask, bits = mask_of(gone)
    bit, marked = _bit(F.col("doc_id").cast("long"), bits), docs.crossJoin(_row(docs, mask))
    some = marked.where(bit == 1).drop("mask__")
    rest = some.join(gone.select(F.col("id").alias("gone__")), some["doc_id"].cast("long").eqNullSafe(F.col("gone__")), "left_anti")
    return marked.where(bit == 0).drop("mask__").unionByName(rest)


def shingle_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(id, grams) of the texts whose id is in need (id): once for each id. Texts are read again; a mask over the words' hashes spares most the work."""
    mask, bits = mask_of(need.select(F.col("id").bitwiseAND(F.lit(2**32 - 1)).alias("id")).distinct())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["text"], pa.array([text_hash(words_of(t.as_py())) for t in b["text"]], pa.int64())], ["text", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = dict(zip(b["text"].to_pylist(), b["h"].to_pylist(), strict=True))
            ids, grams = [], []
            for t, h in hashes.items():
                w = words_of(t)
                ids.append(int(_id(long_print(w), np.uint64(h)).view(np.int64)))
                grams.append(shingles(w).view(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], ["id", "grams"])

    texts = docs.select(F.col("text").cast("string")).mapInArrow(hashed, "text string, h long")
    some = texts.crossJoin(_row(texts, mask)).where(_bit(F.col("h"), bits) == 1).select("text", "h")
    return some.mapInArrow(run, "id long, grams array<bigint>").join(need, "id", "left_semi").groupBy("id").agg(F.first("grams").alias("grams"))


def sets_of(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, grams) of all ends of edges (a, b)."""
    need = saved(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "met-ids")
    return saved(shingle_sets(docs, need), "shingle-sets")


def compared(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """edges (a, b) with `linked`: whether the five-word shingle sets have a similarity of 4/5 or more."""
    a, b = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    common = F.size(F.array_intersect("ga", "gb"))
    linked = (common > 0) & (9 * common >= 4 * (F.size("ga") + F.size("gb")))
    return saved(edges.join(a, "a").join(b, "b").select("a", "b", linked.alias("linked")), "verified")


def verified(edges: DataFrame, docs: DataFrame) -> DataFrame:
    return compared(edges, sets_of(edges, docs))


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified edges (a, b) between ids that connect all that verified meetings connect.

    A key first gives stars, not all pairs. Where an edge of a star fails, stars may have left out one that holds: what
    such stars connect meets again, piece by piece, about other ids, and in the last of ROUNDS all meetings between the
    pieces left. Only meetings that the sketches leave room for are verified; the others are no links for certain.
    """
    edges = saved(met(variants(classes), _stars(0)), "met")
    sets = sets_of(edges, docs)
    seen = compared(edges, sets)
    if seen.where("not linked").isEmpty():
        return seen.select("a", "b")
    family = components(seen.select("a", "b")).select(F.col("node").alias("id"), F.col("root").alias("family"))
    some = None
    for step in range(1, ROUNDS + 1):
        piece = components(seen.where("linked").select("a", "b")).withColumnRenamed("node", "id")
        roots = family.join(piece, "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = roots.groupBy("family").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("family")
        nodes = saved(roots.join(open_, "family", "left_semi"), "open")
        if some is None:
            some = saved(classes.join(sketches(sets, nodes.select("id", "family")), "id"), "sketches")
        index = variants(some.join(nodes.select("id", "root"), "id"), "root", "sketch")
        more = met(index, _between if step == ROUNDS else _stars(step))
        more = saved(more.join(seen, ["a", "b"], "left_anti"), "met-again")
        seen = seen.unionByName(compared(more, sets))
    return seen.where("linked").select("a", "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, id, component_id) for every row of docs (doc_id, text; other columns are not read).

    Texts of equal words (A-Z lower-cased) share an id; component_id is the smallest doc_id reachable by links, itself
    included. Null and empty texts and texts without a word are copies of each other and of nothing else. Rows that repeat
    a doc_id each count and come back each. A null doc_id never is a component_id unless all of its component are null.
    An empty table gives none.
    """
    rows = saved(prints(docs), "prints")
    classes = saved(rows.groupBy("id").agg(F.min("doc_id").alias("first"), *(F.min(p).alias(p) for p in PRINT)), "print-classes")
    root = components(links(classes, docs)).withColumnRenamed("node", "id")
    linked = classes.select("id", "first").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "id").join(linked.join(lowest, "root").select("id", "component_id"), "id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component holds a smaller doc_id; all columns stay.

    Rows that repeat the kept doc_id are one document and all stay; rows without doc_id go if their component has one.
    """
    kept = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = near_copies(docs).groupBy(F.col("doc_id").alias("id")).agg(kept.alias("kept")).where("not kept").select("id")
    return without(docs, saved(gone, "gone-ids"))
