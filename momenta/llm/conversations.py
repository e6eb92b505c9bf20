"""Repair of conversations: weighted CYK over the rows of each conversation with a grammar of edits.

The target is a sequence of role initials, s? (u a)+ or nothing. Its grammar is in Chomsky normal form: a nonterminal (p, q)
spans rows that take the repaired conversation from last initial p to last initial q, (p, q) -> (p, r) (r, q) joins two spans,
and (p, q) -> row keeps, reroles or deletes one. A cell holds the least (cost, audit) of a nonterminal over a span; cells of
one row are closed under insertions, and longer spans are filled bottom-up by length. Two audits of equal cost on one span
are never a prefix of each other (the audit fixes the cost), so the least of joined spans joins least spans, and blocks of
BLOCK rows can be parsed first and become the leaves of a parse over blocks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import saved

#: Initials that may follow each last initial; the first is that of an empty conversation.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FINAL = ("", "a")
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
ROLES = {"u": "user", "a": "assistant"}
#: Leaves of one parse; longer conversations are parsed by blocks, whose cells are leaves again.
BLOCK = 16
#: Conversations of more rows are parsed by many tasks.
LONG = 2048

COUNTED = ("blank", "duplicate", "truncated", "illegal")
_COUNTS = ", ".join(f"{c} long" for c in COUNTED)
PIECE = f"conv_id long, piece long, {_COUNTS}, first string, last string, cells array<struct<p:string,q:string,cost:long,audit:string>>"
PARSED = f"conv_id long, {_COUNTS}, cost long, audit string"
_CELLS = pa.list_(pa.struct([("p", pa.string()), ("q", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))

Cells = dict[tuple[str, str], tuple[int, str]]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def joined(left: Cells, right: Cells) -> Cells:
    """The rules (p, q) -> (p, r) (r, q) over two neighbouring spans."""
    out: Cells = {}
    for (p, r), (c1, a1) in left.items():
        for q in ("", "s", "u", "a"):
            if (r, q) in right:
                c2, a2 = right[r, q]
                found = (c1 + c2, a1 + a2)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def least(cells: Iterator[Cells]) -> Cells:
    out: Cells = {}
    for some in cells:
        for k, v in some.items():
            if k not in out or v < out[k]:
                out[k] = v
    return out


def insertions() -> Cells:
    """The cells of no row: nothing, or rows put in (one round of the graph of initials is enough, more only cost)."""
    step = {(p, q): (COSTS["I"], "I") for p, after in NEXT.items() for q in after if q in ROLES}
    out = {(p, p): (0, "") for p in NEXT}
    for _ in NEXT:
        out = least(iter([out, joined(out, step)]))
    return out


NOTHING = insertions()


@functools.lru_cache(maxsize=256)
def leaf(code: str) -> Cells:
    """The cells of one row: its initial (or "?"), and "x" where it has to go or "t" where it is truncated."""
    initial, fault = code
    cells = {(p, p): (COSTS["D"], "D") for p in NEXT}
    if fault != "x":
        more = TRUNCATED * (fault == "t")
        for p, after in NEXT.items():
            for q in after:
                if q == initial:
                    cells[p, q] = min(cells.get((p, q), (99, "")), (COSTS["K"] + more, "K"))
                elif q in ROLES:
                    cells[p, q] = min(cells.get((p, q), (99, "")), (COSTS["R"] + more, "R"))
    return joined(joined(NOTHING, cells), NOTHING)


def parse(leaves: list[Cells]) -> Cells:
    """CYK over the leaves, in blocks of at most BLOCK: all spans by length, all ways to split each."""
    if not leaves:
        return NOTHING
    while len(leaves) > BLOCK:
        leaves = [parse(leaves[i : i + BLOCK]) for i in range(0, len(leaves), BLOCK)]
    n = len(leaves)
    span = {(i, i + 1): cells for i, cells in enumerate(leaves)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            span[i, i + length] = least(joined(span[i, k], span[k, i + length]) for k in range(i + 1, i + length))
    return span[0, n]


@functools.lru_cache(maxsize=1 << 14)
def parse_codes(codes: str) -> Cells:
    """The cells of a block of rows: two characters a row."""
    return parse([leaf(codes[i : i + 2]) for i in range(0, len(codes), 2)])


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells["", q] for q in FINAL if ("", q) in cells)


def audit_of(codes: str) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return cheapest(parse([parse_codes(codes[i : i + 2 * BLOCK]) for i in range(0, len(codes), 2 * BLOCK)]))


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits: the audit and the initials so far give each new role."""
    last = ""
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if last == "u" else "u"]
        last = role[0]
        yield role, text


def digest(audit: str, rows: Iterator[tuple[str, str]]) -> str:
    total, first = hashlib.sha256(), True
    for role, text in repaired(audit, rows):
        total.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return total.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, initial, last (the last character that is no white space, else empty).

    A dropped row stays with gone set, so that its conversation is known. Nulls of any column read as one space.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    changed: Column = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy").withColumn("last", F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1))


def code(role: str, last: str, repeated: bool) -> tuple[str, str]:
    """The leaf's code of a row, and its first fault."""
    fault = "blank" if not last else "duplicate" if repeated else "truncated" if last not in ".!?" else ""
    initial = role[:1] if role[:1] in ("s", "u", "a") and role else "?"
    return initial + {"blank": "x", "duplicate": "x", "truncated": "t", "": "."}[fault], fault


def repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """One row per conversation: gaps, faults by kind, illegal neighbours, cost and audit of the cheapest edits, digest of the repaired rows.

    Rows of a conversation are taken by turn (nulls first), equal turns by role, then text. A null conv_id is a conversation of its own;
    initials other than s, u and a fit nowhere, so such rows are reroled or deleted. A conversation whose rows are all dropped has zeros,
    an empty audit and the digest of nothing. Conversations of more than `long` rows are spread over tasks by repair_long.
    """
    rows = damaged(conversations)
    big = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).count().where(F.col("count") > long).select(F.col("conv_id").alias("big"))
    big = saved(big, "long-conversations")
    if big.isEmpty():
        return repair_short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("big"))
    return repair_short(rows.join(big, same, "left_anti")).unionByName(repair_long(rows.join(big, same, "left_semi")))


def repair_short(rows: DataFrame) -> DataFrame:
    """Conversations of a bounded number of rows, each in one task, one after the other."""
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (c.split()[0] for c in RESULT.split(", "))])

    def one(conv, rows: list) -> tuple:
        seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text, last in rows:
            c, fault = code(role, last, (role, text) in seen)
            seen.add((role, text))
            codes.append(c)
            counts[fault] += 1
        turns = {t for t, *_ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = _illegal((a[1][:1], b[1][:1]) for a, b in itertools.pairwise(rows))
        cost, audit = audit_of("".join(codes))
        return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest(audit, ((r, t) for _, r, t, _ in rows)))

    def run(batches):
        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out = []
        for conv, group in itertools.groupby(stream(), key=lambda r: r[0]):
            out.append(one(conv, [r[1:5] for r in group if not r[5]]))
            if len(out) == 4096:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)

    dealt = rows.select("conv_id", "turn", "role", "text", "last", "gone").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, RESULT)


def repair_long(rows: DataFrame, block: int = 256) -> DataFrame:
    """The same for conversations of any length: a range sort numbers the rows, many tasks parse pieces of at most `block` rows, and the
    pieces' cells are joined by a tree of groups of 16; first occurrences come from an aggregation. Only the digest of a repaired
    conversation, one hash over all its text in order, is streamed by one task."""
    sort = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = rows.where("not gone").repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id())
    placed = saved(placed.drop("gone"), "placed")
    narrow = placed.select("conv_id", "turn", "role", "last", "at", F.sha2("text", 256).alias("digest"))
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first")).withColumnsRenamed({"conv_id": "c", "role": "r", "digest": "d"})
    met = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    piece = F.shiftright("at", block.bit_length() - 1).alias("piece")
    pieces = met.groupBy("conv_id", piece).agg(F.sort_array(F.collect_list(F.struct("at", "role", "last", (F.col("at") > F.col("first")).alias("again")))).alias("rows"))
    level = saved(pieces.mapInArrow(_parse_pieces, PIECE), "pieces")
    while not level.groupBy("conv_id").count().where("count > 1").isEmpty():
        parts = F.sort_array(F.collect_list(F.struct(*level.drop("conv_id").columns))).alias("parts")
        level = saved(level.groupBy("conv_id", F.shiftright("piece", 4).alias("above")).agg(parts).mapInArrow(_join_pieces, PIECE), "pieces")
    parsed = saved(level.mapInArrow(_cheapest_of_pieces, PARSED), "parsed")

    texts = placed.select("conv_id", "at", "role", "text").union(parsed.select("conv_id", F.lit(-1), F.lit(""), "audit"))
    digests = texts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_digests, "same long, repaired_sha256 string")
    spans = rows.groupBy("conv_id").agg(*[F.expr(f"{f} FILTER (WHERE NOT gone)").alias(n) for f, n in (("min(turn)", "low"), ("max(turn)", "high"), ("count(DISTINCT turn)", "turns"))])
    spans = spans.select(F.col("conv_id").alias("conv"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"))
    both = parsed.join(digests, F.col("conv_id").eqNullSafe(F.col("same")))
    found = spans.join(both, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    return found.select(F.col("conv").alias("conv_id"), "gaps", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _by_row(schema: pa.Schema, row_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pylist([row_of(r) for r in b.to_pylist()], schema=schema)


def _piece_schema() -> pa.Schema:
    numbers = [(c, pa.int64()) for c in ("conv_id", "piece", *COUNTED)]
    return pa.schema([*numbers, ("first", pa.string()), ("last", pa.string()), ("cells", _CELLS)])


def _packed(cells: Cells) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()]


def _unpacked(cells: list[dict]) -> Cells:
    return {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells}


def _illegal(pairs) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairs)


def _parse_pieces(batches):
    def row_of(r: dict) -> dict:
        marks = [code(x["role"], x["last"], x["again"]) for x in r["rows"]]
        initials, faults, codes = [x["role"][:1] for x in r["rows"]], [f for _, f in marks], "".join(c for c, _ in marks)
        cells = parse([parse_codes(codes[i : i + 2 * BLOCK]) for i in range(0, len(codes), 2 * BLOCK)])
        counts = {c: faults.count(c) for c in COUNTED[:3]} | {"illegal": _illegal(itertools.pairwise(initials))}
        return {"conv_id": r["conv_id"], "piece": r["piece"], **counts, "first": initials[0], "last": initials[-1], "cells": _packed(cells)}

    yield from _by_row(_piece_schema(), row_of, batches)


def _join_pieces(batches):
    def row_of(r: dict) -> dict:
        parts = r["parts"]
        counts = {c: sum(x[c] for x in parts) for c in COUNTED}
        counts["illegal"] += _illegal((x["last"], y["first"]) for x, y in itertools.pairwise(parts))
        cells = parse([_unpacked(x["cells"]) for x in parts])
        return {"conv_id": r["conv_id"], "piece": r["above"], **counts, "first": parts[0]["first"], "last": parts[-1]["last"], "cells": _packed(cells)}

    yield from _by_row(_piece_schema(), row_of, batches)


def _cheapest_of_pieces(batches):
    def row_of(r: dict) -> dict:
        cost, audit = cheapest(_unpacked(r["cells"]))
        return {c: r[c] for c in ("conv_id", *COUNTED)} | {"cost": cost, "audit": audit}

    yield from _by_row(pa.schema([*((c, pa.int64()) for c in ("conv_id", *COUNTED, "cost")), ("audit", pa.string())]), row_of, batches)


def _digests(batches):
    """Rows of a conversation in order, its audit first: the text of one batch is in memory at a time."""
    stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for conv, group in itertools.groupby(stream, key=lambda r: r[0]):
        audit = next(group)[3]
        found = digest(audit, ((role, text) for _, _, role, text in group))
        yield pa.RecordBatch.from_pydict({"same": pa.array([conv], pa.int64()), "repaired_sha256": pa.array([found])})
