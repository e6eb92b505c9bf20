"""Repaired conversations against a plain search over edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from momenta.llm import conversations, queries
from tests.conftest import SMALL

ROWS = "conv_id long, turn long, role string, text string"
TARGET = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_best(items):
    """The least (cost, audit, repaired rows' roles) by a search from the left; items: (initial, must go, truncated)."""

    @functools.cache
    def best(i, last):
        found = [(0, "", ())] if i == len(items) and last in ("", "a") else []
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        put = lambda cost, edit, role, rest: (cost + rest[0], edit + rest[1], ((edit, role), *rest[2]))
        if i < len(items):
            initial, gone, cut = items[i]
            found.append(put(4, "D", "", best(i + 1, last)))
            if not gone:
                found += [put(3 * cut, "K", initial, best(i + 1, initial))] if initial and initial in allowed else []
                found += [put(3 + 3 * cut, "R", x, best(i + 1, x)) for x in allowed if x in "ua"]
        if i == len(items):  # rows put in at the end
            found += [put(3, "I", "u", put(3, "I", "a", (0, "", ())))] if "u" in allowed else [put(3, "I", "a", (0, "", ()))]
        else:
            for x in allowed:
                if x in "ua":
                    y = "a" if x == "u" else "u"
                    found += [put(3, "I", x, best_row(i, x)), put(3, "I", x, put(3, "I", y, best_row(i, y)))]
        return min(found, default=(10**9, "", ()))

    @functools.cache
    def best_row(i, last):
        """Row i is edited next, nothing is put in before it."""
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        put = lambda cost, edit, role, rest: (cost + rest[0], edit + rest[1], ((edit, role), *rest[2]))
        initial, gone, cut = items[i]
        found = [put(4, "D", "", best(i + 1, last))]
        if not gone:
            found += [put(3 * cut, "K", initial, best(i + 1, initial))] if initial and initial in allowed else []
            found += [put(3 + 3 * cut, "R", x, best(i + 1, x)) for x in allowed if x in "ua"]
        return min(found)

    return best(0, "")


def plain_repair(rows):
    out = {}
    after = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, items, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            items.append((role[:1], fault < 2, fault == 2))
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, edits = plain_best(tuple(items))
        left, done = iter(mine), []
        for edit, role in edits:
            row = next(left) if edit != "I" else None
            if edit == "K":
                done.append(f"{row[2]}:{row[3]}")
            elif edit in "RI":
                done.append(f"{ {'u': 'user', 'a': 'assistant'}[role] }:{row[3] if row else ''}")
        assert TARGET.fullmatch("".join(x[0] for x in done))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def random_rows(seed, convs, most):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            rows.append((conv or None, rng.choice([turn, turn, turn, None, turn // 2]), role, rng.choice(["Yes.", "No", "", None, " \n", "Why? ", f"t{turn}!", "é漢."])))
    return rows


def as_dict(df):
    got = df.collect()
    out = {r.conv_id: tuple(r[c.split()[0]] for c in conversations.RESULT.split(", ")) for r in got}
    assert len(out) == len(got)
    return out


def test_whole_table_against_the_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(queries.QUERIES["op13_conversations"](spark, SMALL)) == plain_repair(rows)


@pytest.mark.parametrize("long", [2048, 3])
def test_hard_rows_against_the_search(spark, long):
    """Nulls everywhere, ties, repeats, foreign roles; by one task for each conversation, and by many (block of 2 rows)."""
    rows = random_rows(1, 60, 40)
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("gone", "last", "at", "kind", "copy", "piece", "count", "big", "cells", "audit")})
    assert as_dict(conversations.repair(df, long)) == plain_repair(rows)
    assert conversations.repair(df.limit(0), long).collect() == []


def test_pieces_of_two_rows(spark):
    rows = [r for r in random_rows(2, 12, 90) if r[0] is not None]
    df = conversations.damaged(spark.createDataFrame(rows, ROWS).repartition(7))
    assert as_dict(conversations.repair_long(df, block=2)) == plain_repair(rows)


def test_one_turn_dropped_as_a_whole(spark):
    conv = next(c for c in range(99) if zlib.crc32(f"{c}: ".encode()) % 20 == 0)
    rows = [(conv, None, "user", "a."), (conv, None, "assistant", "b.")]
    nothing = (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for long in (2048, 1):
        assert as_dict(conversations.repair(spark.createDataFrame(rows, ROWS), long)) == {conv: nothing}


def test_blocks_are_as_one_parse():
    rng = random.Random(3)
    for n in (0, 1, 2, 15, 16, 17, 40, 70):
        codes = "".join(rng.choice("sua?") + rng.choice("..tx") for _ in range(n))
        items = tuple((codes[i] if codes[i] != "?" else "", codes[i + 1] == "x", codes[i + 1] == "t") for i in range(0, 2 * n, 2))
        assert conversations.audit_of(codes) == plain_best(items)[:2]
