"""Near copies by five-word shingles against all pairs."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from momenta.llm import near_copies
from tests.llm.cases import hard_docs, no_docs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def all_pairs(texts):
    """Links of all pairs of different shingle sets, by similarity of 0.8 or more; sets that are equal are one."""
    sets = {}
    for d, t in texts.items():
        sets.setdefault((grams(t), tuple(words((t or "").translate(LOWER)))), []).append(d)
    out = []
    for (a, x), (b, y) in itertools.combinations([(k[0], v[0]) for k, v in sets.items()], 2):
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and a and 5 * len(a & b) >= 4 * len(a | b):
            out.append((x, y))
    return list(sets.values()), out


def parts(ids, same, pairs):
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.chain(((g[0], x) for g in same for x in g), pairs):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d: find(d) for d in ids}


def test_recall_and_no_false_links(spark):
    """Documents of sf0.01 and a copy of every second one with up to one word in 45 changed, against all pairs."""
    rng = np.random.default_rng(11)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 600").collect()
    texts = {r.doc_id: r.text for r in rows}
    for d in [d for d in texts if d % 2 and len(words(texts[d])) >= 50]:
        w = words(texts[d])
        for k in rng.choice(len(w), int(rng.integers(1, 2 + len(w) // 45)), replace=False):
            w[k] = f"changed{k}"
        texts[d + 100_000] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same, pairs = all_pairs(texts)
    truth = parts(texts, same, pairs)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert all(len({got[d] for d in g}) == 1 for g in same)
    assert all(truth[d] == truth[c] for d, c in got.items())
    found = sum(got[a] == got[b] for a, b in pairs)
    print("recall", found, len(pairs))
    assert len(pairs) > 100 and found >= 0.9 * len(pairs)


def test_edited_copies(spark):
    """Copies of a text of 200 words with k words changed: those at 0.8 or more are found, others stay."""
    rng = np.random.default_rng(5)
    texts = {}
    for i in range(120):
        w = [f"v{x}" for x in rng.integers(4000, size=200)]
        texts[2 * i] = " ".join(w)
        for k in rng.choice(200, 1 + i % 6, replace=False):
            w[k] = f"new{k}"
        texts[2 * i + 1] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same, pairs = all_pairs(texts)
    truth = parts(texts, same, pairs)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert all(truth[d] == truth[c] for d, c in got.items())
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) and 60 < len(pairs) < 120


def test_failed_edges_lose_no_met_link(spark):
    """A family about one text, around the threshold: what all verified meetings connect is connected, by fewer edges than meetings."""
    rng = np.random.default_rng(7)
    base = [f"v{x}" for x in range(150)]
    texts = {}
    for i in range(60):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(1, 6)), replace=False):
            w[k] = f"n{i % 20}x{k}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_copies.prints(docs).cache()
    classes = rows.groupBy("id").agg(*(F.min(p).alias(p) for p in near_copies.PRINT))
    every = near_copies.met(near_copies.variants(classes), near_copies._between)
    checked = near_copies.verified(every, docs).collect()
    assert {r.linked for r in checked} == {True, False}
    of = {r.doc_id: r.id for r in rows.collect()}
    sets = {of[d]: grams(t) for d, t in texts.items()}
    assert all(r.linked == (5 * len(sets[r.a] & sets[r.b]) >= 4 * len(sets[r.a] | sets[r.b])) for r in checked)
    found = near_copies.links(classes, docs).collect()
    ids = sorted(sets)
    assert parts(ids, [], [(r.a, r.b) for r in found]) == parts(ids, [], [(r.a, r.b) for r in checked if r.linked])
    stars = near_copies.met(near_copies.variants(classes), near_copies._stars(0)).count()
    assert stars < len(checked)


def test_hard_rows_and_drop(spark):
    docs = hard_docs(spark)
    got = near_copies.near_copies(docs).collect()
    assert len(got) == docs.count() and near_copies.near_copies(no_docs(spark)).count() == 0
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[1] == of[2] == of[6] == {1} and of[4] == of[5] == {4}
    assert all(of[d] == {d} for d in (0, 3, 7, 8, 9, 10))
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 0, 1, 3, 3, 4, 7, 8, 9, 10]


def test_edges_of_a_family_grow_with_its_texts(spark, monkeypatch):
    """A family of 300 texts, half of them below the threshold from all others: no met link is lost, and few of the 44,850 pairs are written."""
    rng = np.random.default_rng(3)
    base = [f"v{x}" for x in range(150)]
    texts = {}
    for i in range(300):
        w = list(base)
        for k in rng.choice(150, 1 + i % 6, replace=False):
            w[k] = f"n{i}x{k}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_copies.prints(docs).cache()
    classes = rows.groupBy("id").agg(*(F.min(p).alias(p) for p in near_copies.PRINT))
    every = near_copies.verified(near_copies.met(near_copies.variants(classes), near_copies._between), docs).collect()
    made, saved = [], near_copies.saved

    def counted(df, what):
        out = saved(df, what)
        if what in ("met-again", "verified"):
            made.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "saved", counted)
    found = near_copies.links(classes, docs).collect()
    ids = sorted(r.id for r in rows.collect())
    assert parts(ids, [], [(r.a, r.b) for r in found]) == parts(ids, [], [(r.a, r.b) for r in every if r.linked])
    assert len(every) > 10_000 and len(made) == 1 + 2 * near_copies.ROUNDS
    assert max(made[1:]) < 2 * len(texts)


def test_sketches_bound_what_is_common(spark):
    """Counts never leave less room than two texts need, also where a part has more than a byte counts; lone shingles are left out."""
    rng = np.random.default_rng(9)
    for size in (0, 1, 40, 3000, 60_000):
        pool = rng.integers(-(2**63), 2**63 - 1, size + size // 8, np.int64)
        a, b = pool[:size], pool[len(pool) - size :]
        x, y = (near_copies._counts(np.frombuffer(near_copies._sketch(s, size), np.uint8)[None, :]) for s in (a, b))
        assert x.shape == (1, 1 + near_copies.PARTS) and x[0, 0] == size and x[0, 1:].sum() >= size
        assert np.minimum(x[0, 1:], y[0, 1:]).sum() >= len(np.intersect1d(a, b))
        assert near_copies._room(x, x).all()
    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(8)) + [20, 21]), (3, list(range(7)) + [30, 31, 32]), (4, list(range(10)))], "id long, grams array<bigint>")
    family = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "id long, family long")
    got = {r.id: near_copies._counts(np.frombuffer(bytes(r.sketch), np.uint8)[None, :])[0] for r in near_copies.sketches(sets, family).collect()}
    assert sorted(got) == [1, 2] and got[1][0] == got[2][0] == 10 and (got[1] == got[2]).all()


def test_chains_within_a_key_are_connected(spark):
    """Of three ids the middle one is near to both others, which are far from each other: all are connected, whichever comes first."""
    rng = np.random.default_rng(1)
    rows, chains = [], []
    for key in range(40):
        start = int(rng.integers(0, 2**32)) << 32
        chain = [start, start ^ (0xFF << 32), start ^ (0xFFFF << 32)]
        chains.append([int(np.uint64(c).view(np.int64)) for c in chain])
        rows += [(key, c) for c in chains[-1]]
    edges = near_copies.met(spark.createDataFrame(rows, "key long, id long"), near_copies._stars(0)).collect()
    root = parts(sorted(c for chain in chains for c in chain), [], [(r.a, r.b) for r in edges])
    assert all(len({root[c] for c in chain}) == 1 for chain in chains)
