"""Spelling variants against a plain comparison of all words."""

import collections
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from momenta.llm import spelling
from tests.llm.cases import SCHEMA, hard_docs


def plain_words(rows):
    count = collections.Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            count[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(a) + 1 == len(b) and a[i:] == b[i + 1 :]


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made_up(seed, words, occurrences):
    """Documents over random words and variants of them, some of which are chains of forms."""
    rng = random.Random(seed)
    letters = "abcdeéß÷Éy"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(words)]
    for w in list(base):
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            base.append(w)
    rows, left = [], [w for k, w in enumerate(base) for _ in range([occurrences, 30, 3, 2][k % 4])]
    rng.shuffle(left)
    for d in range(0, len(left), 40):
        rows.append((d if d else None, rng.choice([" ", ", ", "1", "×1"]).join(w.title() if rng.random() < 0.1 else w for w in left[d : d + 40])))
    return rows


def test_against_all_pairs(spark):
    rows = [*made_up(5, 30, 320), (1, None), (2, ""), (3, "Abcdefgh abcdefgh " * 400), (3, "Abcdefgh abcdefgh " * 400), (4, "abcdefgx " * 20)]
    df = spark.createDataFrame([(d, t, "x", "y", "z", 1, "r") for d, t in rows], "doc_id long, text string, code string, near string, root string, n int, run string")
    got = found(spelling.variants(df))
    assert got == plain_variants(rows)
    assert any(root not in (word, form) for word, form, root, *_ in got)


def test_hard_rows_and_no_rows(spark):
    docs = hard_docs(spark)
    assert found(spelling.variants(docs)) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_words_take_linear_time(spark):
    """Words beyond the quadratic comparison: all kinds of edits, at the ends and inside."""
    base = "abcdefghij" * 10_000
    words = [base, base[:-1], base[1:], "x" + base, base[:777] + "q" + base[778:], base[:5] + base[6:], base + "xx", base[:-1] + "é"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(words.index(r.word), words.index(r.near)) for r in spelling.near_words(df).collect()}
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}


def test_neighbourhood_is_full_and_without_repeats():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        symbols = rng.integers(1, spelling.SYMBOLS + 1, (3, n)).astype(np.uint64)
        number = lambda word: int(spelling._prefixes(np.array([word], np.uint64))[0, -1]) if len(word) else 0
        got = [[] for _ in symbols]
        for start in range(0, n + 1, 3):
            for r, codes in spelling.neighbourhood(symbols, start, start + 3):
                for i, c in zip(r, codes, strict=True):
                    got[i].append(int(c))
        for i, word in enumerate(symbols.tolist()):
            every = [s for s in range(1, spelling.SYMBOLS + 1)]
            expected = {number(word[:j] + word[j + 1 :]) for j in range(n)} | {number(word[:j] + [s] + word[j:]) for j in range(n + 1) for s in every}
            expected |= {number(word[:j] + [s] + word[j + 1 :]) for j in range(n) for s in every if s != word[j]}
            assert len(got[i]) == len(set(got[i])) and set(got[i]) == expected


def test_words_are_not_listed_by_document(spark):
    plan = spelling.vocabulary(spark.createDataFrame([(1, "abcdefg abcdefg")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan
    assert spelling.vocabulary(spark.createDataFrame([(1, "abcdefg " * 5)], "doc_id long, text string")).where(F.col("n") < 2).count() == 0
