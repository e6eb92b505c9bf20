"""Spelling variants: words within one edit of each other, and the common word that a rare one stands for.

Letters are hashed to SYMBOLS symbols. Two words within one edit have reduced words within one edit, so the full one-edit
neighbourhood of every reduced word (all deletions, replacements, insertions and the word itself) is generated, met with the
reduced vocabulary by an equality join, and the met words are compared letter by letter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import let, saved

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Words have at least so many letters and occurrences; a form is so many times as frequent as its variant.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Every SLIP-th occurrence by hash loses a letter (the contract's made-up slips).
SLIP = 31
SYMBOLS = 8
#: Reduced words are numbered by a polynomial mod 2^64; its base is odd, so it has an inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of the filter over the reduced vocabulary: 16 a word, between these powers of two (32 MB at most).
FILTER_BITS = (16, 28)
#: Letters up to which a quadratic comparison is quick.
SHORT = 64
#: Neighbours generated at a time.
CHUNK = 1 << 21
REDUCED = "code long, word string, n long"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and run: every maximal run of letters, A-Z lower-cased; runs too short for any word are left out."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), 0)).alias("run"))


def slipped(occurrences: DataFrame) -> DataFrame:
    """word: the run, or the run without one letter where the hash of document and run says so; a null doc_id reads as empty."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"))
    cut = lambda h: (h % F.length("run")).cast("int")
    word = let(h, lambda h: F.when(h % SLIP == 0, F.concat(F.col("run").substr(F.lit(1), cut(h)), F.col("run").substr(cut(h) + 2, F.length("run")))).otherwise(F.col("run")))
    return occurrences.select(word.alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: words of enough letters and occurrences."""
    words = slipped(runs(docs)).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the words of each length, and their symbols (1 to SYMBOLS), one row a word."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for part in np.array_split(rows, max(1, len(rows) * int(n) // CHUNK)):
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(part), n)
            yield part, ((points * np.uint64(BASE)) >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n - 1, BASE, np.uint64))
    return out


def _prefixes(symbols: np.ndarray) -> np.ndarray:
    """The numbers of all prefixes of reduced words, from the empty one to the whole."""
    out = np.zeros((len(symbols), symbols.shape[1] + 1), np.uint64)
    np.cumsum(symbols * _powers(symbols.shape[1]), axis=1, out=out[:, 1:])
    return out


def _reduce(batches):
    for b in batches:
        words, code = b.column("word").to_pylist(), np.zeros(b.num_rows, np.uint64)
        for rows, symbols in _by_length(words):
            code[rows] = _prefixes(symbols)[:, -1]
        yield pa.RecordBatch.from_pydict({"code": pa.array(code.view(np.int64)), "word": b.column("word"), "n": b.column("n")})


def neighbourhood(symbols: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of reduced words one edit away, for edits at places start to stop - 1 (the last place only takes insertions): rows, codes.

    A neighbour that several edits give comes once: of a run of one symbol only the first is deleted, and a symbol is put behind, not before, its equal.
    """
    m, n = symbols.shape
    prefix, power = _prefixes(symbols), _powers(n + 1)
    total = prefix[:, -1:]
    every = np.arange(start, min(stop, n))
    if len(every):
        here = symbols[:, every]
        first = np.ones_like(here, bool) if n == 1 else np.where(every > 0, here != symbols[:, every - 1], True)
        codes = prefix[:, every] + (total - prefix[:, every + 1]) * np.uint64(INVERSE)
        r, c = np.nonzero(first)
        yield r, codes[r, c]
        for s in range(1, SYMBOLS + 1):
            codes = total + (np.uint64(s) - here) * power[every]
            r, c = np.nonzero(here != s)
            yield r, codes[r, c]
    gaps = np.arange(start, min(stop, n + 1))
    for s in range(1, SYMBOLS + 1):
        codes = prefix[:, gaps] + np.uint64(s) * power[gaps] + (total - prefix[:, gaps]) * np.uint64(BASE)
        open_ = np.ones((m, len(gaps)), bool)
        inner = gaps < n
        open_[:, inner] = symbols[:, gaps[inner]] != s
        r, c = np.nonzero(open_)
        yield r, codes[r, c]


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return (code * np.uint64(BASE)) >> np.uint64(64 - bits)


def neighbours(reduced: DataFrame) -> DataFrame:
    """code, word, n: the neighbourhood of every reduced word and itself, without most codes that no word has (a filter of bounded size)."""
    sc = reduced.sparkSession.sparkContext
    bits = min(max(FILTER_BITS[0], math.ceil(math.log2(16 * reduced.count() + 1))), FILTER_BITS[1])

    def marks(batches):
        for b in batches:
            slot = _slot(b.column("code").to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_pydict({"byte": pa.array((slot >> np.uint64(3)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (slot & np.uint64(7))).astype(np.int64))})

    found = reduced.select("code").mapInArrow(marks, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    shared = sc.broadcast(table)

    def run(batches):
        known = shared.value
        for b in batches:
            words, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            yield b
            for rows, symbols in _by_length(words):
                wide = max(1, CHUNK // (8 * SYMBOLS * len(rows)))
                for start in range(0, symbols.shape[1] + 1, wide):
                    for r, codes in neighbourhood(symbols, start, start + wide):
                        slot = _slot(codes, bits)
                        hit = (known[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                        r, codes = r[hit == 1], codes[hit == 1]
                        if len(r):
                            at = rows[r]
                            yield pa.RecordBatch.from_pydict({"code": pa.array(codes.view(np.int64)), "word": b.column("word").take(pa.array(at)), "n": pa.array(n[at])})

    return reduced.mapInArrow(run, REDUCED)


def one_edit(a: str, b: str) -> Column:
    """Whether columns a and b are exactly one edit apart: Spark's distance, whose time is quadratic, for short words;
    for long ones what follows the first letter that differs has to be equal."""
    x, y = F.col(a), F.col(b)
    differ = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: ~p.eqNullSafe(q))
    tail = lambda c, at: c.substr(at.cast("int"), F.length(c))
    same = lambda i, j: let(F.array_position(differ, True), lambda at: tail(x, at + i) == tail(y, at + j))
    more = F.length(x) - F.length(y)
    linear = F.when(more == 0, (x != y) & same(1, 1)).when(more == 1, same(1, 0)).when(more == -1, same(0, 1)).otherwise(False)
    return F.when(F.length(x) <= SHORT, F.levenshtein(x, y, 1) == 1).otherwise(linear)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words exactly one inserted, deleted or replaced letter apart, both ways round."""
    reduced = saved(words.mapInArrow(_reduce, REDUCED), "reduced")
    other = reduced.select("code", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = neighbours(reduced).join(other, "code").where(one_edit("word", "near"))
    return met.select("word", "n", "near", "near_n").dropDuplicates(["word", "near"])  # codes can be equal by accident


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root: the end of each word's chain of forms (word, form), by doubling steps. A chain has at most log10(most) links."""
    links = saved(forms.select("word", F.col("form").alias("root")), "links")
    for _ in range(math.ceil(math.log2(max(2.0, math.log(max(most, 2), RATIO) + 1)))):
        later = links.select(F.col("word").alias("root"), F.col("root").alias("last"))
        links = saved(links.join(later, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "links")
    return links


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text).

    A form is the near word of largest n (ties: the smallest by code points) if it is RATIO times as frequent, else null; root follows forms to
    the last and is the word itself without a form. Null and empty texts have no words; repeated rows count once each; no rows give none.
    """
    words = saved(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    good = -F.col("best.n") >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))
    found = saved(found, "forms")
    most = found.agg(F.max("n")).first()[0] or 0
    ends = roots(found.where("form IS NOT NULL"), most)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
