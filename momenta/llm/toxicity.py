"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Each class (toxic, ordinary) has counts of letter n-grams of order up to ORDER within words. A class's probability of a letter
discounts its own counts and gives the rest to a model that both share: interpolated Kneser-Ney on the counts of both classes
together, with continuation counts below. An expression that neither class has seen often thus has nearly the same
probability in both. A word's score is the difference of its two log-likelihoods; a document's features are means of
these over its words, so they don't grow with its length, and a logistic curve fitted on rows that gave no counts makes them a score.

Counts, contexts and probabilities are Spark tables over all labelled rows. The finished model (n-gram -> difference) is
looked up by every task while it has at most MOST_GRAMS entries, and by joins with the distinct words beyond that.
"""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import saved

#: Letters of an n-gram, with ^ before and $ behind a word.
ORDER = 6
#: Discounts of a class's counts and of the shared counts.
OWN, SHARED = 2.0, 0.75
#: Evidence of a word below this many nats isn't summed as an expression.
NOTABLE = 2.0
THRESHOLD = 0.3
#: Of crc32(doc_id) mod 4: rows held out, and rows that fit the curve; the others give counts.
HELD_OUT, CURVE = 2, 3
#: The curve is fitted on at most so many labelled rows, the first by hash.
CURVE_ROWS = 20_000
#: Entries of a model that each task loads whole (12 bytes each).
MOST_GRAMS = 6_000_000
#: Bits of a mask over ids, at most (a power of two).
MASK_BITS = 26
#: Words longer than this count as their first and later pieces of so many letters.
PIECE = 48

WORD = re.compile(r"[^\W\d_]+")
FEATURES = ("mean", "excess", "most", "size")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; a longer word is cut into pieces of PIECE letters, so no entry of a vocabulary is longer."""
    found = WORD.findall((text or "").lower())
    if any(len(w) > PIECE for w in found):
        return [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id reads as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def _word_counts(batches):
    """Words of a batch's documents by class, summed in the task."""
    for b in batches:
        count = collections.Counter()
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            count.update((w, toxic) for w in words_of(text))
        if count:
            words, classes = zip(*count, strict=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array(classes, pa.int32()), "n": pa.array(list(count.values()), pa.int64())})


def grams(words: DataFrame, *keep: str) -> DataFrame:
    """gram: for every letter of ^word$ but the first, it and the up to ORDER - 1 letters before it."""
    ends = F.sequence(F.lit(2), F.length("word") + 2)
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    gram = F.transform(ends, lambda e: marked.substr(F.greatest(e - (ORDER - 1), F.lit(1)), F.least(e, F.lit(ORDER))))
    return words.select(*keep, F.explode(gram).alias("gram"))


def context(gram: str | Column) -> Column:
    g = F.col(gram) if isinstance(gram, str) else gram
    return g.substr(F.lit(1), F.length(g) - 1)


def shared_model(counts: DataFrame) -> DataFrame:
    """gram and q: the probability of the last letter after the others by Kneser-Ney over the counts (gram, n) of both classes.

    Below the highest order an n-gram counts the different letters seen before it; one that begins a word has no shorter n-grams
    of its own order and stands for itself. The lowest order gives 1 / (letters + 1) to any letter."""
    tables, now = [], counts.select("gram", "n")
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            whole = F.length("gram") <= order
            shorter = now.select(F.when(whole, F.col("gram")).otherwise(F.col("gram").substr(F.length("gram") - order + 1, F.lit(order))).alias("gram"))
            now = shorter.groupBy("gram").agg(F.count("*").alias("n"))
        tables.append(now := saved(now, "continuations"))
    letters = tables[-1].count() + 1
    below = None
    for order, table in zip(range(1, ORDER + 1), reversed(tables), strict=True):
        totals = table.groupBy(context("gram").alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = table.join(totals, context("gram") == F.col("h"))
        if below is None:
            rows = rows.withColumn("low", F.lit(1.0 / letters))
        else:  # an n-gram shorter than the order begins a word: its probability stays that of the order below
            low = below.select(F.col("gram").alias("tail"), F.col("q").alias("low"))
            rows = rows.join(low, F.when(F.length("gram") < order, F.col("gram")).otherwise(F.col("gram").substr(F.lit(2), F.length("gram") - 1)) == F.col("tail"))
        own = F.greatest(F.col("n") - SHARED, F.lit(0.0)) / F.col("total") + SHARED * F.col("kinds") / F.col("total") * F.col("low")
        below = saved(rows.select("gram", own.alias("q")), "shared")
    return below


def class_model(counts: DataFrame) -> DataFrame:
    """Entries of the model: key and value, the difference of the classes' log-probabilities.

    counts: gram, n0, n1. An n-gram has an entry of its own; a context has one for all other letters after it, for which the shared
    probability cancels out and only the shares that the classes give to the shared model remain."""
    counts = counts.withColumn("h", context("gram"))
    sums = [F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)] + [F.sum(F.least(f"n{c}", F.lit(OWN))).alias(f"given{c}") for c in (0, 1)]
    contexts = saved(counts.groupBy("h").agg(*sums), "contexts")
    shared = shared_model(counts.select("gram", (F.col("n0") + F.col("n1")).alias("n")))
    given = lambda c: F.when(F.col(f"total{c}") > 0, F.col(f"given{c}") / F.col(f"total{c}")).otherwise(F.lit(1.0))
    own = lambda c: F.when(F.col(f"total{c}") > 0, F.greatest(F.col(f"n{c}") - OWN, F.lit(0.0)) / F.col(f"total{c}")).otherwise(F.lit(0.0))
    p = lambda c: own(c) + given(c) * F.col("q")
    seen = counts.join(contexts, "h").join(shared, "gram").select("gram", F.log(p(1) / p(0)).alias("value"))
    rest = contexts.select("h", F.log(given(1) / given(0)).alias("value"))
    entries = seen.mapInArrow(lambda batches: _keys(batches, gram_keys), "key long, value float")
    return saved(entries.union(rest.mapInArrow(lambda batches: _keys(batches, context_keys), "key long, value float")), "toxicity-model")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_BASE), k, 1 << 64) for k in range(ORDER)], np.uint64)


def _letters(strings: list[str]) -> np.ndarray:
    """Code points of strings, a row each, zeros behind the end."""
    a = np.array(strings)
    return a.view(np.uint32).reshape(len(strings), -1).astype(np.uint64)


def _context_key(code: np.ndarray) -> np.ndarray:
    return code * _BASE + np.uint64(1)


def gram_keys(strings: list[str]) -> np.ndarray:
    """A number for each n-gram: its letters as a polynomial mod 2^64 (odd base), so equal numbers of different n-grams are chance."""
    x = _letters(strings)
    return (x * _POWERS[: x.shape[1]]).sum(axis=1, dtype=np.uint64)


def context_keys(strings: list[str]) -> np.ndarray:
    return _context_key(gram_keys(strings))


def _keys(batches, keys):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys(b.column(0).to_pylist()).view(np.int64)), "value": b.column(1).cast(pa.float32())})


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of every ^word$ but the first: the word's number, the key of the n-gram that ends there, the key of its context."""
    x = _letters([f"^{w}$" for w in words])
    rows, grams_, contexts = [], [], []
    for end in range(1, x.shape[1]):
        live = np.flatnonzero(x[:, end])
        start = max(0, end - ORDER + 1)
        before = (x[live, start:end] * _POWERS[: end - start]).sum(axis=1, dtype=np.uint64)
        rows.append(live)
        contexts.append(_context_key(before))
        grams_.append(before + x[live, end] * _POWERS[end - start])
    return np.concatenate(rows), np.concatenate(grams_), np.concatenate(contexts)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def score_words(words: list[str], keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The difference of log-likelihoods of each word: an n-gram's entry, else its context's, else nothing."""
    if not words:
        return np.zeros(0)
    rows, gram, context_ = word_grams(words)
    known, value = _lookup(keys, values, gram)
    near, rest = _lookup(keys, values, context_)
    return np.bincount(rows, np.where(known, value, np.where(near, rest, 0.0)), len(words))


def features(docs: DataFrame, model: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """The columns of docs but the text, and for each document the means over its words of the difference and of what exceeds NOTABLE, the
    largest difference, and the logarithm of 1 + the number of words; zeros without words."""
    if model.count() > most_grams:
        return features_by_join(docs, model)
    table = model.toArrow()
    keys, values = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], values[order]))

    def run(batches):
        keys, values = shared.value
        known: dict[str, float] = {}
        for b in batches:
            out = np.zeros((b.num_rows, len(FEATURES)))
            for i, text in enumerate(b.column("text")):
                words = words_of(text.as_py())
                if not words:
                    continue
                if len(known) > 400_000:
                    known.clear()
                new = [w for w in set(words) if w not in known]
                for part in range(0, len(new), 20_000):
                    some = new[part : part + 20_000]
                    known.update(zip(some, score_words(some, keys, values).tolist(), strict=True))
                a = np.fromiter(map(known.__getitem__, words), float, len(words))
                out[i] = a.mean(), np.maximum(a - NOTABLE, 0).mean(), a.max(), np.log1p(len(a))
            rest = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(out[:, j]) for j in range(len(FEATURES)))], names=[*rest.schema.names, *FEATURES])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, " + ", ".join(f"{c} double" for c in FEATURES))


def features_by_join(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same for a model of any size: distinct words meet the model, then the documents' words meet theirs."""
    rows = saved(docs.withColumn("row_", F.monotonically_increasing_id()), "numbered")

    def count(batches):
        for b in batches:
            for row, text in zip(b.column("row_").to_pylist(), b.column("text"), strict=True):
                found = collections.Counter(words_of(text.as_py()))
                if found:
                    yield pa.RecordBatch.from_pydict({"row_": pa.array([row] * len(found), pa.int64()), "word": pa.array(list(found)), "n": pa.array(list(found.values()), pa.int64())})

    def cells(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            for part in range(0, len(words), 2_000):
                at, gram, context_ = word_grams(words[part : part + 2_000])
                yield pa.RecordBatch.from_pydict({"word": b.column("word").slice(part, 2_000).take(pa.array(at)), "gram": pa.array(gram.view(np.int64)), "rest": pa.array(context_.view(np.int64))})

    tokens = saved(rows.select("row_", "text").mapInArrow(count, "row_ long, word string, n long"), "tokens")
    entry = lambda name: model.select(F.col("key").alias(name), F.col("value").alias(f"{name}_value"))
    met = tokens.select("word").distinct().mapInArrow(cells, "word string, gram long, rest long").join(entry("gram"), "gram", "left").join(entry("rest"), "rest", "left")
    words = met.groupBy("word").agg(F.sum(F.coalesce("gram_value", "rest_value", F.lit(0.0)).cast("double")).alias("d"))
    n = F.sum("n")
    sums = [(F.sum(F.col("n") * F.col("d")) / n).alias("mean"), (F.sum(F.col("n") * F.greatest(F.col("d") - NOTABLE, F.lit(0.0))) / n).alias("excess"), F.max("d").alias("most"), F.log1p(n).alias("size")]
    found = tokens.join(words, "word").groupBy("row_").agg(*sums)
    return rows.drop("text").join(found, "row_", "left").drop("row_").fillna(0.0, list(FEATURES))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray | None:
    """Weights of the features and a constant by Newton's steps on a ridged logistic likelihood; None without rows of both labels."""
    if not 0 < y.sum() < len(y):
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.c_[(x - centre) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope, bend = z.T @ (p - y) + ridge * w, (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * centre / scale).sum()]


def known_labels(labels: DataFrame) -> DataFrame:
    """id, toxic, rest (the remainder of the id) of the labels that may be learnt from. Labels of one id: toxic if any is."""
    known = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return known.withColumn("rest", remainder(F.col("id"))).where(F.col("rest") != HELD_OUT)


def perhaps_among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts without most of those whose doc_id isn't among ids (id): hashes of ids set bits of a mask of bounded size (8 MB at most), a bit or
    more for every id, and a text stays if its bit is set. Texts of ids all stay, so a join afterwards gives the same rows and moves fewer."""
    bits = min(max(10, math.ceil(math.log2(16 * ids.count() + 1))), MASK_BITS)
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    found = ids.groupBy(F.shiftright(slot("id"), 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), {64 - bits}) & 63 AS int))")).alias("bits")).toArrow()
    mask = np.zeros(1 << (bits - 6), np.int64)
    mask[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    row = texts.sparkSession.createDataFrame(pa.table({"mask_": pa.array([mask], pa.list_(pa.int64()))}))
    bit = F.getbit(F.get("mask_", F.shiftright(slot("doc_id"), 6).cast("int")), slot("doc_id").bitwiseAND(F.lit(63)).cast("int"))
    return texts.crossJoin(F.broadcast(row)).where(bit == 1).drop("mask_")


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """The model of the counted rows and the curve of the others.

    Only texts whose ids are (but for chance) among those that give counts meet labels in a shuffle; the rows that fit the curve are picked by id, and their bounded list goes to the texts."""
    known, texts = known_labels(labels), docs.select("doc_id", "text")
    given = saved(known.where(F.col("rest") != CURVE).select("id", "toxic"), "counted-labels")
    counted = perhaps_among(texts.where(~remainder(F.col("doc_id")).isin(HELD_OUT, CURVE)), given).join(given, F.col("doc_id") == F.col("id"))
    words = counted.select("text", "toxic").mapInArrow(_word_counts, "word string, toxic int, n long")
    by_class = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    words = saved(words.groupBy("word").agg(*by_class), "class-words")
    counts = grams(words, "n0", "n1").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    model = class_model(saved(counts, "class-grams"))
    some = saved(known.where(F.col("rest") == CURVE).orderBy(F.xxhash64("id"), "id").limit(CURVE_ROWS).select("id", "toxic"), "curve-rows")
    rows = texts.where(remainder(F.col("doc_id")) == CURVE).join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("text", "toxic")
    seen = features(rows, model).toPandas()
    return model, fit_curve(seen[list(FEATURES)].to_numpy(float), seen["toxic"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of every document, by its whole text alone.

    Null and empty texts and texts without a word have features of zero and the curve's score there. Repeated rows have equal scores.
    Without labels of both classes every score is 0."""
    model, weights = train(docs, labels)
    held = (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out")
    found = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    value = F.lit(0.0)
    if weights is not None:
        value = 1 / (1 + F.exp(-(sum((F.col(c) * float(w) for c, w in zip(FEATURES, weights[:-1], strict=True)), F.lit(float(weights[-1]))))))
    return found.select("doc_id", held, value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
