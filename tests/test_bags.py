"""Documents that are read once: words of texts without rows of words, and bags."""

import numpy as np
from pyspark.sql import functions as F

from momenta.functions import text as T
from momenta.operators import ngrams as N
from momenta.plans import moment_methods

TEXTS = ["a b  a\tB\n7x\r\n", "", None, " \n ", "é É x \u000b\u000c a", "ß" * 3 + " a" * 600, "\U0001f600 ² ٣ a"]


def test_words_of_texts_are_those_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(N, "TEXTS", 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "seq_id long, text string").coalesce(1)
    want = {(r.word, r.n) for r in N.word_counts(T.tokens(docs, "seq_id", "text")).collect()}
    assert {(r.word, r.n) for r in N.text_word_counts(docs).collect()} == want
    for words in (["a", "é"], []):
        slow = N.encode_packed(docs.select("seq_id", T.tokenize(F.col("text")).alias("ws")), words)
        assert sorted(map(tuple, N.encode_texts(docs, words).collect())) == sorted(map(tuple, slow.collect()))


def test_bags_count_the_words_of_documents(spark, monkeypatch):
    monkeypatch.setattr(moment_methods, "STEP", 5)
    docs = [[1, 1, 2], [3, None, 0, 9, 3, 3], [1, 2], [], None, [9, -1, 1, 1], [4] * 20, [2, 0, 2, 4, 0]]
    for d in (5, 1000):
        rows = moment_methods.bags(spark.createDataFrame([(x,) for x in docs], "x array<int>").coalesce(1), d).collect()
        want = [[v for v in x or [] if v is not None and 0 <= v < d] for x in docs]
        want = [sorted((v, x.count(v)) for v in set(x)) for x in want if len(x) >= 3]
        assert sorted(sorted(zip(r.x, r.n, strict=True)) for r in rows) == sorted(want)


def test_lda_reads_the_documents_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(rng.integers(0, 6, 9).tolist(),) for _ in range(200)], "x array<int>").repartition(3)
    moment_methods.lda(docs.mapInArrow(seen, "x array<int>"), 6, 2)
    assert read.value == 200
