"""Toxicity scores: the model against a plain one, both ways to look it up, and held-out accuracy."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from momenta.llm import toxicity
from tests.conftest import SMALL
from tests.llm.cases import hard_docs, no_docs

LABELS = "doc_id long, quality int, toxic int"


def plain_grams(word):
    s = f"^{word}$"
    return [s[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(s))]


class Plain:
    """The two class models by dictionaries and recursion."""

    def __init__(self, rows):
        self.own = [collections.Counter(), collections.Counter()]
        for text, toxic in rows:
            for w in toxicity.words_of(text):
                self.own[toxic].update(plain_grams(w))
        self.levels = {toxicity.ORDER: self.own[0] + self.own[1]}
        for order in range(toxicity.ORDER - 1, 0, -1):
            self.levels[order] = collections.Counter(g if len(g) <= order else g[-order:] for g in self.levels[order + 1])

    def shared(self, gram, order=toxicity.ORDER):
        if not order:
            return 1 / (len(self.levels[1]) + 1)
        g = gram[-order:]
        low = self.shared(g if len(g) < order else g[1:], order - 1)
        after = [n for x, n in self.levels[order].items() if x[:-1] == g[:-1]]
        return max(self.levels[order][g] - toxicity.SHARED, 0) / sum(after) + toxicity.SHARED * len(after) / sum(after) * low if after else low

    def of_class(self, c, gram):
        after = [n for x, n in self.own[c].items() if x[:-1] == gram[:-1]]
        q = self.shared(gram)
        return max(self.own[c][gram] - toxicity.OWN, 0) / sum(after) + sum(min(n, toxicity.OWN) for n in after) / sum(after) * q if after else q

    def word(self, word):
        return sum(math.log(self.of_class(1, g) / self.of_class(0, g)) for g in plain_grams(word))


TRAIN = [("some words of plain talk, some more words", 0), ("the words of an ordinary day", 0), ("some idiot words, you idiot, idiotic talk", 1), ("éÉ 漢字 x", 0), ("Plain idiot", 1)]
OTHERS = ["idiot", "idiom", "words", "wordless", "talk", "zzz", "a", "漢字", "é", "ordinarily", "ﬀ", "𝒳y"]


@pytest.fixture(scope="module")
def model(spark):
    counts = collections.defaultdict(lambda: [0, 0])
    for text, toxic in TRAIN:
        for w in toxicity.words_of(text):
            counts[w][toxic] += 1
    words = spark.createDataFrame([(w, *n) for w, n in counts.items()], "word string, n0 long, n1 long")
    return toxicity.class_model(toxicity.grams(words, "n0", "n1").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def test_model_against_a_plain_one(spark, model):
    plain = Plain(TRAIN)
    words = sorted({w for t, _ in TRAIN for w in toxicity.words_of(t)} | {w for t in OTHERS for w in toxicity.words_of(t)})
    table = model.toPandas().sort_values("key", key=lambda k: k.astype("uint64"))
    got = toxicity.score_words(words, table["key"].to_numpy().view(np.uint64), table["value"].to_numpy())
    assert np.allclose(got, [plain.word(w) for w in words], atol=1e-5)


def test_both_ways_to_look_up_agree(spark, model):
    docs = hard_docs(spark).unionByName(spark.createDataFrame([(99, "idiot " * 3 + "plain talk " * 50)], "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.select("doc_id", "text", "source")
    key = lambda r: tuple(str(v) for v in (r.doc_id, r.source, round(r.size, 9)))
    a, b = (sorted(f.collect(), key=key) for f in (toxicity.features(docs, model), toxicity.features(docs, model, most_grams=0)))
    assert a[0].asDict().keys() == b[0].asDict().keys() and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert key(x) == key(y) and np.allclose([x[c] for c in toxicity.FEATURES], [y[c] for c in toxicity.FEATURES])


def test_hard_rows_and_no_rows(spark):
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(11)] + [(0, 1, 1), (None, 1, 1), (5, 0, None), (77, 0, 1)], LABELS).withColumn("text", F.lit("clash"))
    got = toxicity.score(docs, labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in docs.collect())
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    assert all(len(s) == 1 for d, s in by.items() if d is not None)
    assert toxicity.score(no_docs(spark), labels).collect() == []
    assert {(r.score, r.predicted) for r in toxicity.score(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert {r.score for r in toxicity.score(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0.0}


def test_scores_use_neither_held_out_labels_nor_other_columns(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    a, b = ({r.doc_id: r.score for r in toxicity.score(d, lab).collect()} for d, lab in ((docs, labels), (moved, turned)))
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_held_out_accuracy(spark):
    """More than nine in ten toxic rows are found among the held-out labels of the largest table, and one ordinary row in fifty at most."""
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{large}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.9 and got[got.toxic == 0].predicted.mean() < 0.02


def test_mask_keeps_all_texts_of_the_ids(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.createDataFrame([(None, "null")], "doc_id long, text string"))
    ids = spark.range(0, 20_000, 40).select((F.col("id") - 400).alias("id"))
    kept = [r.doc_id for r in toxicity.perhaps_among(docs, ids).collect()]
    wanted = {r.id for r in ids.collect() if r.id >= 0}
    assert wanted <= set(kept) and len(kept) < 4 * len(wanted) and toxicity.perhaps_among(docs, ids).columns == docs.columns
    assert toxicity.perhaps_among(docs, ids.limit(0)).collect() == []
