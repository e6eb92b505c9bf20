"""The corpus pipeline: each stage on what its predecessor kept."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from momenta.llm import decontaminate, mixing, near_copies, quality, queries
from tests.conftest import SMALL
from tests.llm.cases import hard_docs


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SMALL).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_and_whole_texts(spark, stages):
    first = stages[0][0]
    texts = {r.doc_id: r.text for r in first.collect()}
    for _, after in stages[:-1]:
        assert after.columns == first.columns
        assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_decisions_take_effect(spark, stages):
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = stages
    assert ids(d1) == {r.doc_id: 1 for r in quality.rate(d0).where("kept").collect()}
    assert ids(d2) == {r.component_id: 1 for r in near_copies.near_copies(d1).collect()}
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert ids(d3) == {r.doc_id: 1 for r in decontaminate.report(d2, bench).where("not contaminated").collect()}
    assert ids(d4) == {r.doc_id: r.copies for r in mixing.mix(d3).collect() if r.copies}
    from tokenizers import Tokenizer

    lib, start = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), 0
    got = sorted(d5.collect(), key=lambda r: r.start)
    for r, doc in zip(got, d4.orderBy("doc_id").collect(), strict=True):
        t = [*lib.encode(doc.text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, start, len(t), zlib.crc32(np.array(t, "<u4").tobytes()))
        start += len(t)


def test_run_gives_the_same(spark, stages):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(tuple(r) for r in stages[-1][1].collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_hard_rows_and_no_rows(spark, name):
    docs, f = hard_docs(spark), dict(corpus_pipeline.STAGES)[name]
    got = f(spark, docs, SMALL)
    if name != "token ids":
        assert got.columns == docs.columns
    assert got.count() <= 3 * docs.count()
    assert f(spark, docs.limit(0), SMALL).count() == 0
    assert f(spark, docs.where(F.col("doc_id").isNull()), SMALL).count() >= 0
