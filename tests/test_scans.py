"""Chunks over many tasks give what a pass along the whole sequence gives."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from momenta.plans import hmm, scans


def model(seed=0, k=3, d=4):
    return hmm.Chain.random(k, d, seed)


def whole(c, x):
    x, size = np.array([x]), np.array([len(x)])
    g, _, ll = hmm.posteriors(c, x, size)
    return hmm.best_states(c, x, size)[0], g[0], ll[0]


def score(c, x, h):
    t, e = np.log(c.t), np.log(np.concatenate([c.o, np.ones((len(c.pi), 1))], axis=1))
    return np.log(c.pi[h[0]]) + sum(t[a, b] for a, b in zip(h, h[1:], strict=False)) + sum(e[s, v] for s, v in zip(h, x, strict=True))


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(1)
    seqs = {i: rng.integers(-1, 4, n).tolist() for i, n in enumerate([1, 2, 3, 7, 8, 9, 64, 700, 1500])}
    rows = [(i, p, t) for i, x in seqs.items() for p, t in enumerate(x)]
    return seqs, spark.createDataFrame(rows, "seq_id long, pos int, tok int").repartition(5)


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_all_lengths(tokens, chunk, monkeypatch):
    """Levels of four, so that several are met."""
    monkeypatch.setattr(scans, "_SHIFT", 2)
    seqs, df = tokens
    c = model()
    expected = {i: whole(c, x) for i, x in seqs.items()}
    paths = scans.viterbi(df, c, chunk).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("p")).collect()
    for r in paths:  # unknown symbols make paths of equal score, so scores are compared
        h = [v.h for v in r.p]
        assert np.isclose(score(c, seqs[r.seq_id], h), score(c, seqs[r.seq_id], expected[r.seq_id][0]), rtol=1e-12)
    assert {r.seq_id for r in paths} == set(seqs)
    assert all([v.pos for v in r.p] == list(range(len(r.p))) for r in paths)
    for r in scans.log_likelihood(df, c, chunk).collect():
        assert np.isclose(r.loglik, expected[r.seq_id][2])
    got = {i: np.zeros_like(e[1]) for i, e in expected.items()}
    for r in scans.state_posteriors(df, c, chunk).collect():
        got[r.seq_id][r.pos, r.state] = r.p
    assert all(np.allclose(got[i], e[1]) for i, e in expected.items())


def test_equal_paths_stay_paths(spark):
    """All states alike: the chunks have to agree on one path, the lowest."""
    c = hmm.Chain(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), np.full((3, 2), 0.5))
    df = spark.range(50).select(F.lit(1).alias("seq_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 2).cast("int").alias("tok"))
    assert {r.h for r in scans.viterbi(df, c, 4).collect()} == {0}
    # states that never change: the choice at the end holds for the whole sequence
    c = hmm.Chain(np.full(2, 0.5), np.eye(2), np.array([[0.6, 0.4], [0.4, 0.6]]))
    df = df.withColumn("tok", F.when(F.col("pos") < 20, 0).otherwise(1))
    assert {r.h for r in scans.viterbi(df, c, 4).collect()} == {1}
    assert np.isclose(scans.log_likelihood(df, c, 4).first().loglik, np.logaddexp(20 * np.log(0.6) + 30 * np.log(0.4), 20 * np.log(0.4) + 30 * np.log(0.6)) + np.log(0.5))


def test_a_million_events(spark):
    c = model(3)
    df = spark.range(1_000_000).select(F.lit(5).alias("seq_id"), F.col("id").cast("int").alias("pos"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("tok"))
    x = [r.tok for r in df.orderBy("pos").select("tok").toLocalIterator()]
    best, g, ll = whole(c, x)
    rows = scans.viterbi(df, c)
    assert rows.toPandas().sort_values("pos").h.tolist() == best.tolist()
    assert np.isclose(scans.log_likelihood(df, c).first().loglik, ll, rtol=1e-9)
    p = scans.state_posteriors(df, c).where("state = 1").toPandas().sort_values("pos").p.to_numpy()
    assert np.allclose(p, g[:, 1], atol=1e-9)
    assert scans.chunks(df).count() == 245


def test_no_tokens(spark):
    df = spark.createDataFrame([], "seq_id long, pos int, tok int")
    for f in (scans.viterbi, scans.log_likelihood, scans.state_posteriors):
        assert f(df, model()).collect() == []
    assert pa.types.is_list(scans._NODE.field("v").type)
