"""Estimators find the models that their samples were drawn from, and fixed points that plain loops find."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from momenta.operators import coo as C
from momenta.operators import labels as L
from momenta.operators import moments as M
from momenta.operators import ngrams as N
from momenta.plans import em, estimators, hmm, moment_methods
from momenta.streaming import events as stream


def matched(a, b):
    """The least distance between the columns of a and those of b in any order, over b's size."""
    return min(np.linalg.norm(a[:, list(o)] - b) for o in itertools.permutations(range(b.shape[1]))) / np.linalg.norm(b)


def regression_sample(spark, betas, sigma2, n, seed, weights=None):
    rng = np.random.default_rng(seed)
    betas = np.array(betas)
    h = rng.choice(len(betas), n, p=weights)
    x = rng.standard_normal((n, betas.shape[1]))
    y = (x * betas[h]).sum(axis=1) + np.sqrt(sigma2) * rng.standard_normal(n)
    return spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y double, x array<double>").repartition(8)


@pytest.mark.parametrize(("betas", "sigma2", "n", "weights"), [(np.eye(3)[:2] * 1.0, 0.1, 10_000, None), ([[1.5, 0.5, 0.0], [-1.0, 1.0, 0.5]], 0.2, 20_000, [0.3, 0.7])])
def test_mixtures_of_regressions(spark, betas, sigma2, n, weights):
    rows, betas = regression_sample(spark, betas, sigma2, n, 1, weights), np.array(betas)
    w, b = moment_methods.regression_mixture(rows, 3, 2)
    assert matched(b.T, betas.T) < 0.35
    fitted, weights_, s2, history = em.fit_regressions(rows, 2, steps=30, betas=b.tolist(), gain=1e-7)
    assert matched(fitted.T, betas.T) < 0.05 and s2 == pytest.approx(sigma2, rel=0.15)
    assert sorted(weights_) == pytest.approx(sorted(weights or [0.5, 0.5]), abs=0.03)
    assert all(y >= x - 1e-6 * abs(x) for x, y in itertools.pairwise(history))


def gaussian_views(spark, means, weights, sigmas, n, seed=2):
    """Points (id, x1, x2, x3) around the columns of three matrices of means."""
    rng = np.random.default_rng(seed)
    h = rng.choice(len(weights), n, p=weights)
    x = [m.T[h] + s * rng.standard_normal((n, m.shape[0])) for m, s in zip(means, sigmas, strict=True)]
    return spark.createDataFrame([(i, *(v[i].tolist() for v in x)) for i in range(n)], "id long, x1 array<double>, x2 array<double>, x3 array<double>").repartition(8)


@pytest.fixture(scope="module")
def three_views(spark):
    rng = np.random.default_rng(0)
    means = [rng.uniform(-2, 2, (d, 2)) + 1 for d in (4, 5, 6)]
    return means, gaussian_views(spark, means, [0.4, 0.6], [0.3, 0.4, 0.5], 20_000).persist()


def test_three_views_of_gaussians(three_views):
    means, points = three_views
    weights, found, spread = moment_methods.gmm_from_views(points, (4, 5, 6), 2)
    assert all(matched(a, b) < 0.1 for a, b in zip(found, means, strict=True))
    assert sorted(weights) == pytest.approx([0.4, 0.6], abs=0.05)
    assert matched(moment_methods.simultaneous_diag(points, (4, 5, 6), 2), means[2]) < 0.1
    with pytest.raises(ValueError, match="rank"):
        moment_methods.decompose_views(*(np.einsum("ak,bk->ab", a[:, :1], b[:, :1]) for a, b in ((means[0], means[1]), (means[2], means[1]), (means[0], means[2]))), np.einsum("a,b,c->abc", *(m[:, 0] for m in means)), 2)


def test_em_over_views_finds_each_views_variance(three_views):
    means, points = three_views
    fitted, variances, history = em.fit_multiview(points, 2, (4, 5, 6), steps=20, gain=1e-6)
    rows = fitted.orderBy("k").collect()
    assert matched(np.array([r.m for r in rows]).T, np.concatenate(means)) < 0.02
    assert variances == pytest.approx([0.09, 0.16, 0.25], rel=0.05)
    assert sorted(r.w for r in rows) == pytest.approx([0.4, 0.6], abs=0.02)
    assert all(y >= x - 1e-6 * abs(x) for x, y in itertools.pairwise(history))


def test_spherical_gaussians(spark):
    rng = np.random.default_rng(5)
    means = rng.uniform(-3, 3, (6, 3))
    h = rng.choice(3, 30_000, p=[0.3, 0.3, 0.4])
    x = means.T[h] + 0.6 * rng.standard_normal((30_000, 6))
    points = spark.createDataFrame(list(enumerate(x.tolist())), "id long, x array<double>").repartition(8)
    _, found, sigma2 = moment_methods.spherical_gmm(points, 6, 3)
    assert matched(found, means) < 0.3 and sigma2 == pytest.approx(0.36, rel=0.1)
    centres, s2, _ = em.fit_gmm(points, 3, steps=15, gain=1e-6)
    assert matched(np.array([r.m for r in centres.orderBy("k").collect()]).T, means) < 0.02 and s2 == pytest.approx(0.36, rel=0.05)


def word_triples(spark, o, w, n, seed=3):
    """Trigram counts (w0, w1, w2, n) of words drawn from one of the topics (the columns of o) each."""
    rng = np.random.default_rng(seed)
    h = rng.choice(len(w), n, p=w)
    cumulated = o.cumsum(axis=0)
    x = np.stack([(rng.random(n)[:, None] > cumulated.T[h]).sum(axis=1) for _ in range(3)], axis=1)
    return spark.createDataFrame([tuple(map(int, r)) for r in x], "w0 int, w1 int, w2 int").groupBy("w0", "w1", "w2").agg(F.count("*").alias("n"))


def test_topics_from_triples(spark):
    rng = np.random.default_rng(4)
    o = rng.dirichlet(np.full(8, 0.4), 3).T
    tri = word_triples(spark, o, [0.3, 0.3, 0.4], 60_000).persist()
    weights, found = moment_methods.three_view_exact(N.views(tri, (0, 1, 2)), 8, 3)
    assert matched(found, o) < 0.15 and sorted(weights) == pytest.approx([0.3, 0.3, 0.4], abs=0.1)
    w, means = moment_methods.three_view(tri, 3, order=(0, 1, 2))
    assert matched(M.collect_matrix(means, 8, 3), o) < 0.2


def test_topics_of_documents(spark):
    rng = np.random.default_rng(6)
    o = rng.dirichlet(np.full(9, 0.3), 3).T
    docs = []
    for i in range(4000):
        theta = rng.dirichlet(np.full(3, 1 / 3))
        h = rng.choice(3, 60, p=theta)
        docs.append((i, [int(rng.choice(9, p=o[:, k])) for k in h]))
    _, found = moment_methods.lda(spark.createDataFrame(docs, "seq_id long, x array<int>").repartition(8), 9, 3)
    assert matched(found, o) < 0.25


def chain_sample(spark, c, n, length, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        h = rng.choice(len(c.pi), p=c.pi)
        for p in range(length):
            rows.append((i, p, int(rng.choice(c.o.shape[1], p=c.o[h]))))
            h = rng.choice(len(c.pi), p=c.t[h])
    return spark.createDataFrame(rows, "seq_id long, pos int, tok int").repartition(8)


def test_chain_from_views_and_em(spark):
    true = hmm.Chain(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.7, 0.2, 0.05, 0.05], [0.05, 0.1, 0.35, 0.5]]))
    tokens = chain_sample(spark, true, 2000, 10).persist()
    tri = N.counts(N.windows(tokens, 3), "w0", "w1", "w2")
    found = moment_methods.hmm_from_views(N.views(tri), moment_methods.first_tokens(tokens, 4), 4, 2)
    assert matched(found.o.T, true.o.T) < 0.1
    fitted, history = hmm.fit(N.pack(tokens), found, 5)
    o = min(([0, 1], [1, 0]), key=lambda o: np.linalg.norm(fitted.o[o] - true.o))
    assert np.abs(fitted.o[o] - true.o).max() < 0.05 and np.abs(fitted.t[np.ix_(o, o)] - true.t).max() < 0.06
    assert all(y >= x - 1e-6 * abs(x) for x, y in itertools.pairwise(history))


def test_edge_posteriors_and_slices(spark, monkeypatch):
    """Against all paths; batches cut to a few positions give the same."""
    c = hmm.Chain.random(2, 3, 5)
    seqs = [[0, 1, 2, 2], [1], [], [2, 0]]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, x array<int>").coalesce(1)
    want = {}
    for i, x in enumerate(seqs):
        paths = {h: c.pi[h[0]] * c.o[h[0], x[0]] * np.prod([c.t[a, b] * c.o[b, x[p + 1]] for p, (a, b) in enumerate(itertools.pairwise(h))]) for h in itertools.product(range(2), repeat=len(x))} if x else {}
        for p in range(1, len(x)):
            for a, b in itertools.product(range(2), repeat=2):
                want[i, p, a, b] = sum(v for h, v in paths.items() if (h[p - 1], h[p]) == (a, b)) / sum(paths.values())
    for cells in (1 << 20, 3):
        monkeypatch.setattr(hmm, "CELLS", cells)
        got = {(r.seq_id, r.pos, r.a, r.b): r.p for r in hmm.edge_posteriors(df, c).collect()}
        assert got == pytest.approx(want)
    import pyarrow as pa

    parts = list(hmm._slices(pa.record_batch([pa.array([[1] * n for n in (5, 1, 9, 2, 2)])], ["x"]), 6))
    assert [[len(x) for x in p["x"].to_pylist()] for p in parts] == [[1, 2, 2], [5], [9]]


def test_hidden_states_fixed_point(spark):
    rng = np.random.default_rng(8)
    o, w = rng.dirichlet(np.ones(4), 2), np.array([0.25, 0.75])
    n = np.round(100_000 * (w @ o)).astype(int)
    counts = spark.createDataFrame([(x, int(v)) for x, v in enumerate(n)], "x int, n long")
    table = spark.createDataFrame([(k, x, float(o[k, x])) for k in range(2) for x in range(4)], "k int, x int, p double")
    got = em.mixing_fit(counts, {(0,): 0.5, (1,): 0.5}, table, ["x"], 60, 1e-7)
    z = np.array([0.5, 0.5])
    for _ in range(60):
        r = z[:, None] * o
        z = (n * r / r.sum(axis=0)).sum(axis=1) / n.sum()
    assert [got[0,], got[1,]] == pytest.approx(z.tolist(), abs=1e-4)
    step = em.repeat(lambda q: em.state_step(counts, q, table), spark.createDataFrame([(0, 0.5), (1, 0.5)], "k int, w double"), 2)
    once = em.mixing_fit(counts, {(0,): 0.5, (1,): 0.5}, table, ["x"], 2)
    assert {r.k: r.w for r in step.collect()} == pytest.approx({k: v for (k,), v in once.items()})


def test_brown_clusters_in_batches(spark):
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 14, 150), rng.integers(0, 14, 150), rng.integers(1, 50, 150))]
    bigrams = spark.createDataFrame(rows, "c1 int, c2 int, n long").groupBy("c1", "c2").agg(F.sum("n").alias("n"))
    parts = []
    for batch in (1, 5, 64):
        got = estimators.brown_clusters(bigrams, list(range(14)), 4, batch)
        parts.append(sorted(sorted(w for w in got if got[w] == c) for c in set(got.values())))
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) == 4


def test_views_meet_by_id(spark):
    part = lambda n, ids: spark.createDataFrame([(i, [float(i), float(n)]) for i in ids], f"id long, x{n} array<double>")
    got = M.join_views(part(1, [1, 2, 3]), part(2, [2, 3, 4]), part(3, [3, 2, 9])).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, [i, 1.0], [i, 2.0], [i, 3.0]) for i in (2, 3)]


def test_words_are_encoded_alike_in_rows_and_by_joins(spark):
    docs = spark.createDataFrame([(1, ["a", "B9", "9", "-", "b", "a"]), (2, []), (3, None), (4, ["Élan", "été", "b"])], "seq_id long, ws array<string>")
    top = spark.createDataFrame([("a", 0), ("b", 1)], "word string, tok int")
    tokens = docs.select("seq_id", F.posexplode("ws").alias("pos", "word"))
    joined = {(r.seq_id, r.pos): r.tok for r in N.encode_top(tokens, top, 2).collect()}
    packed = {r.seq_id: r.x for r in N.encode_packed(docs, ["a", "b"]).collect()}
    assert {(i, p): t for i, x in packed.items() for p, t in enumerate(x or [])} == joined and set(packed) == {1, 2, 3, 4}


def test_shares_gather_no_group(spark):
    """Shares, scalings and projections are aggregations and joins: no window puts a large group in one task."""
    m = spark.range(100).selectExpr("cast(id % 10 AS int) AS i", "cast(id % 3 AS int) AS j", "cast(id AS double) AS v")
    tri = spark.range(100).selectExpr("id % 3 AS w0", "id % 5 AS w1", "id % 7 AS w2", "1L AS n")
    labelled = spark.range(100).selectExpr("id % 4 AS seq_id", "cast(id / 4 AS int) AS pos", "id % 5 AS tok", "id % 3 AS tag")
    o = labelled.groupBy(F.col("tag").alias("h1"), F.col("tok").alias("h2")).agg(F.count("*").alias("n"))
    for df in (N.views(tri), N.share(m, "v", "i"), C.normalized(m, "j"), C.minmax_rows(m), C.maxabs(m, "j"), C.simplex_columns(m, 0.1), L._stochastic(o, 1.0, ["h1"]), L._stochastic(o, 1.0, [])):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_dense_numbers_without_gaps(spark):
    words = spark.range(5000).selectExpr("md5(cast(id AS string)) AS word")
    got = N.sorted_ids(words).orderBy("tok").collect()
    assert [r.tok for r in got] == list(range(5000)) and [r.word for r in got] == sorted(r.word for r in got)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_streams_over_batches(spark, tmp_path):
    """Files come one batch at a time: a user's last type is kept between them, and what comes too late (by the watermark of the batch before the last) is left out of windows."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    batches = [[(1, at(0), 7, "a", 1.0), (2, at(5), 7, "b", 3.0), (3, at(6), 8, "a", 1.0)], [(4, at(300), 7, "a", 5.0)], [(9, at(302), 9, "a", 6.0)], [(5, at(10), 7, "b", 100.0), (6, at(301), 7, "a", 7.0), (7, at(600), 8, "b", 2.0)], [(8, at(900), 8, "a", 1.0)]]
    folder = str(tmp_path / "events")
    for b in batches:
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    source = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    pairs = {(r.user_id, r.prev, r.cur): r.n for r in stream.run_to_table(stream.transitions(source()), "append").groupBy("user_id", "prev", "cur").agg(F.sum("n").alias("n")).collect()}
    # event 5 is older than what user 7 has seen
    assert pairs == {(7, "a", "b"): 1, (7, "b", "a"): 1, (7, "a", "a"): 1, (8, "a", "b"): 1, (8, "b", "a"): 1}
    windows = {(r.start.hour, r.event_type): (r.n, r["mean"]) for r in stream.run_to_table(stream.moment_windows(source()), "append").collect()}
    assert windows[0, "b"] == (1, 3.0) and windows[5, "a"] == (3, 6.0)


def test_folder_needs_a_shared_one_on_a_cluster(monkeypatch):
    from momenta.sources import scratch

    class Conf:
        get = staticmethod(lambda k, d: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(Session(), "x")


def test_topics_of_a_vocabulary_of_thousands(spark):
    """Five thousand words in four topics that overlap a little, from lists of words: nothing of words times words is made."""
    rng, d, k = np.random.default_rng(21), 5000, 4
    truth = np.stack([rng.dirichlet(np.where(np.arange(d) // (d // k) == j, 0.5, 0.02)) for j in range(k)])
    docs = []
    for i in range(8000):
        topic = rng.dirichlet(np.full(k, 0.25))
        docs.append((i, rng.choice(d, rng.integers(3, 200), p=topic @ truth).tolist()))
    docs += [(-1, [1, 2]), (-2, []), (-3, None), (-4, [None, -5, d, 7])]
    weights, found = moment_methods.lda(spark.createDataFrame(docs, "seq_id long, x array<int>").repartition(8), d, k)
    assert found.shape == (d, k) and weights.max() < 0.4
    apart = np.abs(found.T[:, None] - truth).sum(axis=2)
    assert sorted(apart.argmin(axis=1)) == list(range(k)) and apart.min(axis=1).max() < 0.5


def test_pair_and_triple_products_count_places(spark):
    rng = np.random.default_rng(22)
    docs = [rng.integers(0, 6, n).tolist() for n in (3, 4, 7)]
    df = spark.createDataFrame([(x,) for x in docs], "x array<int>").repartition(2)
    factor = rng.normal(size=(6, 2))
    pairs, triples = np.zeros((6, 6)), np.zeros((6, 6, 6))
    for x in docs:
        n = len(x)
        for i, j in itertools.permutations(range(n), 2):
            pairs[x[i], x[j]] += 1 / (n * (n - 1)) / len(docs)
        for i, j, l in itertools.permutations(range(n), 3):
            triples[x[i], x[j], x[l]] += 1 / (n * (n - 1) * (n - 2)) / len(docs)
    _, product, count = moment_methods.pair_products(df, factor)
    assert count == 3 and np.allclose(product, pairs @ factor)
    assert np.allclose(moment_methods.triple_products(df, factor), np.einsum("abc,ai,bj,ck->ijk", triples, factor, factor, factor))


def test_views_of_hundreds_of_coordinates(spark):
    """d = 500: only thin factors come back."""
    rng, d, k = np.random.default_rng(23), 500, 3
    means = [rng.normal(size=(d, k)) for _ in range(3)]
    h = rng.choice(k, 3000, p=[0.5, 0.3, 0.2])
    x = [m.T[h] + 0.3 * rng.normal(size=(3000, d)) for m in means]
    points = spark.createDataFrame([(i, *(v[i].tolist() for v in x), 1.0 + i % 3) for i in range(3000)], "id long, x1 array<double>, x2 array<double>, x3 array<double>, w double").repartition(4)
    weights, found, spread = moment_methods.gmm_from_views(points, (d, d, d), k)
    assert np.allclose(sorted(weights), [0.2, 0.3, 0.5], atol=0.05)
    assert all(matched(found[v], means[v]) < 2.0 for v in range(3))
    assert matched(moment_methods.simultaneous_diag(points, (d, d, d), k), means[2]) < 2.0
    assert all(r["var"] < 0.3 for r in spread.collect())
