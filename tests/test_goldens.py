"""Small tables worked out by hand, and properties of the estimators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from momenta.functions import text as T
from momenta.functions import vectors as V
from momenta.operators import bags as B
from momenta.operators import coo as C
from momenta.operators import labels as L
from momenta.operators import moments as M
from momenta.operators import ngrams as N
from momenta.operators import tab
from momenta.plans import em, estimators, hmm, moment_methods, small

DOCS = [[0, 1, 2, 3, 4], [0, 2, 3], [0, 3, 4], [2, 3, 4]]
CLUSTERED = [[0, 1, 2, 3, 4], [0, 4, 2], [4, 0, 3], [3, 2, 4]]


def corpus(spark, docs):
    return spark.createDataFrame([(i, p, t) for i, d in enumerate(docs) for p, t in enumerate(d)], "seq_id long, pos int, tok int")


def matrix(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(np.array(m, float))], "i int, j int, v double")


def test_unigrams(spark):
    got = {r.tok: r.n for r in N.word_counts(corpus(spark, DOCS), "tok").collect()}
    assert got == {0: 3, 1: 1, 2: 3, 3: 4, 4: 3}


def test_cluster_bigrams(spark):
    cluster = {3: 0, 0: 1, 2: 2, 1: 3, 4: 3}
    want = {}
    for d in CLUSTERED:
        for a, b in itertools.pairwise(d):
            want[cluster[a], cluster[b]] = want.get((cluster[a], cluster[b]), 0) + 1
    named = corpus(spark, CLUSTERED).replace({k: v + 10 for k, v in cluster.items()}, subset=["tok"])
    got = {(r.w0 - 10, r.w1 - 10): r.n for r in N.counts(N.windows(named, 2), "w0", "w1").collect()}
    assert got == want


def test_windows_in_rows_and_over_rows_agree(spark):
    rows = corpus(spark, DOCS)
    a = {tuple(r) for r in N.windows(rows, 3).collect()}
    assert a == {tuple(r) for r in N.packed_windows(N.pack(rows), 3).collect()}
    assert N.packed_windows(N.pack(corpus(spark, [[1], [2, 3]])), 3).count() == 0


def test_words(spark):
    df = spark.createDataFrame([("a  b\tc\n",), ("",), (None,), ("it_NN x",)], "t string")
    assert [r[0] for r in df.select(T.tokenize(F.col("t"))).collect()] == [["a", "b", "c"], [], [], ["it_NN", "x"]]
    w = spark.createDataFrame([("Ab",), ("9x",), ("ab",), ("-",), ("Élan",), ("ab-c9",), ("abcd",), ("",)], "w string")
    assert [r[0] for r in w.select(T.word_class(F.col("w"))).collect()] == [T.UPPER, T.DIGIT, T.LOWER, T.MISC, T.UPPER, T.LOWER, T.LOWER, T.MISC]
    assert [r[0] for r in w.select(T.char_trigrams(F.col("w"))).collect()] == [[], [], [], [], ["Éla", "lan"], ["ab-", "b-c", "-c9"], ["abc", "bcd"], []]
    assert w.where("w = 'abcd'").select(T.char_trigrams(F.col("w"), drop_last=True)).first()[0] == ["abc"]
    assert w.where("w = 'ab-c9'").select(T.word_features(F.col("w"))).first()[0] == ["digit", "hyphen", "tri=ab-", "tri=b-c", "tri=-c9"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -2.0, 2.0],)], "x array<double>")
    x = F.col("x")
    r = df.select(V.vsum(x), V.norm(x), V.argmin(x), V.min_abs(x), V.logsumexp(x), V.outside(x, 0.5, 1.5), V.hamming(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))).first()
    assert list(r) == pytest.approx([1.0, 3.0, 1, 1.0, np.log(np.exp([1, -2, 2]).sum()), False, 0.5])
    assert df.select(V.simplex_project(x)).first()[0] == pytest.approx([1 / 3, 0, 2 / 3])
    assert V.exponents(2, 2) == [(0, 2), (1, 1), (2, 0)]
    assert df.select(V.sym_expand2(x, 3)).first()[0] == [1.0, -4.0, 4.0, 4.0, -8.0, 4.0]


def test_tables(spark):
    df = spark.createDataFrame([("a=1\tb=x=y\ta=2",), ("junk",), ("",)], "line string")
    assert [r[0] for r in df.select(tab.parse(F.col("line"))).collect()] == [{"a": "2", "b": "x=y"}, {}, {}]
    rows = spark.createDataFrame([({"exp.k": "1", "v": "2"},), ({"exp.k": "1", "v": "4"},), ({"exp.k": "2", "v": "oops"},)], "m map<string,string>")
    assert tab.filter_rows(rows, "m", {"k": "1"}).count() == 2
    assert [list(r) for r in tab.extract(rows, "m", ["k", "v"]).orderBy("v").collect()] == [["1", "2"], ["1", "4"], ["2", "oops"]]
    keyed = rows.select(F.map_concat("m", F.create_map(F.lit("k"), F.try_element_at("m", F.lit("exp.k")))).alias("m"))
    got = {r.k: (r["mean"], r["first"]) for r in tab.aggregate(keyed, "m", ["k"]).where("name = 'v'").collect()}
    assert got == {"1": (3.0, None), "2": (None, "oops")}


def test_bags(spark):
    a, b = (spark.createDataFrame(list(x.items()), "k string, w double") for x in ({"x": 1.0, "y": 2.0}, {"y": 5.0, "z": 1.0}))
    table = lambda df: {r.k: r.w for r in df.collect()}
    assert table(B.merge(a, b, "k")) == {"x": 1, "y": 5, "z": 1}
    assert table(B.axpy(a, b, "k", 2.0)) == {"x": 1, "y": 12}
    assert table(B.add_all(a, b, "k")) == {"x": 1, "y": 7, "z": 1}
    assert table(B.remove_all(a, b, "k")) == {"x": 1}
    assert B.squared_difference(a, b, "k").first()[0] == 1 + 9 + 1
    assert B.dot(a, b, "k").first()[0] == 10


def test_matrices(spark):
    m = np.array([[1.0, 2, 3], [4, 5, 6]])
    df = matrix(spark, m)
    back = lambda d, *shape: M.collect_matrix(d, *shape)
    f = np.arange(6.0).reshape(3, 2)
    assert np.allclose(back(C.multilinear(df, {"j": matrix(spark, f)}), 2, 2), m @ f)
    t = np.arange(24.0).reshape(2, 3, 4)
    td = spark.createDataFrame([(*i, float(v)) for i, v in np.ndenumerate(t)], "i int, j int, k int, v double")
    sizes = {"i": 2, "j": 3, "k": 4}
    for mode in "ijk":
        assert np.allclose(back(C.fold(C.unfold(td, mode, sizes), mode, sizes), 2, 3, 4), t)
    s = back(C.symmetrize(spark.createDataFrame([(0, 1, 6.0)], "i int, j int, v double")), 2, 2)
    assert np.allclose(s, [[0, 3], [3, 0]])
    assert np.allclose(back(C.normalized(df, "i"), 2, 3), m / m.sum(axis=1, keepdims=True))
    assert C.column_gap(df).first().gap == pytest.approx(np.sqrt(2))
    assert C.allclose(df, df, 0.0).first().close
    assert np.allclose(back(C.canonical(matrix(spark, [[3, 1], [0, 2]])), 2, 2), [[0, 2], [3, 1]])


def test_moments_against_loops(spark):
    rng = np.random.default_rng(0)
    x = rng.random((100, 3, 4))
    q = rng.random(100)
    df = spark.createDataFrame([(i, *x[i].tolist(), float(q[i])) for i in range(100)], "id int, x1 array<double>, x2 array<double>, x3 array<double>, q double")
    a, b, c = x[:, 0], x[:, 1], x[:, 2]
    assert np.allclose(M.collect_matrix(M.pairs(df), 4, 4), np.mean([np.outer(u, v) for u, v in zip(a, b)], axis=0))
    assert np.allclose(M.collect_matrix(M.triples(df), 4, 4, 4), np.einsum("na,nb,nc->abc", a, b, c) / 100)
    assert np.allclose(M.collect_matrix(M.pairs_weighted(df), 4, 4), np.einsum("n,na,nb->ab", q, a, a))
    th = [1.0, 2, 0, -1]
    assert np.allclose(M.collect_matrix(M.triples_projected(df, th), 4, 4), np.einsum("na,nb,n->ab", a, b, c @ th) / 100)
    assert np.allclose(M.collect_matrix(M.covariance(df), 4, 4), np.cov(a.T, b.T, bias=True)[:4, 4:])
    assert M.pairs(df.limit(0)).count() == 0


def test_matching_and_whitening():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (4, 4), (3, 5), (5, 3)):
        cost = rng.random((n, m))
        got = sum(cost[a, b] for a, b in small.best_matching(cost.tolist()))
        wide = cost if n <= m else cost.T
        assert got == pytest.approx(min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide))))
    a = rng.random((6, 3))
    w = small.whitener(a @ a.T, 3)
    assert np.allclose(w.T @ a @ a.T @ w, np.eye(3))
    with pytest.raises(ValueError):
        small.whitener(a @ a.T, 4)


def recovered(got, want):
    """Columns equal up to their order."""
    d = np.linalg.norm(got[:, :, None] - want[:, None, :], axis=0)
    return max(d[a, b] for a, b in small.best_matching(d.tolist()))


def test_views_are_recovered_from_exact_moments():
    rng = np.random.default_rng(2)
    k, d = 3, 6
    w = rng.dirichlet(np.full(k, 5.0))
    m1, m2, m3 = (rng.dirichlet(np.ones(d), k).T for _ in range(3))
    pair = lambda a, b: (a * w) @ b.T
    weights, means = moment_methods.decompose_views(pair(m1, m2), pair(m3, m2), pair(m1, m3), np.einsum("k,ak,bk,ck->abc", w, m1, m2, m3), k)
    assert recovered(means, m3) < 1e-6
    assert np.allclose(sorted(weights), sorted(w), atol=1e-6)


def brute(c, x):
    paths = list(itertools.product(range(len(c.pi)), repeat=len(x)))
    p = [c.pi[h[0]] * np.prod([c.t[a, b] for a, b in itertools.pairwise(h)]) * np.prod([c.o[a, s] for a, s in zip(h, x)]) for h in paths]
    return paths, np.array(p)


def test_chain_against_enumeration(spark):
    c = hmm.Chain.random(3, 4, 5)
    seqs = [(1, [0, 1, 3]), (2, [2]), (3, [3, 3, 0, 1, 2]), (4, [])]
    df = spark.createDataFrame(seqs, "seq_id long, x array<int>")
    best = {r.seq_id: r.h for r in hmm.viterbi(df, c).collect()}
    ll = {r.seq_id: r.loglik for r in hmm.log_likelihood(df, c).collect()}
    post = {(r.seq_id, r.pos, r.state): r.p for r in hmm.state_posteriors(df, c).collect()}
    assert best[4] == [] and ll[4] == 0
    for i, x in seqs[:3]:
        paths, p = brute(c, x)
        assert tuple(best[i]) == paths[p.argmax()]
        assert ll[i] == pytest.approx(np.log(p.sum()))
        for pos in range(len(x)):
            for s in range(3):
                assert post[i, pos, s] == pytest.approx(sum(q for h, q in zip(paths, p) if h[pos] == s) / p.sum())


def test_chain_em_does_not_fall(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.integers(0, 4, 12).tolist()) for i in range(60)], "seq_id long, x array<int>")
    fitted, history = hmm.fit(df, hmm.Chain.random(2, 4, 1), 6)
    assert all(b >= a - 1e-8 for a, b in itertools.pairwise(history))
    assert np.allclose(fitted.t.sum(axis=1), 1) and np.allclose(fitted.o.sum(axis=1), 1) and fitted.pi.sum() == pytest.approx(1)


def test_gmm_and_regressions(spark):
    rng = np.random.default_rng(4)
    centre = np.array([[0.0, 0], [5, 5], [0, 6]])
    pts = [(i, (centre[i % 3] + rng.normal(0, 0.3, 2)).tolist()) for i in range(300)]
    centres, sigma2, history = em.fit_gmm(spark.createDataFrame(pts, "id long, x array<double>"), 3, 6)
    assert recovered(np.array([r.m for r in centres.collect()]).T, centre.T) < 0.2
    assert sigma2 == pytest.approx(0.09, rel=0.3)
    assert all(b >= a - 1e-6 * abs(a) - 0.5 for a, b in itertools.pairwise(history))
    betas = np.array([[1.0, 2.0], [-1.0, 0.5]])
    x = rng.normal(0, 1, (400, 2))
    y = [(float(x[i] @ betas[i % 2] + rng.normal(0, 0.05)), x[i].tolist()) for i in range(400)]
    got, w, s2, history = em.fit_regressions(spark.createDataFrame(y, "y double, x array<double>"), 2, 8, betas=[[0.5, 1.0], [-0.5, 0.0]])
    assert recovered(got.T, betas.T) < 0.1
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history))


def test_ridge_and_low_rank(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 3))
    beta = np.array([1.0, -2.0, 0.5])
    df = spark.createDataFrame([(float(a @ beta), a.tolist()) for a in x], "y double, x array<double>")
    assert np.allclose(estimators.ridge(df, 3), beta)
    v = np.array([1.0, -1.0, 0.5])
    quad = spark.createDataFrame([(float((a @ v) ** 2), a.tolist()) for a in x], "y double, x array<double>")
    b, losses = estimators.prox_low_rank(quad, 3, 2, penalty=1e-3, steps=200)
    assert np.allclose(b, np.outer(v, v), atol=0.05)
    assert losses[-1] <= losses[0]


def test_singular_values(spark):
    rng = np.random.default_rng(6)
    m = rng.random((12, 3)) @ rng.random((3, 9))
    u, s, v = moment_methods.randomized_svd(matrix(spark, m), 3)
    assert np.allclose(s, np.linalg.svd(m, compute_uv=False)[:3], rtol=1e-6)
    a, b = M.collect_matrix(u, 12, 3), M.collect_matrix(v, 9, 3)
    assert np.allclose((a * s) @ b.T, m, atol=1e-6)


def test_scores(spark):
    rows = [("a", 0, 5), ("a", 1, 1), ("b", 1, 4), ("c", 0, 3)]
    conf = spark.createDataFrame(rows, "gold string, pred int, n long")
    assert L.many_to_one(conf).first().accuracy == pytest.approx(9 / 13)
    assert L.one_to_one(conf).first().accuracy == pytest.approx(9 / 13)


def test_brown_joins_words_of_like_neighbours(spark):
    # 0 and 1 both stand before 2, 3 stands before 4
    rows = [(0, 2, 50), (1, 2, 50), (3, 4, 50), (2, 3, 20), (4, 0, 20), (2, 0, 10), (2, 1, 10), (4, 1, 20)]
    got = estimators.brown_clusters(spark.createDataFrame(rows, "c1 int, c2 int, n long"), [2, 0, 1, 3, 4], 4)
    assert got[0] == got[1] and len(set(got.values())) == 4


def _information(m):
    left, right = m.sum(axis=1), m.sum(axis=0)
    return sum(m[i, j] * np.log(m[i, j] / (left[i] * right[j])) for i, j in np.ndindex(m.shape) if m[i, j] > 0)


def test_brown_merges_as_if_every_table_was_built_anew(spark):
    rng = np.random.default_rng(11)
    for size, k in ((9, 3), (12, 4), (5, 1)):
        n = rng.poisson(2, (size, size)) * rng.integers(0, 2, (size, size))
        groups = [[i] for i in range(size)]
        while len(groups) > k:
            best = None
            for a in range(len(groups)):
                for b in range(a + 1, len(groups)):
                    trial = [*groups[:a], groups[a] + groups[b], *groups[a + 1 : b], *groups[b + 1 :]]
                    value = round(_information(np.array([[n[np.ix_(x, y)].sum() for y in trial] for x in trial]) / n.sum()), 11)
                    if best is None or value > best[0]:
                        best = value, trial
            groups = best[1]
        rows = [(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(n) if v]
        got = estimators.top_word_clusters(spark.createDataFrame(rows, "c1 int, c2 int, n long"), list(range(size)), k)
        assert sorted(sorted(w for w in range(size) if got[w] == c) for c in set(got.values())) == sorted(map(sorted, groups))


def test_brown_puts_all_other_words_together(spark):
    rows = [(0, 2, 50), (1, 2, 50), (3, 4, 50), (2, 3, 20), (4, 0, 20), (2, 0, 10), (2, 1, 10), (4, 1, 20), (77, 0, 3), (4, 99, 3)]
    got = estimators.top_word_clusters(spark.createDataFrame(rows, "c1 int, c2 int, n long"), [2, 0, 1, 3, 4], 5)
    assert set(got) == {0, 1, 2, 3, 4, None} and got[0] == got[1] and len(set(got.values())) == 5


def test_baum_welch_over_distinct_sequences(spark, tmp_path):
    """Repeated sequences are read once and count as often as they come; every step leaves a row."""
    rng = np.random.default_rng(12)
    kinds = [rng.integers(0, 4, n).tolist() for n in (1, 3, 6, 9)]
    x = [kinds[i % 4] for i in range(22)]
    df = spark.createDataFrame(list(enumerate(x)), "seq_id long, x array<int>")
    start = hmm.Chain.random(2, 4, 3)
    assert hmm.distinct(df).count() == 4
    plain, weighted = ({(r.kind, r.i, r.j): r.v for r in hmm.expected_counts(rows, start, w).collect()} for rows, w in ((df, None), (hmm.distinct(df), "n")))
    assert plain.keys() == weighted.keys() and all(np.isclose(plain[c], weighted[c]) for c in plain)
    _, history = hmm.fit(df, start, 4, metrics=str(tmp_path / "metrics"))
    assert [r.loglik for r in spark.read.parquet(str(tmp_path / "metrics")).orderBy("step").collect()] == history
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False))


def test_start_of_a_mixture_in_few_rounds(spark):
    """Planted centres are met with rounds, not one pass a centre; weights are uniform, the variance that of the noise."""
    rng = np.random.default_rng(13)
    truth = rng.normal(0, 10, (12, 4))
    x = truth[rng.integers(0, 12, 3000)] + rng.normal(0, 0.1, (3000, 4))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    centres, sigma2 = em.kmeans_parallel(points, 12, seed=1)
    rows = centres.collect()
    assert len(rows) == 12 and all(np.isclose(r.w, 1 / 12) for r in rows)
    m = np.array([r.m for r in rows])
    assert np.sqrt(((truth[:, None] - m) ** 2).sum(axis=2)).min(axis=1).max() < 0.2 and 0.005 < sigma2 < 0.02
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id long, x array<double>")
    centres, sigma2 = em.kmeans_parallel(same, 3)
    assert [list(r.m) for r in centres.collect()] == [[1.0, 2.0]] and sigma2 == 0


def test_ragged_arrays_and_large_results_are_refused(spark):
    ragged = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],)], "x1 array<double>").coalesce(1)
    with pytest.raises(Exception, match="arrays of 2 to 4 numbers"):
        M.first_moment(ragged).collect()
    with pytest.raises(ValueError, match="too many"):
        M.collect_matrix(ragged, 2000, 2000)
