"""Queries on log-linear chains and grids, measured features, and blocks of grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from momenta.operators import labels as L
from momenta.operators import ngrams as N
from momenta.plans import estimators, grids, loglinear, moment_methods
from momenta.plans.loglinear import Lattice, Lattices
from momenta.queries.estimates import D, EMISSIONS, WORDS, Z, sequences
from momenta.queries.registry import query
from momenta.queries.sql import EV, chains, r6, trigram_counts
from momenta.queries.words import GRID, _grid
from momenta.sources.scratch import saved

CHAIN, GRIDS = Lattice(2, D), Lattice(2, D, cols=2, seen=2)


def _start(shape: Lattice) -> np.ndarray:
    return np.random.default_rng(0).normal(0, 0.3, shape.size)


def _lattice_sql(shape: Lattice, theta: np.ndarray) -> str:
    """Clamped and free features and the likelihood by recursion over rows, for the events' lattices (keys from 0) and for those without
    symbols, one for each number of rows (keys below 0)."""
    o, t = shape.split(theta)
    cells = lambda m, names: f"(SELECT * FROM (VALUES {', '.join(f'({i}, {j}, {float(v)!r}::DOUBLE)' for (i, j), v in np.ndenumerate(m))}) v({names}))"
    states = ", ".join(f"({s}, {c}, {h})" for s, row in enumerate(shape.states.tolist()) for c, h in enumerate(row))
    return f"""WITH RECURSIVE {EV}, o AS {cells(o, "h, x, w")}, t AS {cells(t, "a, b, w")}, st AS (SELECT * FROM (VALUES {states}) v(s, c, h)),
oz AS (SELECT h, ln(sum(exp(w))) AS z FROM o GROUP BY h),
across AS (SELECT s, coalesce(sum(t.w), 0) AS w FROM st l LEFT JOIN st r USING (s) LEFT JOIN t ON t.a = l.h AND t.b = r.h AND r.c = l.c + 1 GROUP BY s),
move AS (SELECT u.s AS a, l.s AS b, exp(sum(t.w)) AS v FROM st u JOIN st l ON u.c = l.c JOIN t ON t.a = u.h AND t.b = l.h GROUP BY u.s, l.s),
cell AS (SELECT seq_id AS key, pos // {shape.cols * shape.seen} AS r, pos // {shape.seen} % {shape.cols} AS c, tok FROM ev),
sizes AS (SELECT key, max(r) + 1 AS rows FROM cell GROUP BY key),
keys AS (SELECT key, rows, 1 AS n FROM sizes UNION ALL SELECT -rows, rows, count(*) FROM sizes GROUP BY rows),
obs AS (SELECT key, r, c, h, sum(w) AS w, count(*) AS n FROM cell JOIN o ON x = tok GROUP BY key, r, c, h),
node AS (SELECT p.key, p.r, st.s, exp(any_value(across.w) + sum(coalesce(obs.w, 0) + ({shape.seen} - coalesce(obs.n, 0)) * z)) AS v
    FROM (SELECT key, unnest(range(rows)) AS r FROM keys) p CROSS JOIN st JOIN across USING (s) JOIN oz USING (h) LEFT JOIN obs ON obs.key = p.key AND obs.r = p.r AND obs.c = st.c AND obs.h = st.h GROUP BY p.key, p.r, st.s),
f AS (SELECT key, r, s, v, 0::DOUBLE AS l FROM node WHERE r = 0
    UNION ALL SELECT key, r, s, v / z, l + ln(z) FROM (SELECT *, sum(v) OVER (PARTITION BY key) AS z FROM (
        SELECT f.key, node.r, node.s, sum(f.v * move.v) * any_value(node.v) AS v, any_value(f.l) AS l FROM f JOIN node ON node.key = f.key AND node.r = f.r + 1 JOIN move ON move.a = f.s AND move.b = node.s GROUP BY f.key, node.r, node.s))),
b AS (SELECT key, rows - 1 AS r, s, 1::DOUBLE AS v FROM keys, (SELECT DISTINCT s FROM st)
    UNION ALL SELECT key, r, s, v / sum(v) OVER (PARTITION BY key) FROM (
        SELECT b.key, b.r - 1 AS r, move.a AS s, sum(move.v * node.v * b.v) AS v FROM b JOIN node ON node.key = b.key AND node.r = b.r AND node.s = b.s JOIN move ON move.b = b.s WHERE b.r > 0 GROUP BY b.key, b.r, move.a)),
logs AS (SELECT key, any_value(l) + ln(sum(v)) AS z FROM (SELECT *, max(r) OVER (PARTITION BY key) AS last FROM f) WHERE r = last GROUP BY key),
g AS (SELECT key, r, s, f.v * b.v / sum(f.v * b.v) OVER (PARTITION BY key, r) AS p FROM f JOIN b USING (key, r, s)),
e AS (SELECT key, r, a, b, v / sum(v) OVER (PARTITION BY key, r) AS p FROM (
    SELECT f.key, f.r, f.s AS a, b.s AS b, f.v * move.v * node.v * b.v AS v FROM f JOIN b ON b.key = f.key AND b.r = f.r + 1 JOIN node ON node.key = b.key AND node.r = b.r AND node.s = b.s JOIN move ON move.a = f.s AND move.b = b.s)),
marg AS (SELECT key, r, c, h, sum(p) AS p FROM g JOIN st USING (s) GROUP BY key, r, c, h),
lack AS (SELECT key, h, sum(p * ({shape.seen} - coalesce(n, 0))) AS p FROM marg LEFT JOIN obs USING (key, r, c, h) GROUP BY key, h),
feat AS (SELECT key, 'o' AS kind, h AS i, tok AS j, p AS v FROM marg JOIN cell USING (key, r, c)
    UNION ALL SELECT key, 'o', h, x, p * exp(w - z) FROM lack JOIN oz USING (h) JOIN o USING (h)
    UNION ALL SELECT key, 't', u.h, l.h, p FROM e JOIN st u ON u.s = e.a JOIN st l ON l.s = e.b AND l.c = u.c
    UNION ALL SELECT key, 't', l.h, r.h, p FROM g JOIN st l USING (s) JOIN st r ON r.s = l.s AND r.c = l.c + 1),
total AS (SELECT count(*) AS n, (SELECT sum(CASE WHEN key < 0 THEN -k.n * z ELSE z END) FROM logs JOIN keys k USING (key)) AS ll FROM sizes)
SELECT kind, i::INTEGER AS i, j::INTEGER AS j, round(sum(v * k.n) FILTER (key >= 0) / any_value(total.n), 6) AS clamped, round(sum(v * k.n) FILTER (key < 0) / any_value(total.n), 6) AS free, round(any_value(ll / total.n), 5) AS loglik
FROM feat JOIN keys k USING (key), total GROUP BY kind, i, j"""


def _weights(spark, shape: Lattice, **columns):
    """(kind, i, j, columns): vectors of the weights' layout as rows."""
    kinds = [("o", i, j) for i in range(shape.k) for j in range(shape.d)] + [("t", i, j) for i in range(shape.k) for j in range(shape.k)]
    rows = [(*at, *(float(v[n]) for v in columns.values())) for n, at in enumerate(kinds)]
    return spark.createDataFrame(rows, "kind string, i int, j int, " + ", ".join(f"{c} double" for c in columns))


def _step(spark, d, shape):
    given, alone, ll = Lattices(sequences(spark, d), shape)(_start(shape))
    return _weights(spark, shape, clamped=given, free=alone).select("kind", "i", "j", r6("clamped").alias("clamped"), r6("free").alias("free"), F.round(F.lit(ll), 5).alias("loglik"))


def _fit(spark, d, shape):
    theta, history = estimators.loglinear_em(Lattices(sequences(spark, d), shape), _start(shape), 8)
    return _weights(spark, shape, w=theta).withColumns({"first": F.lit(history[0]), "score": F.lit(history[-1])})


@query("est_loglinear_chain_step", _lattice_sql(CHAIN, _start(CHAIN)))
def est_loglinear_chain_step(spark, d):
    """Features of users' events under a chain with fixed weights, given the events and without, whose difference is the gradient."""
    return _step(spark, d, CHAIN)


@query("est_loglinear_grid_step", _lattice_sql(GRIDS, _start(GRIDS)))
def est_loglinear_grid_step(spark, d):
    return _step(spark, d, GRIDS)


@query("est_loglinear_chain")
def est_loglinear_chain(spark, d):
    """A log-linear chain fitted to users' events, whole sequences of any length."""
    return _fit(spark, d, CHAIN)


@query("est_loglinear_grid")
def est_loglinear_grid(spark, d):
    return _fit(spark, d, GRIDS)


@query("est_measurement_em")
def est_measurement_em(spark, d):
    """A log-linear chain on windows of three words, whose (state, word) features are measured by the words' moments: (kind, i, j, w, value, gap, apart)."""
    tri = saved(trigram_counts(spark, d), "trigrams")
    w, o = moment_methods.three_view_exact(N.views(tri), WORDS, 2)
    shape = Lattice(2, WORDS)
    tau = np.full(shape.size, np.nan)
    tau[: 2 * WORDS] = (3 * w[:, None] * o.T).ravel()
    model = Lattices(tri.select(F.array("w0", "w1", "w2").alias("x"), "n"), shape)
    fitted = loglinear.fit_measured(model, _start(shape), tau, strength=100.0, steps=3, inner=20)
    value, gap, apart = fitted.history[-1]
    return _weights(spark, shape, w=fitted.theta).withColumns({"value": F.lit(value), "gap": F.lit(gap), "apart": F.lit(apart)})


# ---- labelled features of mixtures and grids


@query(
    "agg_feature_counts_mixture",
    f"WITH {EV}, b AS (SELECT seq_id, pos // 3 AS bag, tok, tag, pos FROM ev), h AS (SELECT seq_id, bag, any_value(tag) FILTER (pos % 3 = 0) AS h FROM b GROUP BY seq_id, bag) "
    "SELECT 'unary' AS kind, h::VARCHAR AS h1, tok::VARCHAR AS h2, count(*) AS n FROM b JOIN h USING (seq_id, bag) GROUP BY h, tok UNION ALL SELECT 'state', h::VARCHAR, NULL, count(*) FROM h GROUP BY h",
)
def agg_feature_counts_mixture(spark, d):
    """Bags of three events; a bag's label is its first event's."""
    rows = chains(spark, d).select("seq_id", F.floor(F.col("pos") / 3).alias("bag"), (F.col("pos") % 3).alias("place"), "tok", "tag")
    return L.bag_feature_counts(rows)


@query(
    "agg_feature_counts_grid",
    f"""WITH {EV}, grid AS (SELECT seq_id, pos // 4 AS r, pos // 2 % 2 AS c, pos % 2 AS d, tok, tag FROM ev), h AS (SELECT seq_id, r, c, tag AS h FROM grid WHERE d = 0)
    SELECT 'unary' AS kind, h::VARCHAR AS h1, tok::VARCHAR AS h2, count(*) AS n FROM grid JOIN h USING (seq_id, r, c) GROUP BY h, tok
    UNION ALL SELECT 'binary', a::VARCHAR, b::VARCHAR, count(*) FROM (
        SELECT u.h AS a, l.h AS b FROM h u JOIN h l ON u.seq_id = l.seq_id AND l.r = u.r + 1 AND l.c = u.c UNION ALL SELECT u.h, l.h FROM h u JOIN h l ON u.seq_id = l.seq_id AND l.r = u.r AND l.c = u.c + 1) GROUP BY a, b""",
)
def agg_feature_counts_grid(spark, d):
    """Grids of two columns; a cell's label is its first event's."""
    p = F.col("pos")
    return L.grid_feature_counts(chains(spark, d).select("seq_id", F.floor(p / 4).alias("r"), (F.floor(p / 2) % 2).alias("c"), (p % 2).alias("d"), "tok", "tag"))


# ---- blocks of two by two cells

BLOCK = [(0, 0), (0, 1), (1, 0), (1, 1)]
_OO = "[" + ", ".join(str(row) for row in EMISSIONS) + "]"
JOINT = np.array([Z[a,] for a in range(2)])
for _ in BLOCK[1:]:
    JOINT = np.kron(JOINT, [Z[a,] for a in range(2)])
_STATES = ", ".join(f"({i}, {[i >> (3 - c) & 1 for c in range(4)]}, {float(w)!r}::DOUBLE)" for i, w in enumerate(JOINT))
BLOCK_SQL = f"""WITH {EV}, {GRID}, line AS (SELECT seq_id, r, [max(tok) FILTER (c = 0 AND d = 0), max(tok) FILTER (c = 0 AND d = 1), max(tok) FILTER (c = 1 AND d = 0), max(tok) FILTER (c = 1 AND d = 1)] AS x FROM grid GROUP BY seq_id, r),
blk AS (SELECT x, count(*) AS n FROM (SELECT list_concat(u.x, l.x) AS x FROM line u JOIN line l ON l.seq_id = u.seq_id AND l.r = u.r + 1) WHERE len(list_filter(x, lambda v: v IS NULL)) = 0 GROUP BY x),
z4 AS (SELECT * FROM (VALUES {_STATES}) v(i, h, w)),
g AS (SELECT x, n, i, w, {" * ".join(f"({_OO})[h[{c + 1}] + 1][x[{2 * c + s + 1}] + 1]" for c in range(4) for s in range(2))} AS g FROM blk, z4),
q AS (SELECT *, sum(w * g) OVER (PARTITION BY x) AS q FROM g), total AS (SELECT sum(n) AS t FROM blk)"""


def _blocks(spark, d):
    return grids.blocks(_grid(spark, d), BLOCK)


@query("agg_grid_block_hessian", f"{BLOCK_SQL} SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.n * a.g * b.g / (a.q * a.q)) / any_value(t), 6) AS v FROM q a JOIN q b USING (x), total GROUP BY a.i, b.i")
def agg_grid_block_hessian(spark, d):
    """The information matrix of the joint states of 2 x 2 cells, 16 x 16 for two states, per block."""
    counts = saved(_blocks(spark, d), "blocks")
    _, expected, h = grids.block_sums(counts, JOINT, np.array(EMISSIONS))
    return spark.createDataFrame([(i, j, round(float(v), 6)) for (i, j), v in np.ndenumerate(h / expected.sum())], "i int, j int, v double")


@query("agg_grid_block_loglik", f"{BLOCK_SQL} SELECT round(sum(n * ln(q)), 3) AS loglik FROM (SELECT DISTINCT x, n, q FROM q)")
def agg_grid_block_loglik(spark, d):
    ll, _, _ = grids.block_sums(_blocks(spark, d), JOINT, np.array(EMISSIONS), information=False)
    return spark.createDataFrame([(round(ll, 3),)], "loglik double")


@query("est_grid_block_em", f"{BLOCK_SQL} SELECT i::INTEGER AS i, round(sum(n * w * g / q) / any_value(t), 6) AS w FROM q, total GROUP BY i")
def est_grid_block_em(spark, d):
    """One step; grids.fit_blocks goes on."""
    p, _ = grids.fit_blocks(_blocks(spark, d), JOINT, np.array(EMISSIONS), 1)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(p)], "i int, w double")
