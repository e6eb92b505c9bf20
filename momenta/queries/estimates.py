"""Queries on estimators, decoders and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from momenta.functions import text as T
from momenta.functions import vectors as V
from momenta.operators import coo as C
from momenta.operators import labels as L
from momenta.operators import mixtures as X
from momenta.operators import ngrams as N
from momenta.plans import em, estimators, hmm, moment_methods, scans
from momenta.plans.small import best_matching
from momenta.queries.numbers import BETAS, _solved, samples, vectors
from momenta.queries.registry import query
from momenta.queries.sql import EV, TOP, chains, packed, r6, table, trigram_counts
from momenta.queries.sql import tokens as tokens_of
from momenta.sources.scratch import saved
from momenta.streaming import events as stream

K, D, WORDS = 3, 5, TOP + 4


def _matrix(spark, m, name="v"):
    m = np.atleast_2d(np.asarray(m, float))
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], f"i int, j int, {name} double")


def sequences(spark, d):
    return N.pack(chains(spark, d), "tok", "x")


def chain(spark, d):
    """The chain of the labelled events."""
    return hmm.Chain.from_table(L.supervised_chain(chains(spark, d), 1.0), K, D)


# ---- decoders

#: The chain's parameters as agg_supervised_hmm has them, and the forward and backward variables by recursion over places.
HMM_SQL = f"""WITH RECURSIVE {EV}, tr AS (SELECT lag(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS a, tag AS b FROM ev), tags AS (SELECT DISTINCT tag FROM ev), toks AS (SELECT DISTINCT tok FROM ev),
pi AS (SELECT tag AS h, (count(*) + 1) / sum(count(*) + 1) OVER () AS p FROM ev GROUP BY tag),
t AS (SELECT x.tag AS a, y.tag AS b, (count(tr.b) + 1) / sum(count(tr.b) + 1) OVER (PARTITION BY x.tag) AS p FROM tags x CROSS JOIN tags y LEFT JOIN tr ON tr.a = x.tag AND tr.b = y.tag GROUP BY x.tag, y.tag),
o AS (SELECT x.tag AS h, y.tok, (count(ev.pos) + 1) / sum(count(ev.pos) + 1) OVER (PARTITION BY x.tag) AS p FROM tags x CROSS JOIN toks y LEFT JOIN ev ON ev.tag = x.tag AND ev.tok = y.tok GROUP BY x.tag, y.tok),
f AS (SELECT seq_id, pos, h, pi.p * o.p AS v, 0::DOUBLE AS l FROM ev JOIN o USING (tok) JOIN pi USING (h) WHERE pos = 0
    UNION ALL SELECT seq_id, pos, h, v / z, l + ln(z) FROM (SELECT *, sum(v) OVER (PARTITION BY seq_id) AS z FROM (
        SELECT f.seq_id, ev.pos, o.h, sum(f.v * t.p) * any_value(o.p) AS v, any_value(f.l) AS l FROM f JOIN ev ON ev.seq_id = f.seq_id AND ev.pos = f.pos + 1 JOIN o ON o.tok = ev.tok JOIN t ON t.a = f.h AND t.b = o.h GROUP BY f.seq_id, ev.pos, o.h))),
ll AS (SELECT seq_id, any_value(l) + ln(sum(v)) AS loglik, any_value(pos) + 1 AS n FROM (SELECT *, max(pos) OVER (PARTITION BY seq_id) AS last FROM f) WHERE pos = last GROUP BY seq_id)"""
BACK_SQL = f"""{HMM_SQL}, b AS (SELECT seq_id, pos, h, 1::DOUBLE AS v FROM (SELECT seq_id, max(pos) AS pos FROM ev GROUP BY seq_id), (SELECT tag AS h FROM tags)
    UNION ALL SELECT seq_id, pos, h, v / sum(v) OVER (PARTITION BY seq_id) FROM (
        SELECT b.seq_id, b.pos - 1 AS pos, t.a AS h, sum(t.p * o.p * b.v) AS v FROM b JOIN ev ON ev.seq_id = b.seq_id AND ev.pos = b.pos JOIN o ON o.tok = ev.tok AND o.h = b.h JOIN t ON t.b = b.h WHERE b.pos > 0 GROUP BY b.seq_id, b.pos, t.a))"""


@query("dec_viterbi")
def dec_viterbi(spark, d):
    return scans.viterbi(chains(spark, d), chain(spark, d))


@query("dec_posteriors", f"{BACK_SQL} SELECT seq_id, pos::INTEGER AS pos, h AS state, round(f.v * b.v / sum(f.v * b.v) OVER (PARTITION BY seq_id, pos), 6) AS p FROM f JOIN b USING (seq_id, pos, h)")
def dec_posteriors(spark, d):
    return scans.state_posteriors(chains(spark, d), chain(spark, d)).withColumn("p", r6("p"))


@query(
    "dec_edge_posteriors",
    f"""{BACK_SQL} SELECT seq_id, pos::INTEGER AS pos, a, b, round(v / sum(v) OVER (PARTITION BY seq_id, pos), 6) AS p FROM (
        SELECT f.seq_id, f.pos + 1 AS pos, f.h AS a, b.h AS b, f.v * t.p * o.p * b.v AS v FROM f JOIN b ON b.seq_id = f.seq_id AND b.pos = f.pos + 1 JOIN ev ON ev.seq_id = b.seq_id AND ev.pos = b.pos JOIN t ON t.a = f.h AND t.b = b.h JOIN o ON o.h = b.h AND o.tok = ev.tok)""",
)
def dec_edge_posteriors(spark, d):
    return hmm.edge_posteriors(sequences(spark, d), chain(spark, d)).withColumn("p", r6("p"))


@query("dec_seq_loglik", f"{HMM_SQL} SELECT seq_id, round(loglik, 6) AS loglik FROM ll")
def dec_seq_loglik(spark, d):
    return scans.log_likelihood(chains(spark, d), chain(spark, d)).withColumn("loglik", r6("loglik"))


COMPLETE = f"""WITH {EV}, tr AS (SELECT seq_id, pos, tag, tok, lag(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS prev FROM ev),
o AS (SELECT tag, tok, ln(count(*) / sum(count(*)) OVER (PARTITION BY tag)) AS lp FROM ev GROUP BY tag, tok),
t AS (SELECT prev, tag, ln(count(*) / sum(count(*)) OVER (PARTITION BY prev)) AS lp FROM tr WHERE prev IS NOT NULL GROUP BY prev, tag),
p AS (SELECT tag, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM ev GROUP BY tag)
SELECT seq_id, round(sum(o.lp + coalesce(t.lp, p.lp)), 5) AS loglik FROM tr JOIN o USING (tag, tok) LEFT JOIN t ON t.prev = tr.prev AND t.tag = tr.tag LEFT JOIN p ON tr.prev IS NULL AND p.tag = tr.tag GROUP BY seq_id"""


@query("dec_complete_loglik", COMPLETE)
def dec_complete_loglik(spark, d):
    """ln p(x, h) of labelled sequences: log-parameters joined to tokens and edges."""
    from pyspark.sql import Window

    rows = chains(spark, d).withColumn("prev", F.lag("tag").over(Window.partitionBy("seq_id").orderBy("pos")))
    params = saved(L.supervised_chain(chains(spark, d)), "chain").withColumn("lp", F.ln("p"))
    # parameters are few by kind: states by symbols
    part = lambda kind, a, b=None: F.broadcast(params.where(F.col("kind") == kind).select(F.col("h1").cast("int").alias(a), *([F.col("h2").cast("int").alias(b)] if b else []), F.col("lp").alias(f"lp_{kind}")))
    joined = rows.join(part("O", "tag", "tok"), ["tag", "tok"]).join(part("T", "prev", "tag"), ["prev", "tag"], "left").join(part("pi", "tag"), "tag")
    return joined.groupBy("seq_id").agg(F.round(F.sum(F.col("lp_O") + F.coalesce("lp_T", "lp_pi")), 5).alias("loglik"))


@query("agg_dataset_loglik", f"{HMM_SQL} SELECT round(avg(loglik), 6) AS mean, round(exp(-sum(loglik) / sum(n)), 6) AS perplexity FROM ll")
def agg_dataset_loglik(spark, d):
    scored = hmm.log_likelihood(sequences(spark, d), chain(spark, d)).join(N.pack(chains(spark, d), "tok", "x").select("seq_id", F.size("x").alias("n")), "seq_id")
    return scored.agg(r6(F.avg("loglik")).alias("mean"), r6(F.exp(-F.sum("loglik") / F.sum("n"))).alias("perplexity"))


@query("score_pos_induction")
def score_pos_induction(spark, d):
    """A chain fitted without labels, decoded, and held against the labels."""
    fitted, _ = hmm.fit(sequences(spark, d), hmm.Chain.random(K, D, 1), 5)
    guessed = hmm.viterbi(sequences(spark, d), fitted).select("seq_id", F.posexplode("h").alias("pos", "guess"))
    conf = saved(L.confusion(chains(spark, d).join(guessed, ["seq_id", "pos"]), "tag", "guess"), "confusion")
    one = L.one_to_one(conf).agg(F.max("accuracy").alias("one_to_one"))
    return L.many_to_one(conf).withColumnRenamed("accuracy", "many_to_one").crossJoin(one)


@query(
    "est_baum_welch_step",
    f"""{BACK_SQL}, g AS (SELECT seq_id, pos, h, f.v * b.v / sum(f.v * b.v) OVER (PARTITION BY seq_id, pos) AS p FROM f JOIN b USING (seq_id, pos, h)),
    e AS (SELECT a, b, v / sum(v) OVER (PARTITION BY seq_id, pos) AS p FROM (SELECT f.seq_id, f.pos, f.h AS a, b.h AS b, f.v * t.p * o.p * b.v AS v
        FROM f JOIN b ON b.seq_id = f.seq_id AND b.pos = f.pos + 1 JOIN ev ON ev.seq_id = b.seq_id AND ev.pos = b.pos JOIN t ON t.a = f.h AND t.b = b.h JOIN o ON o.h = b.h AND o.tok = ev.tok))
    SELECT 'pi' AS kind, h::INTEGER AS i, 0 AS j, round(sum(p) / sum(sum(p)) OVER (), 6) AS v, (SELECT round(sum(loglik), 4) FROM ll) AS loglik FROM g WHERE pos = 0 GROUP BY h
    UNION ALL SELECT 'T', a::INTEGER, b::INTEGER, round(sum(p) / sum(sum(p)) OVER (PARTITION BY a), 6), (SELECT round(sum(loglik), 4) FROM ll) FROM e GROUP BY a, b
    UNION ALL SELECT 'O', h::INTEGER, tok::INTEGER, round(sum(p) / sum(sum(p)) OVER (PARTITION BY h), 6), (SELECT round(sum(loglik), 4) FROM ll) FROM g JOIN ev USING (seq_id, pos) GROUP BY h, tok""",
)
def est_baum_welch_step(spark, d):
    """One step from the chain of the labelled events, over distinct sequences."""
    new, ll = hmm.em_step(hmm.distinct(sequences(spark, d)), chain(spark, d))
    rows = [(kind, i, j, round(float(v), 6)) for kind, m in (("pi", new.pi[:, None]), ("T", new.t), ("O", new.o)) for (i, j), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "kind string, i int, j int, v double").withColumn("loglik", F.lit(round(ll, 4)))


@query("est_baum_welch")
def est_baum_welch(spark, d):
    fitted, history = hmm.fit(sequences(spark, d), hmm.Chain.random(K, D, 1), 5)
    return _matrix(spark, fitted.t).withColumn("loglik", F.lit(history[-1]))


# ---- composite likelihood


def _pairs(spark, d):
    return N.windows(chains(spark, d), 2).groupBy(F.col("w0").alias("x1"), F.col("w1").alias("x2")).agg(F.count("*").alias("n"))


def _singles(spark, d):
    return chains(spark, d).groupBy(F.col("tok").alias("x")).agg(F.count("*").alias("n"))


def _emissions(spark):
    """Fixed emissions of two states over the five event types."""
    o = [[0.4, 0.3, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]]
    return spark.createDataFrame([(k, x, o[k][x]) for k in range(2) for x in range(5)], "k int, x int, p double")


O_SQL = "o AS (SELECT unnest([0,0,0,0,0,1,1,1,1,1])::INTEGER AS k, unnest([0,1,2,3,4,0,1,2,3,4])::INTEGER AS x, unnest([0.4,0.3,0.1,0.1,0.1,0.1,0.1,0.2,0.3,0.3])::DOUBLE AS p), z AS (SELECT unnest([0, 1])::INTEGER AS k, unnest([0.6, 0.4])::DOUBLE AS w), zz AS (SELECT a.k AS k1, b.k AS k2, a.w * b.w AS w FROM z a, z b)"
C_SQL = f"{EV}, c1 AS (SELECT tok AS x, count(*) AS n FROM ev GROUP BY tok), bi AS (SELECT tok AS x1, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos) AS x2 FROM ev), c2 AS (SELECT x1, x2, count(*) AS n FROM bi WHERE x2 IS NOT NULL GROUP BY ALL), {O_SQL}"
J2_SQL = C_SQL + ", j AS (SELECT x1, x2, n, k1, k2, a.p * b.p AS g, w, w * a.p * b.p AS v FROM c2 JOIN o a ON a.x = x1 JOIN o b ON b.x = x2 JOIN zz ON k1 = a.k AND k2 = b.k), q AS (SELECT *, sum(v) OVER (PARTITION BY x1, x2) AS q FROM j)"


def _z(spark):
    return spark.createDataFrame([(0, 0.6), (1, 0.4)], "k int, w double")


def _zz(spark):
    z = _z(spark)
    return z.select(F.col("k").alias("k1"), F.col("w").alias("a")).crossJoin(z.select(F.col("k").alias("k2"), F.col("w").alias("b"))).select("k1", "k2", (F.col("a") * F.col("b")).alias("w"))


@query("agg_pi_loglik", f"WITH {C_SQL} SELECT round(sum(n * ln(q)), 3) AS loglik FROM (SELECT x, n, sum(w * p) AS q FROM c1 JOIN o USING (x) JOIN z USING (k) GROUP BY x, n)")
def agg_pi_loglik(spark, d):
    return em.composite_loglik(_singles(spark, d), _z(spark), _emissions(spark)).select(F.round("loglik", 3).alias("loglik"))


@query("agg_pair_loglik", f"WITH {J2_SQL} SELECT round(sum(n * ln(q)), 3) AS loglik FROM (SELECT DISTINCT x1, x2, n, q FROM q)")
def agg_pair_loglik(spark, d):
    return em.pair_loglik(_pairs(spark, d), _zz(spark), _emissions(spark)).select(F.round("loglik", 3).alias("loglik"))


@query("est_pi_em", f"WITH {C_SQL}, j AS (SELECT x, k, n, w * p AS v FROM c1 JOIN o USING (x) JOIN z USING (k)) SELECT k, round(sum(r) / (SELECT sum(n) FROM c1), 6) AS w FROM (SELECT k, n * v / sum(v) OVER (PARTITION BY x) AS r FROM j) GROUP BY k")
def est_pi_em(spark, d):
    """One step; est_pi_em_fit goes on."""
    return em.state_step(_singles(spark, d), _z(spark), _emissions(spark)).withColumn("w", r6("w"))


#: Steps that a fit goes on at most, in SQL always.
SETTLED = 80
Z = {(0,): 0.6, (1,): 0.4}
ZZ = {(a, b): Z[a,] * Z[b,] for a in range(2) for b in range(2)}


@query(
    "est_pi_em_fit",
    f"WITH RECURSIVE {C_SQL}, em(step, k, w) AS (SELECT 0, k, w FROM z UNION ALL SELECT step + 1, k, sum(r) / (SELECT sum(n) FROM c1) FROM ("
    f"SELECT step, k, n * v / sum(v) OVER (PARTITION BY x) AS r FROM (SELECT em.step, em.k, x, n, em.w * p AS v FROM em JOIN o USING (k) JOIN c1 USING (x) WHERE em.step < {SETTLED})) GROUP BY step, k) SELECT k, round(w, 5) AS w FROM em WHERE step = {SETTLED}",
)
def est_pi_em_fit(spark, d):
    w = em.mixing_fit(_singles(spark, d), Z, _emissions(spark), ["x"], SETTLED)
    return spark.createDataFrame([(k, round(v, 5)) for (k,), v in w.items()], "k int, w double")


@query("est_pair_em", f"WITH {J2_SQL} SELECT k1, k2, round(sum(n * v / q) / (SELECT sum(n) FROM c2), 6) AS w FROM q GROUP BY k1, k2")
def est_pair_em(spark, d):
    return em.pair_step(_pairs(spark, d), _zz(spark), _emissions(spark)).withColumn("w", r6("w"))


PAIR_FIT = f""", em(step, k1, k2, w) AS (SELECT 0, k1, k2, w FROM zz UNION ALL SELECT step + 1, k1, k2, sum(r) / (SELECT sum(n) FROM c2) FROM (
SELECT step, k1, k2, n * v / sum(v) OVER (PARTITION BY x1, x2) AS r FROM (SELECT em.step, em.k1, em.k2, x1, x2, n, em.w * a.p * b.p AS v FROM em JOIN o a ON a.k = em.k1 JOIN o b ON b.k = em.k2 JOIN c2 ON c2.x1 = a.x AND c2.x2 = b.x WHERE em.step < {SETTLED}))
GROUP BY step, k1, k2) SELECT k1, k2, round(w, 5) AS w FROM em WHERE step = {SETTLED}"""


@query("est_pair_em_fit", f"WITH RECURSIVE {C_SQL}{PAIR_FIT}")
def est_pair_em_fit(spark, d):
    w = em.mixing_fit(_pairs(spark, d), ZZ, _emissions(spark), ["x1", "x2"], SETTLED)
    return spark.createDataFrame([(*k, round(v, 5)) for k, v in w.items()], "k1 int, k2 int, w double")


def _grid_pairs(spark, d):
    from momenta.queries.words import join_grid_neighbours

    return join_grid_neighbours(spark, d).select(F.col("upper").alias("x1"), F.col("lower").alias("x2"), "n")


def _grid_sql(rest):
    from momenta.queries.words import GRID

    pairs = f"{EV}, {GRID}, c2 AS (SELECT a.tok AS x1, b.tok AS x2, count(*) AS n FROM grid a JOIN rows_ USING (seq_id) JOIN grid b ON a.seq_id = b.seq_id AND b.r = (a.r + 1) % rows AND a.c = b.c AND a.d = b.d GROUP BY ALL), {O_SQL}"
    return f"WITH {pairs}{J2_SQL[len(C_SQL) :]} {rest}"


@query("est_grid_edge_em", _grid_sql("SELECT k1, k2, round(sum(n * v / q) / (SELECT sum(n) FROM c2), 6) AS w FROM q GROUP BY k1, k2"))
def est_grid_edge_em(spark, d):
    return em.pair_step(_grid_pairs(spark, d), _zz(spark), _emissions(spark)).withColumn("w", r6("w"))


@query("est_grid_edge_em_fit", _grid_sql("").replace("WITH ", "WITH RECURSIVE ", 1).split(", j AS (")[0] + PAIR_FIT)
def est_grid_edge_em_fit(spark, d):
    w = em.mixing_fit(_grid_pairs(spark, d), ZZ, _emissions(spark), ["x1", "x2"], SETTLED)
    return spark.createDataFrame([(*k, round(v, 5)) for k, v in w.items()], "k1 int, k2 int, w double")


HESSIAN = "SELECT a.k1 AS a1, a.k2 AS a2, b.k1 AS b1, b.k2 AS b2, round(sum(a.n * a.g * b.g / (a.q * a.q)), 3) AS v FROM q a JOIN q b ON a.x1 = b.x1 AND a.x2 = b.x2 GROUP BY ALL"


@query("agg_pair_hessian", f"WITH {J2_SQL} {HESSIAN}")
def agg_pair_hessian(spark, d):
    return em.pair_information(_pairs(spark, d), _zz(spark), _emissions(spark)).withColumn("v", F.round("v", 3))


@query("agg_grid_hessian", _grid_sql(HESSIAN))
def agg_grid_hessian(spark, d):
    return em.pair_information(_grid_pairs(spark, d), _zz(spark), _emissions(spark)).withColumn("v", F.round("v", 3))


EMISSIONS = [[0.4, 0.3, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]]
#: The pseudo-inverse of two independent rows o: (o o')^-1 o.
_G = [[sum(a * b for a, b in zip(p, q, strict=True)) for q in EMISSIONS] for p in EMISSIONS]
_DET = _G[0][0] * _G[1][1] - _G[0][1] * _G[1][0]
PINV = [[(_G[1 - k][1 - k] * EMISSIONS[k][x] - _G[0][1] * EMISSIONS[1 - k][x]) / _DET for x in range(5)] for k in range(2)]
PINV_SQL = ", ".join(f"({k}, {x}, {v!r}::DOUBLE)" for k, row in enumerate(PINV) for x, v in enumerate(row))


@query(
    "est_pinv_marginals",
    f"""WITH {C_SQL}, i AS (SELECT * FROM (VALUES {PINV_SQL}) v(k, x, q))
    SELECT 'Z1' AS what, k AS i, 0 AS j, round(sum(n * q) / (SELECT sum(n) FROM c1), 6) AS v FROM c1 JOIN i USING (x) GROUP BY k
    UNION ALL SELECT 'Z12', a.k, b.k, round(sum(n * a.q * b.q) / (SELECT sum(n) FROM c2), 6) FROM c2 JOIN i a ON a.x = x1 JOIN i b ON b.x = x2 GROUP BY a.k, b.k""",
)
def est_pinv_marginals(spark, d):
    """States' shares (Z1) and state pairs' shares (Z12) through the pseudo-inverse of the emissions: products with a thin factor, so nothing of the symbols' size is collected."""
    o = np.zeros((5, 2))
    for r in _emissions(spark).collect():
        o[r.x, r.k] = r.p
    inverse = _matrix(spark, np.linalg.pinv(o).T)
    one = N.share(_singles(spark, d), "n", name="v").select(F.col("x").alias("i"), F.lit(0).alias("j"), "v")
    two = N.share(_pairs(spark, d), "n", name="v").select(F.col("x1").alias("i"), F.col("x2").alias("j"), "v")
    z1, z12 = C.multilinear(one, {"i": inverse}), C.multilinear(two, {"i": inverse, "j": inverse})
    return z1.select(F.lit("Z1").alias("what"), "i", "j", r6("v").alias("v")).unionAll(z12.select(F.lit("Z12").alias("what"), "i", "j", r6("v").alias("v")))


def _categorical_sql(steps):
    """The steps by recursion on a table of (state, symbol), from the start that em.fit_categorical draws; the log-likelihood is that before the last step."""
    start = np.random.default_rng(0).dirichlet(np.ones(D), K)
    first = ", ".join(f"({k}, {s}, {start[k, s]!r}::DOUBLE)" for k in range(K) for s in range(D)).replace("np.float64(", "").replace(")::", "::")
    joint = "SELECT b.id, b.x, b.n, a.step, a.k, a.w * a.o * c.o * e.o AS v FROM bags b JOIN {em} a ON a.s = b.x[1] JOIN {em} c ON c.step = a.step AND c.k = a.k AND c.s = b.x[2] JOIN {em} e ON e.step = a.step AND e.k = a.k AND e.s = b.x[3]"
    return f"""WITH RECURSIVE {EV}, tri AS (SELECT tok AS a, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
    bags AS MATERIALIZED (SELECT row_number() OVER () AS id, [a, b, c] AS x, n FROM (SELECT a, b, c, count(*) AS n FROM tri WHERE c IS NOT NULL GROUP BY ALL)),
    em AS (SELECT 0 AS step, k, s, {1 / K!r}::DOUBLE AS w, o FROM (VALUES {first}) v(k, s, o)
    UNION ALL SELECT step + 1, k, s, sum(sum(r)) OVER (PARTITION BY k) / sum(sum(r)) OVER (), sum(r) / sum(sum(r)) OVER (PARTITION BY k) FROM (
        SELECT step, k, unnest(x) AS s, n * v / sum(v) OVER (PARTITION BY id) AS r FROM ({joint.format(em='em')}) WHERE step < {steps}) GROUP BY step, k, s),
    last AS (SELECT * FROM em WHERE step = {steps - 1}),
    ll AS (SELECT sum(n * ln(q)) AS loglik FROM (SELECT id, any_value(n) AS n, sum(v) AS q FROM ({joint.format(em='last')}) GROUP BY id))
    SELECT k::INTEGER AS i, s::INTEGER AS j, round(o, 6) AS v, round(w, 6) AS w, round(loglik, 4) AS loglik FROM em, ll WHERE step = {steps}"""


@query("est_em_categorical_mixture", _categorical_sql(5))
def est_em_categorical_mixture(spark, d):
    bags = N.windows(chains(spark, d), 3).select(F.array("w0", "w1", "w2").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    w, o, history = em.fit_categorical(bags, K, D, 5)
    rows = _matrix(spark, o).join(_matrix(spark, w[:, None], "w").select("i", "w"), "i").withColumn("loglik", F.lit(round(history[-1], 4)))
    return rows.select("i", "j", r6("v").alias("v"), r6("w").alias("w"), "loglik")


# ---- moments


LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçóíáñ"


def letter_views(spark, d):
    """Three views of every text, of its words by place: how large a share of their characters each letter has; w is the number of words. What the views have in common is the language.

    A text of fewer than three words has no three views.
    """
    words = T.tokenize(F.lower("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("ws")).where(F.size("ws") >= 3)
    third = lambda v: F.array_join(F.filter("ws", lambda w, i: i % 3 == v), "")
    docs = docs.select("id", F.size("ws").cast("double").alias("w"), *(third(v).alias(f"t{v + 1}") for v in range(3)))
    share = lambda t: F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) / F.length(t) for c in LETTERS))
    return docs.select("id", "w", *(share(F.col(f"t{v}")).alias(f"x{v}") for v in (1, 2, 3)))


@query("est_randomized_svd")
def est_randomized_svd(spark, d):
    """The leading singular values of the co-occurrence of neighbouring words."""
    m = N.share(trigram_counts(spark, d).groupBy(F.col("w0").alias("i"), F.col("w1").alias("j")).agg(F.sum("n").alias("n")), "n", name="v").select("i", "j", "v")
    _, s, _ = moment_methods.randomized_svd(saved(m, "pairs"), 4)
    return _matrix(spark, s)


@query("est_three_view")
def est_three_view(spark, d):
    _, means = moment_methods.three_view(trigram_counts(spark, d), 2)
    return means


@query("est_three_view_exact")
def est_three_view_exact(spark, d):
    w, o = moment_methods.three_view_exact(N.views(trigram_counts(spark, d)), WORDS, 2)
    return _matrix(spark, o).join(_matrix(spark, w).select("j", F.col("v").alias("w")), "j")


@query("est_simultaneous_diag")
def est_simultaneous_diag(spark, d):
    return _matrix(spark, moment_methods.simultaneous_diag(saved(letter_views(spark, d), "views"), (len(LETTERS),) * 3, 3))


@query("est_lda_moments")
def est_lda_moments(spark, d):
    w, topics = moment_methods.lda(packed(spark, d), WORDS, 3)
    return _matrix(spark, topics).join(_matrix(spark, w).select("j", F.col("v").alias("w")), "j")


@query("est_spherical_gmm")
def est_spherical_gmm(spark, d):
    w, means, sigma2 = moment_methods.spherical_gmm(vectors(spark, d), 64, 3)
    return _matrix(spark, means).join(_matrix(spark, w).select("j", F.col("v").alias("w")), "j").withColumn("sigma2", F.lit(sigma2))


@query("est_hmm_from_views")
def est_hmm_from_views(spark, d):
    """A chain of two states behind the words of the corpus."""
    seq = packed(spark, d)
    return _matrix(spark, moment_methods.hmm_from_views(N.views(trigram_counts(spark, d)), moment_methods.first_tokens(seq.select("seq_id", F.posexplode("x").alias("pos", "tok")), WORDS), WORDS, 2).t)


@query("est_gmm_from_views")
def est_gmm_from_views(spark, d):
    return moment_methods.gmm_from_views(saved(letter_views(spark, d), "views"), (len(LETTERS),) * 3, 3)[2]


@query("est_regression_mixture")
def est_regression_mixture(spark, d):
    """The mixture's coefficients and weights from its moments, taken on by EM: (stage, k, i, v, w, loglik)."""
    rows = regression_rows(spark, d)
    w0, b0 = moment_methods.regression_mixture(rows, 3, 2)
    b, w, _, history = em.fit_regressions(rows, 2, steps=30, betas=b0.tolist(), gain=1e-6)
    out = [(stage, k, i, float(v), float(weights[k]), ll) for stage, betas, weights, ll in (("moments", b0, w0, history[0]), ("em", b, w, history[-1])) for k, row in enumerate(betas) for i, v in enumerate(row)]
    return spark.createDataFrame(out, "stage string, k int, i int, v double, w double, loglik double")


def regression_rows(spark, d):
    """A mixture of two regressions on standardised quantity, discount and tax: a line's hidden component is its status, its noise a hash: (y, x, status)."""
    rows = table(spark, d, "lineitem")
    x = F.array((F.col("l_quantity") - 25.5) / 14.4, (F.col("l_discount") - 0.05) / 0.0316, (F.col("l_tax") - 0.04) / 0.0258)
    u = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.select("l_linestatus", x.alias("x"), (0.6 * (u - 0.5)).alias("noise"))
    y = F.when(F.col("l_linestatus") == "F", X.linear(BETAS[0])(F.col("x"))).otherwise(X.linear(BETAS[1])(F.col("x")))
    return rows.select((y + F.col("noise")).alias("y"), "x", "l_linestatus")


@query("est_ridge", _solved(0.1))
def est_ridge(spark, d):
    return _matrix(spark, estimators.ridge(samples(spark, d), 3, 0.1)).withColumn("v", r6("v"))


@query("est_prox_low_rank2")
def est_prox_low_rank2(spark, d):
    b, losses = estimators.prox_low_rank(samples(spark, d), 3, 2)
    return _matrix(spark, b).withColumn("loss", F.lit(losses[-1]))


@query("est_prox_low_rank3")
def est_prox_low_rank3(spark, d):
    b, losses = estimators.prox_low_rank(samples(spark, d), 3, 3, schedule="1/sqrt(t)")
    return _matrix(spark, b.reshape(3, 9)).withColumn("loss", F.lit(losses[-1]))


@query("agg_cov_projection")
def agg_cov_projection(spark, d):
    points = vectors(spark, d).select("id", "x", F.col("label").cast("double").alias("y"))
    return estimators.direction(points, 64)


@query("agg_smooth_white", f"SELECT 'y' AS what, j AS i, 0 AS j, v FROM ({_solved(0.0)}) UNION ALL SELECT 'X', i, j, (i = j)::INTEGER::DOUBLE FROM (SELECT unnest(range(3))::INTEGER AS i), (SELECT unnest(range(3))::INTEGER AS j)")
def agg_smooth_white(spark, d):
    """The sample smoothed by pinv(X): pinv(X) y and pinv(X) X, both through the Gram matrix, so no matrix of the rows' number is made."""
    y, x = estimators.white(samples(spark, d), 3)
    parts = [_matrix(spark, m).select(F.lit(what).alias("what"), "i", "j", (r6("v") + 0.0).alias("v")) for what, m in (("y", y[:, None]), ("X", x))]
    return parts[0].unionAll(parts[1])


#: Words that begin as clusters, and clusters in the end.
BROWN_WORDS, BROWN_K = 300, 20


@query("est_brown_clusters")
def est_brown_clusters(spark, d):
    """The most frequent words' clusters; all other words begin as one cluster (word null)."""
    tokens = tokens_of(spark, d)
    words = [r.word for r in N.top_words(N.word_counts(tokens), BROWN_WORDS).orderBy("tok").collect()]
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), T.tokenize(F.col("text")).alias("ws"))
    bi = N.counts(N.packed_windows(N.encode_packed(docs, words), 2), "w0", "w1").select(F.col("w0").alias("c1"), F.col("w1").alias("c2"), "n")
    clusters = estimators.top_word_clusters(bi, list(range(len(words))), BROWN_K)
    return spark.createDataFrame([(None if w is None else words[w], c) for w, c in clusters.items()], "word string, c int")


BROWN = """WITH {enc}, bi AS (SELECT tok AS c1, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos) AS c2 FROM enc),
c AS (SELECT c1, c2, count(*)::DOUBLE / (SELECT count(*) FROM bi WHERE c2 IS NOT NULL) AS p FROM bi WHERE c2 IS NOT NULL GROUP BY c1, c2)
SELECT c1, c2, round(p * ln(p / (l * r)), 9) AS q FROM (SELECT *, sum(p) OVER (PARTITION BY c1) AS l, sum(p) OVER (PARTITION BY c2) AS r FROM c)"""


def _brown_sql():
    from momenta.queries.sql import ENC

    return BROWN.format(enc=ENC)


@query("est_brown_costs", _brown_sql())
def est_brown_costs(spark, d):
    """The table that the merging starts from."""
    bi = N.counts(N.packed_windows(packed(spark, d), 2), "w0", "w1").select(F.col("w0").alias("c1"), F.col("w1").alias("c2"), "n")
    return estimators.mutual_information_costs(bi).withColumn("q", F.round("q", 9))


def _losses_sql():
    from momenta.queries.sql import ENC

    return f"""WITH {ENC}, bi AS (SELECT tok AS c1, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos) AS c2 FROM enc),
c AS MATERIALIZED (SELECT c1, c2, count(*)::DOUBLE / (SELECT count(*) FROM bi WHERE c2 IS NOT NULL) AS p FROM bi WHERE c2 IS NOT NULL GROUP BY c1, c2),
ids AS (SELECT DISTINCT tok AS c FROM enc), pairs AS (SELECT x.c AS a, y.c AS b FROM ids x, ids y WHERE x.c < y.c UNION ALL SELECT -1, -2),
m AS (SELECT a, b, CASE WHEN c1 = b THEN a ELSE c1 END AS x, CASE WHEN c2 = b THEN a ELSE c2 END AS y, sum(p) AS p FROM c, pairs GROUP BY ALL),
info AS (SELECT a, b, sum(p * ln(p / (l * r))) AS v FROM (SELECT *, sum(p) OVER (PARTITION BY a, b, x) AS l, sum(p) OVER (PARTITION BY a, b, y) AS r FROM m) GROUP BY a, b)
SELECT a::INTEGER AS a, b::INTEGER AS b, round((SELECT v FROM info WHERE a = -1) - v, 8) AS loss FROM info WHERE a >= 0"""


@query("est_brown_losses", _losses_sql())
def est_brown_losses(spark, d):
    """What each first merge would lose."""
    bi = N.counts(N.packed_windows(packed(spark, d), 2), "w0", "w1").select(F.col("w0").alias("c1"), F.col("w1").alias("c2"), "n")
    codes = sorted(r[0] for r in bi.select("c1").union(bi.select("c2")).distinct().collect())
    p = estimators.bigram_table(bi, codes)[:-1, :-1]
    sums = lambda m: np.stack([estimators._sums_with(m, a) for a in range(len(m))])
    loss = estimators.merge_losses(p, sums(p), sums(p.T))
    return spark.createDataFrame([(codes[a], codes[b], round(float(v), 8)) for (a, b), v in np.ndenumerate(loss) if np.isfinite(v)], "a int, b int, loss double")


@query("est_word_clusters")
def est_word_clusters(spark, d):
    tri = saved(trigram_counts(spark, d), "trigrams")
    return moment_methods.word_clusters(tri, tri.select(F.col("w0").alias("tok")).union(tri.select("w1")).union(tri.select("w2")).distinct(), 2)


def _kmeans_sql(k):
    """Each centre is the point of the greatest log(u) / d^2 by the distance to the nearest centre before it."""
    dist = "list_sum(list_transform(list_zip(a.x, b.x), lambda o: (o[1] - o[2]) ** 2))"
    parts = ["e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)", "c0 AS (SELECT 0 AS k, x FROM e ORDER BY md5('0:' || id), id LIMIT 1)"]
    for n in range(1, k):
        before = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(n))
        parts += [
            f"d{n} AS MATERIALIZED (SELECT a.id, any_value(a.x) AS x, min({dist}) AS d FROM e a, ({before}) b GROUP BY a.id)",
            f"c{n} AS MATERIALIZED (SELECT {n} AS k, x FROM d{n} WHERE d > 0 ORDER BY ln((('0x' || substr(md5('{n}:' || id), 1, 7))::BIGINT + 0.5) / {1 << 28}) / d DESC, id LIMIT 1)",
        ]
    return f"WITH {', '.join(parts)} SELECT k, (generate_subscripts(x, 1) - 1)::INTEGER AS j, unnest(x) AS v FROM ({' UNION ALL '.join(f'SELECT * FROM c{i}' for i in range(k))})"


@query("est_kmeans_pp_init", _kmeans_sql(5))
def est_kmeans_pp_init(spark, d):
    points = vectors(spark, d).select("id", "x")
    return em.kmeans_pp(points, 5).select("k", F.posexplode("m").alias("j", "v"))


ODDS = "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), c AS (SELECT x AS m FROM e ORDER BY md5('0:' || id), id LIMIT 1), d AS (SELECT id, list_sum(list_transform(list_zip(x, m), lambda o: (o[1] - o[2]) ** 2)) AS d2 FROM e, c) SELECT id, round(d2, 6) AS d2, round(least(1.0, 20 * d2 / sum(d2) OVER ()), 8) AS p FROM d"


@query("est_kmeans_parallel_round", ODDS)
def est_kmeans_parallel_round(spark, d):
    """The odds of the first round of est_kmeans_parallel with ten centres."""
    points = vectors(spark, d).select("id", "x")
    state = em.least_distances(points.withColumn("d2", F.lit(float("inf"))), [em._first_point(points, 0)])
    return em.round_odds(state, 20.0).select("id", r6("d2").alias("d2"), F.round("p", 8).alias("p"))


@query("est_kmeans_parallel")
def est_kmeans_parallel(spark, d):
    """Ten centres to start a mixture from, with uniform weights and a variance: (k, j, v, w, sigma2)."""
    centres, sigma2 = em.kmeans_parallel(vectors(spark, d).select("id", "x"), 10)
    return centres.select("k", F.posexplode("m").alias("j", "v"), "w").withColumn("sigma2", F.lit(sigma2))


@query("est_loglinear_em")
def est_loglinear_em(spark, d):
    bags = N.windows(chains(spark, d), 3).select(F.array("w0", "w1", "w2").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    start = np.random.default_rng(0).normal(0, 0.1, 2 + 2 * D)
    theta, history = estimators.loglinear_em(estimators.bag_features(bags, 2, D), start, 4)
    return _matrix(spark, theta).withColumn("score", F.lit(history[-1]))


@query("est_measurements")
def est_measurements(spark, d):
    """Expected counts of (state, symbol) in a sequence: its mean length times state share times emission, from the views."""
    w, o = moment_methods.three_view_exact(N.views(trigram_counts(spark, d)), WORDS, 2)
    length = packed(spark, d).agg(F.avg(F.size("x"))).first()[0]
    return _matrix(spark, length * w[:, None] * o.T)


@query("join_align_labels")
def join_align_labels(spark, d):
    """Centres by label of one half of the vectors matched to those of the other: distances by join, the matching on the driver."""
    x = vectors(spark, d).select("id", "label", "x")
    half = lambda r: x.where(F.col("id") % 2 == r).groupBy("label").agg(F.array(*(F.avg(F.col("x")[i]) for i in range(64))).alias("m"))
    a, b = half(0), half(1).select(F.col("label").alias("other"), F.col("m").alias("u"))
    cost = saved(a.crossJoin(F.broadcast(b)).select("label", "other", V.norm(V.minus(F.col("m"), F.col("u"))).alias("cost")), "costs")
    rows = cost.collect()
    left, right = sorted({r.label for r in rows}), sorted({r.other for r in rows})
    c = {(r.label, r.other): r.cost for r in rows}
    pairs = best_matching([[c[i, j] for j in right] for i in left])
    matched = spark.createDataFrame([(left[i], right[j]) for i, j in pairs], "label int, other int")
    return cost.join(F.broadcast(matched), ["label", "other"])


# ---- streams


def _stream(spark, d):
    """The events as a stream; the path's pattern holds for one file as for a folder of files."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_moment_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 9) AS mean, round(avg(value * value), 9) AS square FROM events GROUP BY ALL")
def str_moment_window(spark, d):
    sums = stream.moment_windows(_stream(spark, d))
    return stream.run_to_table(sums, "complete").withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": F.round("mean", 9), "square": F.round("square", 9)})


@query("str_transition_counts", "WITH w AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS cur FROM events) SELECT prev, cur, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY ALL")
def str_transition_counts(spark, d):
    return stream.run_to_table(stream.transitions(_stream(spark, d)), "append").groupBy("prev", "cur").agg(F.sum("n").alias("n"))


@query(
    "str_transition_counts_idle",
    "WITH w AS (SELECT ts, lag(ts) OVER w AS before, lag(event_type) OVER w AS prev, event_type AS cur FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT prev, cur, count(*) AS n FROM w WHERE prev IS NOT NULL AND epoch_ms(ts) - epoch_ms(before) <= 43200000 GROUP BY ALL",
)
def str_transition_counts_idle(spark, d):
    """Pairs of events of a user no more than twelve hours apart; a user's state leaves the store when it can make none any more."""
    pairs = stream.run_to_table(stream.expiring_transitions(_stream(spark, d), "12 hours"), "append", stream.ROCKSDB)
    return pairs.groupBy("prev", "cur").agg(F.sum("n").alias("n"))
