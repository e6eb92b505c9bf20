"""Queries on numeric samples: vectors, embeddings, co-moments, regressions, labels and one EM step."""

from __future__ import annotations

from pyspark.sql import functions as F

from momenta.functions import vectors as V
from momenta.operators import labels as L
from momenta.operators import mixtures as X
from momenta.operators import moments as M
from momenta.operators import ngrams as N
from momenta.plans import em, estimators
from momenta.queries.registry import query
from momenta.queries.sql import EV, chains, r6, table

# ---- vectors: three views of 21, 21 and 22 coordinates, and a weight; and all their triples of neighbouring coordinates

SIZES = (21, 21, 22)
D = sum(SIZES)
#: Triples of a vector, filled with zeros at its end.
TRIPLES = 22
EMB = f"""e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
p AS (SELECT id, label, x, x[1:21] AS x1, x[22:42] AS x2, x[43:64] AS x3, 1.0 / (1 + label) AS q FROM e)"""
LONG = EMB + ", l AS (SELECT id, q, generate_subscripts(x3, 1) - 1 AS c, unnest(x1) AS a, unnest(x2) AS b, unnest(x3) AS z FROM p)"
THREE = f"""{EMB}, full_ AS (SELECT id, list_concat(x, [0.0, 0.0]) AS x, unnest(range({TRIPLES})) AS g FROM e),
t AS (SELECT id, g, x[3 * g + 1 : 3 * g + 3] AS x1, x[3 * ((g + 1) % {TRIPLES}) + 1 : 3 * ((g + 1) % {TRIPLES}) + 3] AS x2, x[3 * ((g + 2) % {TRIPLES}) + 1 : 3 * ((g + 2) % {TRIPLES}) + 3] AS x3 FROM full_)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def views(spark, d):
    x = F.col("x")
    return vectors(spark, d).select("id", "label", "x", F.slice(x, 1, 21).alias("x1"), F.slice(x, 22, 21).alias("x2"), F.slice(x, 43, 22).alias("x3"), (1.0 / (1 + F.col("label"))).alias("q"))


def triples(spark, d):
    """(id, g, x1, x2, x3): every triple g of neighbouring coordinates and the two after it, around the vector."""
    x = F.concat("x", F.array(F.lit(0.0), F.lit(0.0)))
    rows = vectors(spark, d).select("id", x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(TRIPLES - 1))).alias("g"))
    return rows.select("id", F.col("g").cast("long").alias("g"), *(F.slice("x", 3 * ((F.col("g") + k) % TRIPLES) + 1, F.lit(3)).alias(f"x{k + 1}") for k in range(3)))


REDUCE = {
    "total": ("list_sum(x)", lambda x: V.vsum(x)),
    "norm": ("sqrt(list_sum(list_transform(x, lambda v: v * v)))", lambda x: V.norm(x)),
    "least": ("list_min(x)", lambda x: F.array_min(x)),
    "most": ("list_max(x)", lambda x: F.array_max(x)),
    "least_abs": ("list_min(list_transform(x, lambda v: abs(v)))", lambda x: V.min_abs(x)),
    "most_abs": ("list_max(list_transform(x, lambda v: abs(v)))", lambda x: V.max_abs(x)),
}


@query(
    "fn_vec_reduce",
    f"WITH {EMB} SELECT id, {', '.join(f'round({s}, 6) AS {n}' for n, (s, _) in REDUCE.items())}, (list_position(x, list_min(x)) - 1)::BIGINT AS at_least, (list_position(x, list_max(x)) - 1)::BIGINT AS at_most FROM e",
)
def fn_vec_reduce(spark, d):
    x = F.col("x")
    return vectors(spark, d).select("id", *(r6(f(x)).alias(n) for n, (_, f) in REDUCE.items()), V.argmin(x).alias("at_least"), V.argmax(x).alias("at_most"))


def _flat(c):
    """An array of doubles as text of rounded numbers, which both sides write alike."""
    return F.array_join(F.transform(c, lambda v: F.round(v * 1e6).cast("long").cast("string")), " ")


def flat(c):
    return f"array_to_string(list_transform({c}, lambda v: round(v * 1e6)::BIGINT::VARCHAR), ' ')"


@query("fn_vec_map", f"WITH {THREE} SELECT id, g, {flat('list_transform(list_zip(x1, x2), lambda p: abs(p[1] + p[2]))')} AS a, {flat('list_transform(list_zip(x1, x2), lambda p: exp(p[1] - p[2]))')} AS b, {flat('list_transform(x1, lambda v: 2.5 * v)')} AS c FROM t")
def fn_vec_map(spark, d):
    a, b = F.col("x1"), F.col("x2")
    return triples(spark, d).select("id", "g", _flat(V.vmap(V.plus(a, b), F.abs)).alias("a"), _flat(V.vmap(V.minus(a, b), F.exp)).alias("b"), _flat(V.scale(a, 2.5)).alias("c"))


@query("fn_logsumexp", f"WITH {EMB} SELECT id, round(ln(list_sum(list_transform(x, lambda v: exp(v)))), 6) AS v FROM e")
def fn_logsumexp(spark, d):
    return vectors(spark, d).select("id", r6(V.logsumexp(F.col("x"))).alias("v"))


@query("fn_safe_log", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(ln(l_discount), 6) ELSE 0 END AS v FROM lineitem")
def fn_safe_log(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(V.safe_log(F.col("l_discount"))).alias("v"))


@query("flt_range_removal", f"WITH {EMB} SELECT id FROM e WHERE len(list_filter(x, lambda v: v > 0.2 AND v < 0.25)) = 0")
def flt_range_removal(spark, d):
    return vectors(spark, d).where(V.outside(F.col("x"), 0.2, 0.25)).select("id")


@query("prj_bias", f"WITH {THREE} SELECT id, g, {flat('list_concat([1.0], x1)')} AS x FROM t")
def prj_bias(spark, d):
    return triples(spark, d).select("id", "g", _flat(V.bias(F.col("x1"))).alias("x"))


def _products(*cells):
    return "[" + ", ".join(f"{m} * " + " * ".join(f"x1[{i + 1}]" for i in c) for m, c in cells) + "]"


E2 = [(1.0 if i == j else 2.0, (i, j)) for i in range(3) for j in range(i, 3)]
E3 = [({1: 1.0, 2: 3.0, 3: 6.0}[len({i, j, k})], (i, j, k)) for i in range(3) for j in range(i, 3) for k in range(j, 3)]


@query("prj_sym_expand2", f"WITH {THREE} SELECT id, g, {flat(_products(*E2))} AS x FROM t")
def prj_sym_expand2(spark, d):
    return triples(spark, d).select("id", "g", _flat(V.sym_expand2(F.col("x1"), 3)).alias("x"))


@query("prj_sym_expand3", f"WITH {THREE} SELECT id, g, {flat(_products(*E3))} AS x FROM t")
def prj_sym_expand3(spark, d):
    return triples(spark, d).select("id", "g", _flat(V.sym_expand3(F.col("x1"), 3)).alias("x"))


def _powers(table_, sign=False):
    one = lambda i, p: f"(sign(x1[{i + 1}]) * abs(x1[{i + 1}]) ** {float(p)})" if sign else f"(x1[{i + 1}] ** {float(p)})"
    return "[" + ", ".join(" * ".join(one(i, p) for i, p in enumerate(e)) for e in table_) + "]"


@query("prj_poly_embed", f"WITH {THREE} SELECT id, g, {flat(_powers(V.exponents(3, 2)))} AS x FROM t")
def prj_poly_embed(spark, d):
    return triples(spark, d).select("id", "g", _flat(V.poly_embed(F.col("x1"), 3, 2)).alias("x"))


EXPONENTS = [(1, 0, 0), (0, 2, 0), (1, 1, 3)]
FRACTIONS = [(0.5, 0, 0), (1.5, 1, 0), (0, 0, 2.5)]


@query("prj_exponent_embed", f"WITH {THREE} SELECT id, g, {flat(_powers(EXPONENTS))} AS x FROM t")
def prj_exponent_embed(spark, d):
    return triples(spark, d).select("id", "g", _flat(V.power_embed(F.col("x1"), EXPONENTS)).alias("x"))


@query("prj_fractional_embed", f"WITH {THREE} SELECT id, g, {flat(_powers(FRACTIONS, sign=True))} AS x FROM t")
def prj_fractional_embed(spark, d):
    return triples(spark, d).select("id", "g", _flat(V.fractional_embed(F.col("x1"), FRACTIONS)).alias("x"))


@query("prj_fourier_embed", f"WITH {THREE} SELECT id, g, {flat('[' + ', '.join(f'cos({a} * x1[1] + {b} * x1[2] + {c} * x1[3])' for a in range(2) for b in range(2) for c in range(2)) + ']')} AS x FROM t")
def prj_fourier_embed(spark, d):
    return triples(spark, d).select("id", "g", _flat(V.fourier_embed(F.col("x1"), 3, 2)).alias("x"))


@query("fn_quadratic_form", f"WITH {THREE}, l AS (SELECT id, g, generate_subscripts(x1, 1) - 1 AS c, unnest(x1) AS a, unnest(x2) AS b, unnest(x3) AS z FROM t), f AS (SELECT i, j, (i + 1.0) / (j + 1.0) AS m FROM (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)) SELECT u.id, u.g, round(sum(m * u.a * w.b), 6) AS v FROM l u JOIN l w USING (id, g) JOIN f ON f.i = u.c AND f.j = w.c GROUP BY u.id, u.g")
def fn_quadratic_form(spark, d):
    return triples(spark, d).select("id", "g", r6(X.bilinear(F.col("x1"), F.col("x2"), [[(i + 1) / (j + 1) for j in range(3)] for i in range(3)])).alias("v"))


@query("fn_trilinear_form", f"WITH {THREE}, l AS (SELECT id, g, generate_subscripts(x1, 1) - 1 AS c, unnest(x1) AS a, unnest(x2) AS b, unnest(x3) AS z FROM t) SELECT u.id, u.g, round(sum((u.c + 1) * (w.c + 1) / (y.c + 1.0) * u.a * w.b * y.z), 6) AS v FROM l u JOIN l w USING (id, g) JOIN l y USING (id, g) GROUP BY u.id, u.g")
def fn_trilinear_form(spark, d):
    t = [[[(i + 1) * (j + 1) / (k + 1) for k in range(3)] for j in range(3)] for i in range(3)]
    return triples(spark, d).select("id", "g", r6(X.trilinear(F.col("x1"), F.col("x2"), F.col("x3"), t)).alias("v"))


# ---- moments


#: Views and pairs of views: name -> (column of LONG, view, size) of each part.
ONE = {"1": (("a", "x1", 21),), "2": (("b", "x2", 21),), "3": (("z", "x3", 22),)}
TWO = {f"{v}{w}": ONE[v] + ONE[w] for v, w in ("12", "13", "23")}
AT = "SELECT '{view}' AS view, u.c::INTEGER AS i"


def _moment(name, parts, sql, f):
    """One query over all views (or pairs of views): sql(view, *parts) and f(rows, *parts) give one view's rows."""

    @query(name, f"WITH {LONG} " + " UNION ALL ".join(sql(view, *of) for view, of in parts.items()))
    def run(spark, d):
        df = views(spark, d)
        found = [f(df, *of).select(F.lit(view).alias("view"), *KEYS[name], r6("v").alias("v")) for view, of in parts.items()]
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out


KEYS = {n: ("i",) if n == "agg_first_moment" else ("i", "j", "k") if n == "agg_triples_weighted" else ("i", "j") for n in ("agg_first_moment", "agg_pairs", "agg_pairs_weighted", "agg_triples_weighted", "agg_triples_proj_weighted", "agg_covariance", "agg_pairs_sq")}
THETA = [0.5 * (i % 5) - 1.0 for i in range(22)]
ALONG = "list_sum(list_transform(list_zip({t}, {theta}), lambda o: o[1] * o[2]))"


def _two(view, value, a, b, rest=""):
    """A value of coordinates i of one part and j of another, by pairs of rows of a vector."""
    return f"{AT.format(view=view)}, w.c::INTEGER AS j, round({value}, 6) AS v FROM l u JOIN l w USING (id){rest} WHERE u.{a} IS NOT NULL AND w.{b} IS NOT NULL GROUP BY u.c, w.c"


_moment("agg_first_moment", ONE, lambda v, p: f"{AT.format(view=v)}, round(avg(u.{p[0]}), 6) AS v FROM l u WHERE u.{p[0]} IS NOT NULL GROUP BY u.c", lambda df, p: M.first_moment(df, p[1]))
_moment("agg_pairs", TWO, lambda v, p, q: _two(v, f"avg(u.{p[0]} * w.{q[0]})", p[0], q[0]), lambda df, p, q: M.pairs(df, p[1], q[1]))
_moment("agg_covariance", TWO, lambda v, p, q: _two(v, f"covar_pop(u.{p[0]}, w.{q[0]})", p[0], q[0]), lambda df, p, q: M.covariance(df, p[1], q[1]))
_moment("agg_pairs_weighted", ONE, lambda v, p: _two(v, f"sum(u.q * u.{p[0]} * w.{p[0]})", p[0], p[0]), lambda df, p: M.pairs_weighted(df, p[1]))
_moment(
    "agg_triples_weighted",
    ONE,
    lambda v, p: f"{AT.format(view=v)}, w.c::INTEGER AS j, y.c::INTEGER AS k, round(sum(u.q * u.{p[0]} * w.{p[0]} * y.{p[0]}), 6) AS v FROM l u JOIN l w USING (id) JOIN l y USING (id) WHERE u.{p[0]} IS NOT NULL AND w.{p[0]} IS NOT NULL AND y.{p[0]} IS NOT NULL GROUP BY u.c, w.c, y.c",
    lambda df, p: M.triples_weighted(df, p[1]),
)
_moment(
    "agg_triples_proj_weighted",
    ONE,
    lambda v, p: _two(v, f"avg(u.q * u.{p[0]} * w.{p[0]} * {ALONG.format(t=f'p.{p[1]}', theta=THETA[: p[2]])})", p[0], p[0], " JOIN p USING (id)"),
    lambda df, p: M.triples_projected_weighted(df, THETA[: p[2]], p[1]),
)


def _squares_sql(view, p, q):
    # products come in either order, so those of one order are summed and stand for both
    (a, _, n), (b, _, m) = p, q
    one = lambda c, n: f"SELECT u.id, u.c * {n} + w.c AS c, u.{c} * w.{c} AS s FROM l u JOIN l w USING (id) WHERE u.c <= w.c AND u.{c} IS NOT NULL AND w.{c} IS NOT NULL"
    both = lambda n: f"SELECT least(i, j) * {n} + greatest(i, j) AS c, i * {n} + j AS at FROM (SELECT unnest(range({n})) AS i), (SELECT unnest(range({n})) AS j)"
    return f"SELECT '{view}' AS view, x.at::INTEGER AS i, y.at::INTEGER AS j, round(v, 6) AS v FROM (SELECT u.c AS i, w.c AS j, avg(u.s * w.s) AS v FROM ({one(a, n)}) u JOIN ({one(b, m)}) w USING (id) GROUP BY u.c, w.c) s JOIN ({both(n)}) x ON s.i = x.c JOIN ({both(m)}) y ON s.j = y.c"


_moment("agg_pairs_sq", TWO, _squares_sql, lambda df, p, q: M.pairs_squared(df, p[1], q[1]))


def triple_sql(value):
    return f"WITH {LONG} SELECT u.c::INTEGER AS i, w.c::INTEGER AS j, y.c::INTEGER AS k, round(avg({value}), 6) AS v FROM l u JOIN l w USING (id) JOIN l y USING (id) GROUP BY u.c, w.c, y.c HAVING count({value}) > 0"


@query("agg_triples", triple_sql("u.a * w.b * y.z"))
def agg_triples(spark, d):
    return M.triples(views(spark, d)).withColumn("v", r6("v"))


@query("agg_triples_proj", f"WITH {LONG} SELECT u.c::INTEGER AS i, w.c::INTEGER AS j, round(avg(u.a * w.b * {ALONG.format(t='p.x3', theta=THETA)}), 6) AS v FROM l u JOIN l w USING (id) JOIN p USING (id) WHERE u.a IS NOT NULL AND w.b IS NOT NULL GROUP BY u.c, w.c")
def agg_triples_proj(spark, d):
    return M.triples_projected(views(spark, d), THETA).withColumn("v", r6("v"))


@query(
    "join_views",
    f"WITH {EMB}, a AS (SELECT id, x1 FROM p WHERE id % 7 <> 0), b AS (SELECT id, x2 FROM p WHERE id % 5 <> 0), z AS (SELECT id, x3 FROM p WHERE id % 3 <> 0) SELECT id, {flat('x1')} AS x1, {flat('x2')} AS x2, {flat('x3')} AS x3 FROM a JOIN b USING (id) JOIN z USING (id)",
)
def join_views(spark, d):
    """Three tables of views, each without some of the points: those that all three have, side by side."""
    df = views(spark, d)
    part = lambda c, k: df.where(F.col("id") % k != 0).select("id", c)
    return M.join_views(part("x1", 7), part("x2", 5), part("x3", 3)).select("id", *(_flat(F.col(c)).alias(c) for c in ("x1", "x2", "x3")))


VIEWS4 = " UNION ALL ".join(
    f"SELECT '{n}' AS view, u.c::INTEGER AS i, w.c::INTEGER AS j, NULL::INTEGER AS k, round(avg(u.{a} * w.{b}), 6) AS v FROM l u JOIN l w USING (id) GROUP BY u.c, w.c HAVING count(u.{a} * w.{b}) > 0" for n, a, b in (("13", "a", "z"), ("12", "a", "b"), ("32", "z", "b"))
)


@query("agg_views_gaussian", f"WITH {LONG} {VIEWS4} UNION ALL SELECT '123', u.c::INTEGER, w.c::INTEGER, y.c::INTEGER, round(avg(u.a * w.b * y.z), 6) FROM l u JOIN l w USING (id) JOIN l y USING (id) GROUP BY u.c, w.c, y.c HAVING count(u.a * w.b * y.z) > 0")
def agg_views_gaussian(spark, d):
    df = views(spark, d)
    two = [M.pairs(df, a, b).select(F.lit(n).alias("view"), "i", "j", F.lit(None).cast("int").alias("k"), r6("v").alias("v")) for n, a, b in (("13", "x1", "x3"), ("12", "x1", "x2"), ("32", "x3", "x2"))]
    return two[0].unionAll(two[1]).unionAll(two[2]).unionAll(M.triples(df).select(F.lit("123").alias("view"), "i", "j", "k", r6("v").alias("v")))


# ---- centres, distances, mixtures: the vectors around the labels' means

CENTRES = EMB + f", cen AS (SELECT label AS k, [{', '.join(f'avg(x[{i + 1}])' for i in range(D))}] AS m, count(*) AS n FROM p GROUP BY label)"
DIST2 = "list_sum(list_transform(list_zip({x}, {m}), lambda o: (o[1] - o[2]) ** 2))"
NEAR = DIST2.format(x="x", m="m")


def centres(spark, d):
    """(k, m, w): mean and share of each label."""
    sums = vectors(spark, d).groupBy(F.col("label").alias("k")).agg(F.array(*(F.avg(F.col("x")[i]) for i in range(D))).alias("m"), F.count("*").alias("n"))
    return N.share(sums, "n", name="w").select("k", "m", "w")


def _points(spark, d):
    return vectors(spark, d).select("id", "x")


@query("join_nearest", f"WITH {CENTRES} SELECT id, arg_min(k, (round({NEAR}, 9), k)) AS k, round(sqrt(min({NEAR})), 6) AS dist FROM p, cen GROUP BY id")
def join_nearest(spark, d):
    return X.nearest(_points(spark, d), centres(spark, d)).select("id", "k", r6("dist").alias("dist"))


@query("join_pairwise_dist", f"WITH {CENTRES} SELECT id, k, round(sqrt({NEAR}), 6) AS dist FROM p, cen")
def join_pairwise_dist(spark, d):
    return X.distances(_points(spark, d), centres(spark, d)).select("id", "k", r6("dist").alias("dist"))


SIGMA2 = 0.02
LOGP = f"ln(n::DOUBLE / (SELECT count(*) FROM p)) - {NEAR} / (2 * {SIGMA2}) - {D / 2} * ln(2 * pi() * {SIGMA2})"
RESP = CENTRES + f", lp AS (SELECT id, k, x, {LOGP} AS lp FROM p, cen), z AS (SELECT id, max(lp) + ln(sum(exp(lp - mx))) AS z FROM (SELECT *, max(lp) OVER (PARTITION BY id) AS mx FROM lp) GROUP BY id), re AS (SELECT id, k, x, exp(lp - z) AS r, z FROM lp JOIN z USING (id))"


@query("dec_responsibilities", f"WITH {RESP} SELECT id, k, round(r, 6) AS r FROM re")
def dec_responsibilities(spark, d):
    scored = X.gaussian_scores(_points(spark, d), centres(spark, d), SIGMA2)
    return X.responsibilities(scored).select("id", "k", r6("r").alias("r"))


@query("agg_gmm_loglik", f"WITH {RESP} SELECT round(sum(z), 3) AS loglik FROM z")
def agg_gmm_loglik(spark, d):
    return X.loglik(X.gaussian_scores(_points(spark, d), centres(spark, d), SIGMA2)).select(F.round("loglik", 3).alias("loglik"))


@query(
    "est_em_gmm",
    f"WITH {RESP}, s AS (SELECT k, sum(r) AS n FROM re GROUP BY k), c AS (SELECT k, j, sum(r * v) / sum(r) AS m FROM (SELECT k, r, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM re) GROUP BY k, j) "
    "SELECT k, j::INTEGER AS j, round(m, 6) AS m, round((n + 1) / (SELECT sum(n + 1) FROM s), 6) AS w FROM c JOIN s USING (k)",
)
def est_em_gmm(spark, d):
    """One step from the labels' means; est_em_gmm_fit repeats it."""
    step = X.gmm_step(_points(spark, d), centres(spark, d), SIGMA2, D)
    return step.select("k", F.posexplode("m").alias("j", "m"), "w").select("k", "j", r6("m").alias("m"), r6("w").alias("w"))


@query("est_em_gmm_fit")
def est_em_gmm_fit(spark, d):
    """The mixture's fixed point from drawn centres: (k, j, m, w), the shared variance and the log-likelihood."""
    fitted, sigma2, history = em.fit_gmm(_points(spark, d), 4, steps=25, gain=1e-4)
    return fitted.select("k", F.posexplode("m").alias("j", "m"), "w").withColumns({"sigma2": F.lit(sigma2), "loglik": F.lit(history[-1])})


#: Variances of the three views.
SIGMAS = (0.02, 0.015, 0.03)
VIEW_OF = {1: "m[1:21]", 2: "m[22:42]", 3: "m[43:64]"}
MV = CENTRES + "".join(f", d{v} AS (SELECT id, k, {DIST2.format(x=f'x{v}', m=m)} AS d FROM p, cen)" for v, m in VIEW_OF.items())
MVLP = "ln(n::DOUBLE / (SELECT count(*) FROM p))" + "".join(f" - d{v}.d / (2 * {SIGMAS[v - 1]}) - {SIZES[v - 1] / 2} * ln(2 * pi() * {SIGMAS[v - 1]})" for v in (1, 2, 3))


@query(
    "est_em_multiview_gmm",
    f"""WITH {MV}, lp AS (SELECT p.id, k, x, {MVLP} AS lp FROM p, cen JOIN d1 USING (k) JOIN d2 USING (k) JOIN d3 USING (k) WHERE d1.id = p.id AND d2.id = p.id AND d3.id = p.id),
    mx AS (SELECT *, max(lp) OVER (PARTITION BY id) AS mx FROM lp), re AS (SELECT *, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY id) AS r FROM mx),
    s AS (SELECT k, sum(r) AS n FROM re GROUP BY k), u AS (SELECT id, k, r, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM re),
    c AS (SELECT k, j, sum(r * v) / sum(r) AS m FROM u GROUP BY k, j), g AS (SELECT *, CASE WHEN j < 21 THEN 1 WHEN j < 42 THEN 2 ELSE 3 END AS view FROM u JOIN c USING (k, j)),
    var AS (SELECT view, sum(r * (v - m) ** 2) / ((SELECT count(*) FROM p) * CASE view WHEN 3 THEN 22 ELSE 21 END) AS sigma2 FROM g GROUP BY view)
    SELECT k, j::INTEGER AS j, CASE WHEN j < 21 THEN 1 WHEN j < 42 THEN 2 ELSE 3 END AS view, round(m, 6) AS m, round((n + 1) / (SELECT sum(n + 1) FROM s), 6) AS w, round(sigma2, 6) AS sigma2
    FROM c JOIN s USING (k) JOIN var ON var.view = CASE WHEN j < 21 THEN 1 WHEN j < 42 THEN 2 ELSE 3 END""",
)
def est_em_multiview_gmm(spark, d):
    """One step over three views, each with a variance of its own; est_em_multiview_gmm_fit repeats it."""
    step, sigmas = em.multiview_step(views(spark, d).select("id", "x1", "x2", "x3"), centres(spark, d), list(SIGMAS), SIZES)
    rows = step.select("k", F.posexplode("m").alias("j", "m"), "w")
    view = F.when(F.col("j") < 21, 1).when(F.col("j") < 42, 2).otherwise(3)
    sigma2 = F.element_at(F.array(*map(F.lit, sigmas)), view)
    return rows.select("k", "j", view.alias("view"), r6("m").alias("m"), r6("w").alias("w"), r6(sigma2).alias("sigma2"))


@query("est_em_multiview_gmm_fit")
def est_em_multiview_gmm_fit(spark, d):
    """The three views' fixed point: (k, j, m, w) and the views' variances."""
    fitted, sigmas, history = em.fit_multiview(views(spark, d).select("id", "x1", "x2", "x3"), 4, SIZES, steps=25, gain=1e-4)
    out = fitted.select("k", F.posexplode("m").alias("j", "m"), "w")
    return out.withColumns({f"sigma2_{v}": F.lit(x) for v, x in enumerate(sigmas, 1)} | {"loglik": F.lit(history[-1])})


# ---- regressions: price on quantity, discount and tax

REG = "g AS (SELECT l_orderkey AS id, l_linenumber AS n, l_extendedprice / 10000 AS y, [l_quantity / 10, l_discount * 10, l_tax * 10] AS x FROM lineitem)"
BETAS = [[1.0, 0.5, 0.2], [1.6, -0.3, 0.0]]


def samples(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_extendedprice") / 10000).alias("y"), F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"))


def _fit(b):
    return "(" + " + ".join(f"({v}) * x[{i + 1}]" for i, v in enumerate(b)) + ")"


@query("fn_min_residual", f"WITH {REG} SELECT round(avg(least({', '.join(f'(y - {_fit(b)}) ** 2' for b in BETAS)})), 5) AS residual FROM g")
def fn_min_residual(spark, d):
    return samples(spark, d).agg(F.round(F.avg(X.least_residual(F.col("y"), F.col("x"), BETAS)), 5).alias("residual"))


@query("agg_sq_loss", f"WITH {REG} SELECT round(avg((y - {_fit(BETAS[0])}) ** 2), 5) AS loss FROM g")
def agg_sq_loss(spark, d):
    return X.square_loss(samples(spark, d), X.linear(BETAS[0])).select(F.round("loss", 5).alias("loss"))


@query("agg_sq_gradient", " UNION ALL ".join(f"SELECT {i} AS i, round(avg(({_fit(BETAS[0])} - y) * x[{i + 1}]), 5) AS v FROM g".replace("SELECT", f"{'WITH ' + REG if i == 0 else ''} SELECT", 1) for i in range(3)))
def agg_sq_gradient(spark, d):
    return X.gradient(samples(spark, d), X.linear(BETAS[0]), X.features(1, 3)).withColumn("v", F.round("v", 5))


QUAD = [[0.1, 0.02, 0.0], [0.02, 0.3, 0.1], [0.0, 0.1, 0.2]]
QFIT = "(" + " + ".join(f"{QUAD[i][j]} * x[{i + 1}] * x[{j + 1}]" for i in range(3) for j in range(3)) + ")"
CUBE = [[[0.01 * (i + j + k + 1) for k in range(3)] for j in range(3)] for i in range(3)]
CFIT = "(" + " + ".join(f"{CUBE[i][j][k]} * x[{i + 1}] * x[{j + 1}] * x[{k + 1}]" for i in range(3) for j in range(3) for k in range(3)) + ")"


@query("agg_quad_loss", f"WITH {REG} SELECT round(avg((y - {QFIT}) ** 2), 4) AS loss FROM g")
def agg_quad_loss(spark, d):
    return X.square_loss(samples(spark, d), lambda x: X.bilinear(x, x, QUAD)).select(F.round("loss", 4).alias("loss"))


@query("agg_quad_gradient", f"WITH {REG} SELECT i, round(avg(v), 4) AS v FROM (SELECT unnest(range(9))::INTEGER AS i, unnest([{', '.join(f'({QFIT} - y) * x[{i + 1}] * x[{j + 1}]' for i in range(3) for j in range(3))}]) AS v FROM g) GROUP BY i")
def agg_quad_gradient(spark, d):
    return X.gradient(samples(spark, d), lambda x: X.bilinear(x, x, QUAD), X.features(2, 3)).withColumn("v", F.round("v", 4))


@query("agg_cubic_loss", f"WITH {REG} SELECT round(avg((y - {CFIT}) ** 2), 3) AS loss FROM g")
def agg_cubic_loss(spark, d):
    return X.square_loss(samples(spark, d), lambda x: X.trilinear(x, x, x, CUBE)).select(F.round("loss", 3).alias("loss"))


@query("agg_cubic_gradient", f"WITH {REG} SELECT i, round(avg(v), 2) AS v FROM (SELECT unnest(range(27))::INTEGER AS i, unnest([{', '.join(f'({CFIT} - y) * x[{i + 1}] * x[{j + 1}] * x[{k + 1}]' for i in range(3) for j in range(3) for k in range(3))}]) AS v FROM g) GROUP BY i")
def agg_cubic_gradient(spark, d):
    return X.gradient(samples(spark, d), lambda x: X.trilinear(x, x, x, CUBE), X.features(3, 3)).withColumn("v", F.round("v", 2))


REGLP = "ln(0.5) - (y - {f}) ** 2 / (2 * 0.5) - 0.5 * ln(2 * pi() * 0.5)"
L0, L1 = REGLP.format(f=_fit(BETAS[0])), REGLP.format(f=_fit(BETAS[1]))


@query("agg_regression_loglik", f"WITH {REG} SELECT round(sum(greatest({L0}, {L1}) + ln(1 + exp(-abs(({L0}) - ({L1}))))), 2) AS loglik FROM g")
def agg_regression_loglik(spark, d):
    return X.regression_loglik(samples(spark, d), BETAS, [0.5, 0.5], 0.5).select(F.round("loglik", 2).alias("loglik"))


GRAM2 = ", ".join(f"round(sum(r{k} * x[{i + 1}] * x[{j + 1}]), 2)" for k in range(2) for i in range(3) for j in range(3))


@query(
    "est_em_regression_mixture",
    f"WITH {REG}, re AS (SELECT *, 1 / (1 + exp(({L1}) - ({L0}))) AS r0, 1 / (1 + exp(({L0}) - ({L1}))) AS r1 FROM g) SELECT k, i, j, v FROM (SELECT unnest(range(18)) // 9 AS k, unnest(range(18)) // 3 % 3 AS i, unnest(range(18)) % 3 AS j, unnest([{GRAM2}]) AS v FROM re)",
)
def est_em_regression_mixture(spark, d):
    """The weighted Gram matrices of a step; est_em_regression_fit solves and repeats."""
    gram = X.regression_gram(samples(spark, d), BETAS, [0.5, 0.5], 0.5)
    return gram.where("i < 3 AND j < 3").select(F.col("k").cast("long").alias("k"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("v", 2).alias("v"))


@query("est_em_regression_fit")
def est_em_regression_fit(spark, d):
    """The mixture's fixed point from these coefficients, each step a weighted least squares: (k, i, v, w), the variance and the log-likelihood."""
    b, w, sigma2, history = em.fit_regressions(samples(spark, d), 2, steps=25, betas=BETAS, gain=1e-6)
    rows = [(k, i, float(v), float(w[k]), float(sigma2), history[-1]) for k, row in enumerate(b) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "k int, i int, v double, w double, sigma2 double, loglik double")


@query("agg_mean_check", f"WITH {REG} SELECT round(abs(avg(y) - avg(0.5 * {_fit(BETAS[0])} + 0.5 * {_fit(BETAS[1])})), 5) AS gap FROM g")
def agg_mean_check(spark, d):
    mean = [0.5 * (a + b) for a, b in zip(*BETAS, strict=True)]
    return samples(spark, d).agg(F.round(F.abs(F.avg("y") - F.avg(X.linear(mean)(F.col("x")))), 5).alias("gap"))


@query("est_least_squares", f"WITH {REG} SELECT i, j, round(avg(v), 8) AS v FROM (SELECT unnest(range(12)) // 4 AS i, unnest(range(12)) % 4 AS j, unnest([{', '.join(f'x[{i + 1}] * ' + (f'x[{j + 1}]' if j < 3 else 'y') for i in range(3) for j in range(4))}]) AS v FROM g) GROUP BY i, j")
def est_least_squares(spark, d):
    """The normal equations; est_least_squares_solved solves them."""
    return X.normal_equations(samples(spark, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("v", 8).alias("v"))


def _solved(penalty):
    """SQL for the three coefficients of the regression, by Cramer's rule on the normal equations."""
    cell = lambda i, j: f"s{min(i, j)}{max(i, j)}" if i != j else f"(s{i}{i} + {penalty!r})"

    def det(columns):
        a = [[columns[j](i) for j in range(3)] for i in range(3)]
        return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"

    own = [lambda i, j=j: cell(i, j) for j in range(3)]
    right = lambda i: f"t{i}"
    values = [f"{det([right if j == k else own[j] for j in range(3)])} / {det(own)}" for k in range(3)]
    sums = ", ".join([f"avg(x[{i + 1}] * x[{j + 1}]) AS s{i}{j}" for i in range(3) for j in range(i, 3)] + [f"avg(x[{i + 1}] * y) AS t{i}" for i in range(3)])
    return f"WITH {REG}, n AS (SELECT {sums} FROM g) " + " UNION ALL ".join(f"SELECT 0 AS i, {k} AS j, round({v}, 6) AS v FROM n" for k, v in enumerate(values))


@query("est_least_squares_solved", _solved(0.0))
def est_least_squares_solved(spark, d):
    b = estimators.ridge(samples(spark, d), 3)
    return spark.createDataFrame([(0, j, round(float(v), 6)) for j, v in enumerate(b)], "i int, j int, v double")


@query("join_kernel_smooth", f"WITH {CENTRES}, k AS (SELECT id, k, unnest(x) AS y, generate_subscripts(x, 1) - 1 AS j, exp(-({NEAR})) AS w FROM p, cen) SELECT k, j::INTEGER AS j, round(sum(w * y) / sum(w), 6) AS y FROM k GROUP BY k, j")
def join_kernel_smooth(spark, d):
    """Every coordinate smoothed at the labels' means."""
    return X.kernel_smooth_all(_points(spark, d), centres(spark, d), D).select("k", "j", r6("y").alias("y"))


@query("agg_smooth_all", f"WITH {REG} SELECT round(avg(y), 5) AS y, round(avg(x[1]), 5) AS x0, round(avg(x[2]), 5) AS x1, round(avg(x[3]), 5) AS x2 FROM g")
def agg_smooth_all(spark, d):
    return X.smooth(samples(spark, d), 1, 3).select(F.round("y", 5).alias("y"), *(F.round(F.col("x")[i], 5).alias(f"x{i}") for i in range(3)))


DEALT = "('0x' || substr(md5({key}), 1, 7))::BIGINT"


def _smoothed(df, *more):
    return df.select("g", F.round("y", 6).alias("y"), *(F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(3)), *more)


@query("agg_smooth_subset", f"WITH {REG} SELECT g, round(avg(y), 6) AS y, round(avg(x[1]), 6) AS x0, round(avg(x[2]), 6) AS x1, round(avg(x[3]), 6) AS x2, count(*) AS n FROM (SELECT *, {DEALT.format(key="'0:' || id || ':' || n")} % 16 AS g FROM g) GROUP BY g")
def agg_smooth_subset(spark, d):
    """Sixteen averages, each over the rows that a hash gives it."""
    return _smoothed(X.smooth(samples(spark, d), 16, 3), "n")


@query(
    "agg_smooth_random",
    f"WITH {REG}, w AS (SELECT r.g::INTEGER AS g, y, x, {DEALT.format(key="'0:' || r.g || ':' || id || ':' || n")} % 1000 / 1000.0 AS w FROM g, (SELECT unnest(range(16)) AS g) r) SELECT g, {', '.join(f'round(sum(w * {v}) / sum(w), 6) AS {n}' for v, n in (('y', 'y'), ('x[1]', 'x0'), ('x[2]', 'x1'), ('x[3]', 'x2')))} FROM w GROUP BY g",
)
def agg_smooth_random(spark, d):
    """Sixteen averages over all rows, with weights from a hash."""
    return _smoothed(X.smooth_random(samples(spark, d), 16, 3))


# ---- labels


@query(
    "agg_supervised_hmm",
    f"""WITH {EV}, tr AS (SELECT lag(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS a, tag AS b FROM ev), tags AS (SELECT DISTINCT tag FROM ev), toks AS (SELECT DISTINCT tok FROM ev)
    SELECT 'pi' AS kind, tag::VARCHAR AS h1, NULL AS h2, round((count(*) + 1) / sum(count(*) + 1) OVER (), 6) AS p FROM ev GROUP BY tag
    UNION ALL SELECT 'T', x.tag::VARCHAR, y.tag::VARCHAR, round((count(tr.b) + 1) / sum(count(tr.b) + 1) OVER (PARTITION BY x.tag), 6) FROM tags x CROSS JOIN tags y LEFT JOIN tr ON tr.a = x.tag AND tr.b = y.tag GROUP BY x.tag, y.tag
    UNION ALL SELECT 'O', x.tag::VARCHAR, y.tok::VARCHAR, round((count(ev.pos) + 1) / sum(count(ev.pos) + 1) OVER (PARTITION BY x.tag), 6) FROM tags x CROSS JOIN toks y LEFT JOIN ev ON ev.tag = x.tag AND ev.tok = y.tok GROUP BY x.tag, y.tok""",
)
def agg_supervised_hmm(spark, d):
    return L.supervised_chain(chains(spark, d), 1.0).withColumn("p", r6("p"))


@query(
    "agg_sample_marginals",
    f"""WITH {EV}, tr AS (SELECT lag(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS a, tag AS b FROM ev)
    SELECT 'pi' AS kind, tag::VARCHAR AS h1, NULL AS h2, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM ev WHERE pos = 0 GROUP BY tag
    UNION ALL SELECT 'T', a::VARCHAR, b::VARCHAR, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) FROM tr WHERE a IS NOT NULL GROUP BY a, b
    UNION ALL SELECT 'O', tag::VARCHAR, tok::VARCHAR, round(count(*) / sum(count(*)) OVER (PARTITION BY tag), 6) FROM ev GROUP BY tag, tok""",
)
def agg_sample_marginals(spark, d):
    return L.supervised_chain(chains(spark, d), first_only=True).withColumn("p", r6("p"))


@query("agg_feature_counts", f"WITH {EV}, tr AS (SELECT lag(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS a, tag AS b FROM ev) SELECT 'unary' AS kind, tag::VARCHAR AS h1, tok::VARCHAR AS h2, count(*) AS n FROM ev GROUP BY tag, tok UNION ALL SELECT 'binary', a::VARCHAR, b::VARCHAR, count(*) FROM tr WHERE a IS NOT NULL GROUP BY a, b")
def agg_feature_counts(spark, d):
    return L.feature_counts(chains(spark, d))


@query("agg_top_emissions", f"WITH {EV}, o AS (SELECT tag, tok, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, tok::VARCHAR) AS r FROM o) SELECT tag::VARCHAR AS h1, tok::VARCHAR AS h2, round(n / sum(n) OVER (PARTITION BY tag), 6) AS p FROM r WHERE r <= 3")
def agg_top_emissions(spark, d):
    o = L.supervised_chain(chains(spark, d)).where("kind = 'O'").select("h1", "h2", "p")
    return L.top_emissions(o, 3).withColumn("p", r6("p"))


@query("agg_confusion", f"WITH {EV} SELECT tag AS gold, (tok % 3)::INTEGER AS pred, count(*) AS n FROM ev GROUP BY ALL")
def agg_confusion(spark, d):
    return L.confusion(chains(spark, d).withColumn("guess", F.col("tok") % 3), "tag", "guess")


@query("agg_many_to_one", f"WITH {EV}, c AS (SELECT tag, tok, count(*) AS n FROM ev GROUP BY ALL) SELECT round(sum(best) / sum(n), 6) AS accuracy FROM (SELECT tok, max(n) AS best, sum(n) AS n FROM c GROUP BY tok)")
def agg_many_to_one(spark, d):
    return L.many_to_one(L.confusion(chains(spark, d), "tag", "tok")).withColumn("accuracy", r6("accuracy"))


def _matchings():
    """SQL for the best of all matchings of three labels with three of five: the pairs of the one with the most hits, the first of equal ones."""
    import itertools

    plans = list(itertools.permutations(range(5), 3))
    hits = lambda p: " + ".join(f"coalesce((SELECT n FROM c WHERE tag = {g} AND tok = {k}), 0)" for g, k in enumerate(p))
    return f"m AS (SELECT arg_max(p, n) AS p, max(n) AS best FROM (VALUES {', '.join(f'([{", ".join(map(str, p))}], {hits(p)})' for p in plans)}) v(p, n))"


@query(
    "agg_one_to_one",
    f"WITH {EV}, c AS (SELECT tag, tok, count(*) AS n FROM ev GROUP BY ALL), {_matchings()} SELECT g::VARCHAR AS gold, p[g + 1]::VARCHAR AS pred, coalesce(c.n, 0) AS n, best / (SELECT sum(n) FROM c) AS accuracy FROM m, (SELECT unnest(range(3)) AS g) LEFT JOIN c ON c.tag = g AND c.tok = p[g + 1]",
)
def agg_one_to_one(spark, d):
    return L.one_to_one(L.confusion(chains(spark, d), "tag", "tok"))
