"""Queries on bags, parameters, experiment tables, sets, sorts and coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.functions import vectors as V
from momenta.operators import bags as B
from momenta.operators import coo as C
from momenta.operators import ngrams as N
from momenta.operators import tab
from momenta.queries.registry import query
from momenta.queries.sql import ENC, EV, TOP, chains, packed, r6, table, trigram_counts

# ---- bags and parameters: parts by how often each supplier's nation sells them

BAGS = """a AS (SELECT l_partkey AS k, count(*)::DOUBLE AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_partkey AS k, count(*)::DOUBLE AS w FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"""


def _bag(spark, d, flag):
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))
    return B.bag(rows, "k").withColumn("w", F.col("w").cast("double"))


@query("agg_counter", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS w, round(sum(value) / (SELECT sum(value) FROM events), 6) AS p FROM events GROUP BY event_type")
def agg_counter(spark, d):
    sums = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("w"))
    return N.share(sums, "w").select("event_type", "n", F.round("w", 4).alias("w"), r6("p").alias("p"))


@query("join_counter_diff", f"WITH {BAGS} SELECT sum((coalesce(a.w, 0) - coalesce(b.w, 0)) ** 2) AS distance FROM a FULL JOIN b USING (k)")
def join_counter_diff(spark, d):
    return B.squared_difference(_bag(spark, d, "R"), _bag(spark, d, "A"), "k")


@query("join_params_merge", f"WITH {BAGS} SELECT coalesce(a.k, b.k) AS k, coalesce(b.w, a.w) AS w FROM a FULL JOIN b ON a.k = b.k")
def join_params_merge(spark, d):
    return B.merge(_bag(spark, d, "R"), _bag(spark, d, "A"), "k")


@query("join_params_axpy", f"WITH {BAGS} SELECT k, a.w + 0.5 * coalesce(b.w, 0) AS w FROM a LEFT JOIN b USING (k)")
def join_params_axpy(spark, d):
    return B.axpy(_bag(spark, d, "R"), _bag(spark, d, "A"), "k", 0.5)


@query("join_params_copy", f"WITH {BAGS} SELECT k, coalesce(b.w, a.w) AS w FROM a LEFT JOIN b USING (k)")
def join_params_copy(spark, d):
    return B.overwrite(_bag(spark, d, "R"), _bag(spark, d, "A"), "k")


@query("join_params_restrict", f"WITH {BAGS} SELECT k, w FROM a WHERE k IN (SELECT k FROM b)")
def join_params_restrict(spark, d):
    return B.restrict(_bag(spark, d, "R"), _bag(spark, d, "A"), "k")


@query("join_params_dot", f"WITH {BAGS} SELECT sum(a.w * b.w) AS dot FROM a JOIN b USING (k)")
def join_params_dot(spark, d):
    return B.dot(_bag(spark, d, "R"), _bag(spark, d, "A"), "k")


@query("set_key_union", f"WITH {BAGS} SELECT k FROM a UNION SELECT k FROM b")
def set_key_union(spark, d):
    return _bag(spark, d, "R").select("k").union(_bag(spark, d, "A").select("k")).distinct()


@query("set_bag_ops", f"WITH {BAGS} SELECT k, w, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) = 0 AS contains FROM a WHERE k NOT IN (SELECT k FROM b WHERE w >= 12)")
def set_bag_ops(spark, d):
    a, b = _bag(spark, d, "R"), _bag(spark, d, "A")
    return B.remove_all(a, b.where("w >= 12"), "k").crossJoin(F.broadcast(B.contains_all(a, b, "k")))


@query("set_counter_union", f"WITH {BAGS} SELECT k, sum(w) AS w FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k")
def set_counter_union(spark, d):
    return B.add_all(_bag(spark, d, "R"), _bag(spark, d, "A"), "k")


# ---- experiment tables: a line for each event

LINES = """lines AS (SELECT event_id, 'exp.user=' || user_id || chr(9) || 'exp.type=' || event_type || chr(9) || 'cents=' || round(value * 100)::BIGINT || CASE WHEN event_id % 3 = 0 THEN chr(9) || 'note=a=b' ELSE '' END AS line FROM events)"""


def lines(spark, d):
    note = F.when(F.col("event_id") % 3 == 0, F.lit("\tnote=a=b")).otherwise("")
    text = F.concat(F.lit("exp.user="), F.col("user_id").cast("string"), F.lit("\texp.type="), "event_type", F.lit("\tcents="), F.round(F.col("value") * 100).cast("long").cast("string"), note)
    return table(spark, d, "events").select("event_id", text.alias("line"))


def maps(spark, d):
    return lines(spark, d).select("event_id", tab.parse(F.col("line")).alias("m"))


@query("flt_tab", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def flt_tab(spark, d):
    return tab.filter_rows(maps(spark, d), "m", {"type": "click", "user": "7"}).select("event_id")


@query("prj_tab_keys", "SELECT event_type AS type, 'a=b' AS note, round(value * 100)::BIGINT::VARCHAR AS cents FROM events WHERE event_id % 3 = 0")
def prj_tab_keys(spark, d):
    return tab.extract(maps(spark, d), "m", ["type", "note", "cents"])


AGG_TAB = """SELECT event_type AS "exp.type", 'cents' AS name, round(avg(round(value * 100)), 6) AS mean, max(round(value * 100)) AS most, min(round(value * 100)) AS least, NULL::VARCHAR AS first FROM events GROUP BY 1
UNION ALL SELECT event_type, 'exp.user', round(avg(user_id), 6), max(user_id), min(user_id), NULL FROM events GROUP BY 1
UNION ALL SELECT event_type, 'note', NULL, NULL, NULL, 'a=b' FROM events WHERE event_id % 3 = 0 GROUP BY 1"""


@query("agg_tab", f"SELECT \"exp.type\" AS type, name, mean, most::DOUBLE AS most, least::DOUBLE AS least, first FROM ({AGG_TAB})")
def agg_tab(spark, d):
    rows = maps(spark, d).select(F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(F.replace(e["key"], F.lit("exp.type"), F.lit("type")), e["value"]))).alias("m"))
    return tab.aggregate(rows, "m", ["type"]).withColumn("mean", r6("mean"))


@query("sort_tab", "SELECT event_id, row_number() OVER (ORDER BY event_type, round(value * 100), event_id) AS r FROM events")
def sort_tab(spark, d):
    m = F.col("m")
    keys = [*tab.sort_key(m, "exp.type"), *tab.sort_key(m, "cents"), F.col("event_id").asc()]
    rows = maps(spark, d)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("event_id")
    return N.dense_index(ranged, "r").select("event_id", (F.col("r") + 1).alias("r"))


@query("sort_argsort", "SELECT p_partkey AS i, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part")
def sort_argsort(spark, d):
    order = [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]
    return N.dense_index(table(spark, d, "part").repartitionByRange(*order).sortWithinPartitions(*order), "r").select(F.col("p_partkey").alias("i"), "r")


# ---- matrices: bigrams of events by user (counts), and of the encoded corpus

MAT = f"""{EV}, bi AS (SELECT tok, tag, lead(tok) OVER w AS nxt, lead(tag) OVER w AS ntag FROM ev WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
m AS (SELECT tok::INTEGER AS i, nxt::INTEGER AS j, count(*)::DOUBLE AS v FROM bi WHERE nxt IS NOT NULL GROUP BY ALL),
f AS (SELECT tok::INTEGER AS i, tag AS j, count(*)::DOUBLE AS v FROM ev GROUP BY ALL),
t AS (SELECT a::INTEGER AS i, b::INTEGER AS j, c::INTEGER AS k, count(*)::DOUBLE AS v FROM (SELECT tok AS a, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE c IS NOT NULL GROUP BY ALL)"""


def _counted(df, **index):
    return df.groupBy(*(F.col(c).alias(i) for i, c in index.items())).agg(F.count("*").cast("double").alias("v"))


def matrix(spark, d):
    """Counts of neighbouring event types."""
    return _counted(N.windows(chains(spark, d), 2), i="w0", j="w1")


def factor(spark, d):
    """Counts of event type by level."""
    return _counted(chains(spark, d), i="tok", j="tag")


def tensor(spark, d):
    return _counted(N.windows(chains(spark, d), 3), i="w0", j="w1", k="w2")


def matrix_query(name, sql):
    return query(name, f"WITH {MAT} {sql}")


@matrix_query("fn_normalize_rows", "SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 6) AS v FROM m")
def fn_normalize_rows(spark, d):
    return C.normalized(matrix(spark, d), "i").withColumn("v", r6("v"))


@matrix_query("fn_normalize_cols", "SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 6) AS v FROM m")
def fn_normalize_cols(spark, d):
    return C.normalized(matrix(spark, d), "j").withColumn("v", r6("v"))


@matrix_query("fn_row_minmax", "SELECT i, j, round(2 * (v - low) / (high - low) - 1, 6) AS v, low, high FROM (SELECT *, min(v) OVER w AS low, max(v) OVER w AS high FROM m WINDOW w AS (PARTITION BY i))")
def fn_row_minmax(spark, d):
    return C.minmax_rows(matrix(spark, d)).withColumn("v", r6("v"))


@matrix_query("fn_row_maxabs", "SELECT i, j, round(v / factor, 6) AS v, factor FROM (SELECT *, max(abs(v)) OVER (PARTITION BY i) AS factor FROM m)")
def fn_row_maxabs(spark, d):
    return C.maxabs(matrix(spark, d), "i").withColumn("v", r6("v"))


@matrix_query("fn_col_maxabs", "SELECT i, j, round(v / factor, 6) AS v, factor FROM (SELECT *, max(abs(v)) OVER (PARTITION BY j) AS factor FROM m)")
def fn_col_maxabs(spark, d):
    return C.maxabs(matrix(spark, d), "j").withColumn("v", r6("v"))


@matrix_query(
    "fn_simplex_project",
    "SELECT i, j, round(u / sum(u) OVER (PARTITION BY j), 6) AS v FROM (SELECT i, j, greatest(v * CASE WHEN 2 * sum((v > 0)::INTEGER) OVER (PARTITION BY j) < count(*) OVER (PARTITION BY j) THEN -1 ELSE 1 END, 0) + 0.5 AS u FROM (SELECT i, j, v - 400 AS v FROM m))",
)
def fn_simplex_project(spark, d):
    return C.simplex_columns(matrix(spark, d).withColumn("v", F.col("v") - 400), 0.5).withColumn("v", r6("v"))


@matrix_query("join_mode_product", "SELECT a.j AS i, b.j, c.j AS k, round(sum(t.v * a.v * b.v * c.v) / 1e9, 6) AS v FROM t JOIN f a ON t.i = a.i JOIN f b ON t.j = b.i JOIN f c ON t.k = c.i GROUP BY ALL")
def join_mode_product(spark, d):
    f = factor(spark, d)
    return C.multilinear(tensor(spark, d), {"i": f, "j": f, "k": f}).select("i", "j", "k", r6(F.col("v") / 1e9).alias("v"))


@matrix_query("join_exact_moments", "SELECT a.i AS x1, b.i AS x2, c.i AS x3, round(sum(w * a.v * b.v * c.v) / 1e9, 6) AS v FROM (SELECT j AS k, sum(v) AS w FROM f GROUP BY 1) JOIN f a ON a.j = k JOIN f b ON b.j = k JOIN f c ON c.j = k GROUP BY ALL")
def join_exact_moments(spark, d):
    f = factor(spark, d).withColumnRenamed("j", "k")
    return C.exact_moments(f.groupBy("k").agg(F.sum("v").alias("w")), [f, f, f]).withColumn("v", r6(F.col("v") / 1e9))


@matrix_query("join_outer", "SELECT a.i, b.i AS j, a.v * b.v AS v FROM (SELECT i, sum(v) AS v FROM m GROUP BY i) a, (SELECT j AS i, sum(v) AS v FROM f GROUP BY j) b")
def join_outer(spark, d):
    a = C.marginal(matrix(spark, d), "i")
    return C.outer(a, C.marginal(factor(spark, d), "j").withColumnRenamed("j", "i"))


@matrix_query("join_permute", "SELECT ((i * 2 + 1) % 5)::INTEGER AS i, j, v FROM m")
def join_permute(spark, d):
    m = matrix(spark, d)
    p = m.select(F.col("i").alias("a")).distinct().withColumn("b", ((F.col("a") * 2 + 1) % 5).cast("int"))
    return C.permute(m, "i", p)


@matrix_query("agg_condense", "SELECT i, j, NULL::INTEGER AS k, sum(v) AS v FROM t GROUP BY i, j UNION ALL SELECT i, NULL, NULL, sum(v) FROM t GROUP BY i")
def agg_condense(spark, d):
    sets = tensor(spark, d).groupingSets([["i", "j"], ["i"]], "i", "j").agg(F.sum("v").alias("v"))
    return sets.select("i", "j", F.lit(None).cast("int").alias("k"), "v")


@matrix_query(
    "agg_symmetrize",
    "SELECT i, j, k, round(sum(v) / 6, 6) AS v FROM (SELECT i, j, k, v FROM t UNION ALL SELECT i, k, j, v FROM t UNION ALL SELECT j, i, k, v FROM t UNION ALL SELECT j, k, i, v FROM t UNION ALL SELECT k, i, j, v FROM t UNION ALL SELECT k, j, i, v FROM t) GROUP BY ALL",
)
def agg_symmetrize(spark, d):
    return C.symmetrize(tensor(spark, d)).withColumn("v", r6("v"))


@matrix_query("agg_skew", "SELECT sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS skew FROM m a FULL JOIN (SELECT j AS i, i AS j, v FROM m) b ON a.i = b.i AND a.j = b.j")
def agg_skew(spark, d):
    return C.skew(matrix(spark, d))


SIZES = {"i": 5, "j": 5, "k": 5}


@matrix_query("agg_unfold", "SELECT j AS i, i * 5 + k AS j, v FROM t")
def agg_unfold(spark, d):
    return C.unfold(tensor(spark, d), "j", SIZES)


@matrix_query("agg_fold", "SELECT i, j, k, v FROM t")
def agg_fold(spark, d):
    """From a matrix whose columns count the first and the third index."""
    m = tensor(spark, d).select(F.col("j").alias("i"), (5 * F.col("i") + F.col("k")).alias("j"), "v")
    return C.fold(m, "j", SIZES)


@matrix_query("agg_preconditioned", "SELECT i, j, k, round(v / sum(v) OVER (), 9) AS v FROM (SELECT i, j, k, sum(v) AS v FROM (SELECT i, j, k, v / (SELECT sum(v) FROM t) AS v FROM t UNION ALL SELECT DISTINCT i, i, i, 0.01 FROM t) GROUP BY i, j, k)")
def agg_preconditioned(spark, d):
    return C.precondition(N.share(tensor(spark, d), "v", name="v"), 0.01).withColumn("v", F.round("v", 9))


@matrix_query(
    "agg_matrix_reduce",
    "SELECT 'row' AS what, i AS at, round(sum(v), 6) AS total, round(sqrt(sum(v * v)), 6) AS norm, min(v) AS least, max(v) AS most FROM m GROUP BY i UNION ALL SELECT 'column', j, sum(v), round(sqrt(sum(v * v)), 6), min(v), max(v) FROM m GROUP BY j UNION ALL SELECT 'all', NULL, sum(v), round(sqrt(sum(v * v)), 6), min(v), max(v) FROM m",
)
def agg_matrix_reduce(spark, d):
    sets = matrix(spark, d).groupingSets([["i"], ["j"], []], "i", "j").agg(F.grouping_id("i", "j").alias("g"), F.sum("v").alias("total"), r6(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("norm"), F.min("v").alias("least"), F.max("v").alias("most"))
    what = F.when(F.col("g") == 1, "row").when(F.col("g") == 2, "column").otherwise("all")
    return sets.select(what.alias("what"), F.coalesce("i", "j").alias("at"), "total", "norm", "least", "most")


#: From below the least difference between the counts and their transpose to above the greatest.
CLOSE = (0.0, 1.0, 10.0, 100.0, 1e6)


@matrix_query(
    "agg_allclose",
    f"SELECT eps, coalesce(bool_and(abs(coalesce(a.v, 0) - coalesce(b.v, 0)) <= eps), true) AS close FROM m a FULL JOIN (SELECT j AS i, i AS j, v FROM m) b ON a.i = b.i AND a.j = b.j, (SELECT unnest({list(CLOSE)}::DOUBLE[]) AS eps) GROUP BY eps",
)
def agg_allclose(spark, d):
    m = matrix(spark, d)
    turned = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return reduce(DataFrame.unionAll, (C.allclose(m, turned, eps).select(F.lit(eps).alias("eps"), "close") for eps in CLOSE))


@matrix_query("coo_axpy", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT j, i, -0.5 * v FROM m) GROUP BY ALL")
def coo_axpy(spark, d):
    m = matrix(spark, d)
    return C.axpy(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), -0.5)


@matrix_query("coo_slice", "SELECT CASE i WHEN 3 THEN 0 ELSE 1 END AS i, j, v FROM m WHERE i IN (3, 1)")
def coo_slice(spark, d):
    return C.rows_of(matrix(spark, d), [3, 1])


@matrix_query("coo_stack", "SELECT i, j, v FROM m UNION ALL SELECT i + 5, j, v FROM f")
def coo_stack(spark, d):
    return C.stack(matrix(spark, d), factor(spark, d), 5)


@matrix_query("agg_column_error", "SELECT j, round(sqrt(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2)), 6) AS error, round(sqrt(sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2)) / sqrt(sum(coalesce(a.v, 0) ** 2)), 6) AS relative FROM m a FULL JOIN (SELECT j AS i, i AS j, v FROM m) b USING (i, j) GROUP BY j")
def agg_column_error(spark, d):
    m = matrix(spark, d)
    return C.column_errors(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).select("j", r6("error").alias("error"), r6("relative").alias("relative"))


@matrix_query("agg_column_gap", "SELECT round(min(d), 6) AS gap FROM (SELECT sqrt(sum((a.v - b.v) ** 2)) AS d FROM m a JOIN m b ON a.i = b.i AND a.j < b.j GROUP BY a.j, b.j)")
def agg_column_gap(spark, d):
    return C.column_gap(matrix(spark, d)).withColumn("gap", r6("gap"))


@matrix_query(
    "sort_canonical",
    "SELECT r.r AS i, c.c AS j, v FROM m JOIN (SELECT i, row_number() OVER (ORDER BY v, i) - 1 AS r FROM m WHERE j = (SELECT j FROM m ORDER BY v, i, j LIMIT 1)) r USING (i) JOIN (SELECT j, row_number() OVER (ORDER BY v, j) - 1 AS c FROM m WHERE i = (SELECT i FROM m ORDER BY v, i, j LIMIT 1)) c USING (j)",
)
def sort_canonical(spark, d):
    return C.canonical(matrix(spark, d))


# ---- implicit products: word co-occurrence times a thin factor, never the word by word matrix

PROD = f"""{ENC}, w AS (SELECT tok AS a, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c FROM enc WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
tri AS (SELECT a, b, c, count(*) AS n FROM w WHERE c IS NOT NULL GROUP BY ALL), tot AS (SELECT sum(n) AS s FROM tri),
r AS (SELECT tok AS i, p AS j, sin(tok * 3 + p)::DOUBLE AS v FROM (SELECT DISTINCT tok FROM enc), (SELECT unnest([0, 1, 2]) AS p))"""


def pair_counts(spark, d):
    t = N.share(trigram_counts(spark, d).groupBy(F.col("w0").alias("i"), F.col("w1").alias("j")).agg(F.sum("n").alias("n")), "n", name="v")
    return t.select("i", "j", "v")


def thin(spark, d):
    """A factor of three columns over the words' numbers; TOP + 4 at most, so the corpus isn't read again for those that occur."""
    words = spark.range(TOP + 4).select(F.col("id").cast("int").alias("i"))
    return words.select("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j")).withColumn("v", F.sin((F.col("i") * 3 + F.col("j")).cast("double")))


@query("agg_right_multiply", f"WITH {PROD} SELECT a AS i, r.j, round(sum(n * r.v) / max(s), 6) AS v FROM tri JOIN r ON r.i = b, tot GROUP BY ALL")
def agg_right_multiply(spark, d):
    return C.multilinear(pair_counts(spark, d), {"j": thin(spark, d)}).withColumn("v", r6("v"))


@query("agg_left_multiply", f"WITH {PROD} SELECT r.j AS i, b AS j, round(sum(n * r.v) / max(s), 6) AS v FROM tri JOIN r ON r.i = a, tot GROUP BY ALL")
def agg_left_multiply(spark, d):
    return C.multilinear(pair_counts(spark, d), {"i": thin(spark, d)}).select("i", "j", r6("v").alias("v"))


@query("agg_double_multiply", f"WITH {PROD} SELECT x.j AS i, y.j, round(sum(n * x.v * y.v) / max(s), 6) AS v FROM tri JOIN r x ON x.i = a JOIN r y ON y.i = b, tot GROUP BY ALL")
def agg_double_multiply(spark, d):
    r = thin(spark, d)
    return C.multilinear(pair_counts(spark, d), {"i": r, "j": r}).select("i", "j", r6("v").alias("v"))


@query("agg_multiply123", f"WITH {PROD} SELECT x.j AS i, y.j, z.j AS k, round(sum(n * x.v * y.v * z.v) / max(s), 6) AS v FROM tri JOIN r x ON x.i = a JOIN r y ON y.i = b JOIN r z ON z.i = c, tot GROUP BY ALL")
def agg_multiply123(spark, d):
    r = thin(spark, d)
    t = N.share(trigram_counts(spark, d), "n", name="v").select(F.col("w0").alias("i"), F.col("w1").alias("j"), F.col("w2").alias("k"), "v")
    return C.multilinear(t, {"i": r, "j": r, "k": r}).select("i", "j", "k", r6("v").alias("v"))


@query("join_projection", f"WITH {PROD} SELECT seq_id, r.j, round(avg(r.v), 6) AS v FROM enc JOIN r ON r.i = tok GROUP BY ALL")
def join_projection(spark, d):
    counts = packed(spark, d).select("seq_id", F.explode("x").alias("i")).groupBy("seq_id", "i").agg(F.count("*").alias("n"))
    joined = counts.join(thin(spark, d), "i")
    return joined.groupBy("seq_id", "j").agg(r6(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))


# ---- labels

@query("fn_hamming", f"WITH {EV} SELECT seq_id, round(avg((tok % 3 <> tag)::INTEGER), 6) AS distance FROM ev GROUP BY seq_id")
def fn_hamming(spark, d):
    rows = chains(spark, d).withColumn("guess", F.col("tok") % 3)
    both = N.pack(rows, "tag", "a").join(N.pack(rows, "guess", "b"), "seq_id")
    return both.select("seq_id", r6(V.hamming(F.col("a"), F.col("b"))).alias("distance"))
