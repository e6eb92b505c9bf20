"""Quality rules as robust multivariate outliers.

Word and line statistics of every text are turned into a short vector; for each language and source the minimum
covariance determinant is estimated by concentration steps from several robust starts, and a text goes when its Mahalanobis distance from its
group's robust centre is beyond a chi-square quantile. All of it is DataFrame functions: in-row arrays for the
statistics, aggregations for the estimates (a group is never gathered), column arithmetic for the distances.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momenta.llm.common import SPACE, let, saved

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: The vector: name, what it is, and the least standard deviation it counts with. The least deviations keep groups
#: whose core is constant (clean prose has no symbols at all) from rejecting every text that isn't.
VECTOR = (
    ("x_len", "ln(1 + n_words)", 0.5),
    ("x_word", "ln(1 + word_chars / n_words)", 0.15),
    ("x_symbol", "n_symbols / word_chars", 0.015),
    ("x_upper", "n_upper / word_chars", 0.05),
    ("x_line", "n_dup_lines / greatest(n_lines, 10)", 0.08),
    ("x_repeat", "n_repeat_words / n_words", 0.05),
)
NAMES = [n for n, _, _ in VECTOR]
D = len(VECTOR)
#: Share of a group that the concentration steps keep, the gain in half the determinant's logarithm below which they end,
#: and the tail of the chi-square beyond which a text goes: were texts normal, one good text in 10,000 would go.
CORE = 0.75
LEAST_GAIN = 1e-6
TAIL = 1e-4
GROUP = ("lang", "source")


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 1000):
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def _repeated(hashes: Column) -> Column:
    """Words that lie in windows found twice or more; hashes has one for each window."""
    at = lambda a, k: F.get(a, k)

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (at(s, k + 1)["h"] == e["h"]) | (F.when(k > 0, at(s, k - 1)["h"]) == e["h"]))
        return F.array_sort(F.transform(twice, lambda e: e["p"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)))
        return F.aggregate(F.filter(steps, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    return let(let(pairs, places), covered)


def statistics(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id, the carried columns and the counts of every whole text; see rate() for the cases."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, text.alias("t"))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    df = df.withColumns(
        {
            "w": F.filter(F.split("t", SPACE), lambda x: x != ""),
            "l": F.filter(F.split("t", "\n"), has_word),
            "n_symbols": F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_lines": F.size("l").cast("long"),
            "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
            "h": F.transform("w", lambda x: F.xxhash64(x)),
        }
    )
    window = lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(REPEAT_WINDOW)))
    spots = F.when(F.size("h") >= REPEAT_WINDOW, F.sequence(F.lit(0), F.size("h") - REPEAT_WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("g", F.transform(spots, window))
    repeats = F.when(F.size("g") == F.size(F.array_distinct("g")), F.lit(0).cast("long")).otherwise(_repeated(F.col("g")))
    return df.withColumn("n_repeat_words", repeats).drop("t", "w", "l", "h", "g")


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance: forward substitution with the group's Cholesky factor."""
    y: list[str] = []
    for i in range(D):
        y.append(f"(({NAMES[i]} - m_{i}{''.join(f' - c_{i}_{j} * {y[j]}' for j in range(i))}) / c_{i}_{i})")
    return F.expr(" + ".join(f"{v} * {v}" for v in y))


def _factored(params: DataFrame, *more: str) -> DataFrame:
    """From m_i and the covariances s_i_j of a group: c_i_j, the Cholesky factor of the scaled covariance plus the least variances, and logdet, half the logarithm of its determinant."""
    scale = CORE / chi2_cdf(chi2_quantile(CORE, D), D + 2)
    for j in range(D):
        rest = lambda i: f"(coalesce(s_{i}_{j}, 0D) * {scale!r}D + {VECTOR[i][2] ** 2 if i == j else 0.0!r}D{''.join(f' - c_{i}_{k} * c_{j}_{k}' for k in range(j))})"  # noqa: E731, B023
        root = f"sqrt(greatest({rest(j)}, 1e-12D))"
        params = params.selectExpr("*", f"{root} AS c_{j}_{j}", *(f"{rest(i)} / {root} AS c_{i}_{j}" for i in range(j + 1, D)))
    logdet = " + ".join(f"ln(c_{i}_{i})" for i in range(D))
    return params.selectExpr("g_0", "g_1", *more, f"{logdet} AS logdet", *(f"m_{i}" for i in range(D)), *(f"c_{i}_{j}" for i, j in PAIRS))


def _medians(rows: DataFrame) -> DataFrame:
    """For each group and coordinate the median m_i and the quartiles' spread plus the least deviation, v_i, from counts of bins of fixed width."""
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(n) / (w / 16)).alias("b"), F.lit(w / 16).alias("w")) for i, (n, _, w) in enumerate(VECTOR))))
    counts = rows.select("g_0", "g_1", bins.alias("x")).groupBy("g_0", "g_1", "x.i", "x.b", "x.w").count()
    whole = Window.partitionBy("g_0", "g_1", "i")
    upto = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"upto": F.sum("count").over(upto), "n": F.sum("count").over(whole)})
    at = lambda q, i: F.min(F.when((F.col("i") == i) & (F.col("upto") >= q * F.col("n")), (F.col("b") + 0.5) * F.col("w")))
    spread = lambda i: (at(0.75, i) - at(0.25, i)) / 1.349
    return counts.groupBy("g_0", "g_1").agg(*(at(0.5, i).alias(f"m_{i}") for i in range(D)), *(F.sqrt(spread(i) * spread(i) + VECTOR[i][2] ** 2).alias(f"v_{i}") for i in range(D)))


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    p = params.withColumnsRenamed({"g_0": "p_0", "g_1": "p_1"})
    return rows.join(p, rows["g_0"].eqNullSafe(p["p_0"]) & rows["g_1"].eqNullSafe(p["p_1"])).drop("p_0", "p_1")


def _starts(rows: DataFrame) -> DataFrame:
    """Four robust starts of a group, with share, the part of it that the first step keeps.

    All have the medians as centre and the quartiles' spreads as deviations. The correlations are none (a step from it
    with half of the group is the fourth start), those of the hyperbolic tangents, and those of the directions.
    """
    medians = saved(_medians(rows), "medians")
    near = _with(rows, medians).selectExpr("g_0", "g_1", *(f"({NAMES[i]} - m_{i}) / v_{i} AS z_{i}" for i in range(D)))
    near = near.selectExpr("*", f"nullif(sqrt({' + '.join(f'z_{i} * z_{i}' for i in range(D))}), 0D) AS size")
    near = near.selectExpr("g_0", "g_1", *(f"tanh(z_{i}) AS t_{i}" for i in range(D)), *(f"coalesce(z_{i} / size, 0D) AS d_{i}" for i in range(D)))
    # mean products; those of the directions are about the median, so not centred
    sums = [F.expr(f"avg({k}_{i} * {k}_{j}) AS {k}_{i}_{j}") for k in "td" for i, j in PAIRS]
    means = near.groupBy("g_0", "g_1").agg(*(F.avg(f"t_{i}").alias(f"t_{i}") for i in range(D)), *sums)
    cov = {"t": lambda i, j: f"(t_{i}_{j} - t_{i} * t_{j})", "d": lambda i, j: f"d_{i}_{j}"}

    def start(number: int, share: float, k: str | None) -> str:
        """Correlations a little drawn in, so that the start is no singular matrix."""
        r = lambda i, j: "1D" if i == j else f"coalesce(0.999D * {cov[k](i, j)} / sqrt(nullif(greatest({cov[k](i, i)} * {cov[k](j, j)}, 0D), 0D)), 0D)" if k else "0D"
        return f"named_struct('start', {number}, 'share', {share}D, {', '.join(f"'s_{i}_{j}', {r(i, j)} * v_{i} * v_{j}" for i, j in PAIRS)})"

    starts = f"explode(array({start(0, CORE, None)}, {start(1, CORE, 't')}, {start(2, CORE, 'd')}, {start(3, 0.5, None)})) AS x"
    found = _with(medians, means).selectExpr("g_0", "g_1", *(f"m_{i}" for i in range(D)), starts)
    return _factored(found.selectExpr("*", "x.*"), "start", "share")


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """A concentration step from each row of params (a group may have several): the centre and covariance of the rows that lie nearest by it, a share of the group.

    One aggregation: counts and sums of products by logarithmic bin of the distance, 1/64 of a power of two wide, of
    which those up to the share are summed. The core is of whole bins, so it may be larger by the rows of its last bin.
    """
    keys = ["g_0", "g_1", "start", "share", *(f"m_{i}" for i in range(D))]
    near = _with(rows, params).select(*keys, F.floor(F.log2(_distance() + 1e-6) * 64).alias("bin"), *(F.expr(f"{NAMES[i]} - m_{i} AS y_{i}") for i in range(D)))
    sums = [f"y_{i}" for i in range(D)] + [f"y_{i} * y_{j}" for i, j in PAIRS]
    bins = near.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *(F.expr(f"sum({x}) AS u_{k}") for k, x in enumerate(sums)))
    group = Window.partitionBy("g_0", "g_1", "start")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = bins.withColumns({"before": before, "all": F.sum("n").over(group)}).where("before < share * all")
    totals = core.groupBy(*keys).agg(*(F.expr(f"sum(u_{k}) / sum(n) AS u_{k}") for k in range(len(sums))))
    cov = [f"u_{D + k} - u_{i} * u_{j} AS s_{i}_{j}" for k, (i, j) in enumerate(PAIRS)]
    moved = totals.selectExpr("g_0", "g_1", "start", f"{CORE}D AS share", *(f"m_{i} + u_{i} AS m_{i}" for i in range(D)), *cov)
    return saved(_factored(moved, "start", "share"), "groups")


def estimate(rows: DataFrame) -> DataFrame:
    """The groups' robust centres and factors, by the minimum covariance determinant.

    Four starts take two concentration steps each; of a group's starts the one with the least determinant goes on until
    a step makes its determinant no smaller. The determinant is that of the scaled covariance plus the least variances
    (the regularized form), which no step makes larger. Ties at the core's edge all stay. A group of one row has that
    as centre.
    """
    params = _step(rows, _step(rows, _starts(rows)))
    least = F.row_number().over(Window.partitionBy("g_0", "g_1").orderBy("logdet", "start"))
    best = saved(params.withColumn("r", least).where("r = 1").drop("r"), "groups")
    going, done = best, []
    while True:
        after = _step(rows, going)
        old = going.select(F.col("g_0").alias("o_0"), F.col("g_1").alias("o_1"), F.col("logdet").alias("old"))
        joined = after.join(old, after["g_0"].eqNullSafe(old["o_0"]) & after["g_1"].eqNullSafe(old["o_1"]))
        smaller = saved(joined.where(F.col("logdet") < F.col("old") - LEAST_GAIN).drop("o_0", "o_1", "old"), "groups")
        s = smaller.select(F.col("g_0").alias("o_0"), F.col("g_1").alias("o_1"))
        done.append(going.join(s, going["g_0"].eqNullSafe(s["o_0"]) & going["g_1"].eqNullSafe(s["o_1"]), "left_anti"))
        if smaller.isEmpty():
            return saved(reduce(DataFrame.unionAll, done).drop("start", "share", "logdet"), "groups")
        going = smaller


def _rows(docs: DataFrame, *carry: Column) -> DataFrame:
    """statistics() of docs with the group, base_failed and the vector, as a table; carry goes along."""
    rows = statistics(docs, F.col("lang").cast("string").alias("g_0"), F.col("source").cast("string").alias("g_1"), *carry)
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return saved(rows.withColumns({n: F.when(~F.col("base_failed"), F.expr(f"cast({how} as double)")) for n, how, _ in VECTOR}), "statistics")


def _judged(passed: DataFrame, tail: float, *columns: str) -> DataFrame:
    """The columns of the rows that pass the base rules, with distance and kept."""
    vectors = passed.select("g_0", "g_1", *NAMES)
    judged = _with(passed, estimate(vectors)).select(*columns, _distance().alias("distance"))
    return judged.withColumn("kept", F.col("distance") <= chi2_quantile(1 - tail, D))


def rate(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Statistics and verdict for every row of docs (doc_id, text, lang, source; other columns are not read).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, distance (squared;
    null where base_failed) and kept. A null text has no words and fails the base rules. Null lang or source is a
    group of its own. Estimates come from the rows that pass the base rules. Rows that repeat a doc_id are rated each.
    An empty table gives none.
    """
    rows = _rows(docs)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _judged(rows.where("not base_failed"), tail, *counts)
    return judged.unionByName(rows.where("base_failed").select(*counts, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def filter_quality(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """docs without the rows that the rules reject; all columns stay. Each row is judged by its own text.

    The rows are kept with their statistics in one table and judged where they are read, with the groups' estimates
    joined to them; texts are not shuffled.
    """
    rows = _rows(docs, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return _judged(rows.where("not base_failed"), tail, "row").where("kept").select("row.*")
