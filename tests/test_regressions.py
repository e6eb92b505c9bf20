"""Fits of regressions over rows in files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momenta.operators import mixtures as X
from momenta.plans import em
from momenta.sources import row_files


def rows(spark, n=5000):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, 2))
    y = np.where(rng.random(n) < 0.4, x @ [1.0, 2.0], x @ [-1.0, 0.5]) + 0.3 * rng.standard_normal(n)
    odd = [(None, [1.0, 2.0]), (1.0, None), (1.0, [None, 2.0])]
    return spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, x, strict=True)] + odd, "y double, x array<double>").repartition(5)


def test_a_step_over_files_is_that_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(row_files, "PIECE", 3000)
    monkeypatch.setattr(row_files, "CHUNK", 700)
    df, b, w, s2 = rows(spark), [[0.8, 1.5], [-0.5, 0.0]], [0.3, 0.7], 0.4
    files = row_files.write_rows(df, F.col("x")[0], F.col("x")[1], F.col("y"))
    assert sum(n for _, n in files.files) == 5000 and files.first[-1] > 30
    g, n, loglik = em.regression_step(spark, files, np.array(b), np.array(w), s2)
    for r in X.regression_gram(df.where("x[0] IS NOT NULL"), b, w, s2).collect():
        assert g[r.k, r.i, r.j] == pytest.approx(r.v, rel=1e-9) and n[r.k] == pytest.approx(r.n, rel=1e-9)
    assert loglik == pytest.approx(X.regression_loglik(df, b, w, s2).first().loglik, rel=1e-9)


def test_a_step_of_the_fit_is_one_pass_and_holds_nothing(spark):
    sc, jobs, held = spark.sparkContext, [], []

    def on_step(step, found, loglik):
        jobs.append(len(sc.statusTracker().getJobIdsForGroup("fit")))
        held.append(sc._jsc.getPersistentRDDs().size())

    before = sc._jsc.getPersistentRDDs().size()
    sc.setJobGroup("fit", "fit")
    try:
        b, _, _, history = em.fit_regressions(rows(spark), 2, 30, betas=[[0.8, 1.5], [-0.5, 0.0]], on_step=on_step, gain=1e-9)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(np.diff(jobs)) <= 2  # the stages of one aggregation
    assert set(held) == {before}
    assert np.abs(b - [[1.0, 2.0], [-1.0, 0.5]]).max() < 0.05 and all(np.diff(history) > -1e-6)
