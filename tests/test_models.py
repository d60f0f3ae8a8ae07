"""Planted truths for the model operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailforge.operators import hinge as HG
from retailforge.operators import regress as RG


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    n = 4000
    x1, x2, x3 = rng.uniform(0, 1, n), rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    y = 1.0 + 3.0 * np.maximum(x1 - 0.5, 0) + 0.5 * x2 + rng.normal(0, 0.05, n)
    z = 2 * x2 + 1  # exact copy up to scale: aliased
    rows = [tuple(map(float, r)) for r in zip(y, x1, x2, x3, z)]
    return spark.createDataFrame(rows, "y double, x1 double, x2 double, x3 double, z double")


def test_mars_recovers_planted_hinge(planted):
    kept, coef, imp, n = HG.mars(planted, "y", ["x1", "x2", "x3"], degree=1, n_knots=19)
    labels = [HG.term_label(t) for t in kept]
    knots = [k for t in kept for v, k, s in t if v == "x1" and s > 0]
    assert knots and min(abs(k - 0.5) for k in knots) < 0.06, labels
    top = max(imp, key=lambda r: r[3])
    assert top[0] == "x1" and top[3] == pytest.approx(100.0)


def test_ols_and_aliasing(planted):
    t = {r.term: r for r in RG.ols(planted, "y", ["x2", "z"]).collect()}
    assert t["z"].aliased and t["z"].estimate is None
    assert RG.aliased_columns(planted, ["x2", "z"], "y") == ["z"]


def test_quantile_share_below_matches_tau(planted):
    fits = RG.quantile_regressions(planted, "y", ["x1", "x2"], [0.25, 0.75])
    for tau, f in fits.items():
        assert f["below"] == pytest.approx(tau, abs=0.02)
        assert f["status"] == "optimal" and f["gap"] <= 1.01e-4 * f["loss"]


def test_intercept_quantile_is_order_statistic(planted):
    ys = np.sort(np.array([r[0] for r in planted.select("y").collect()]))
    assert RG.intercept_quantile(planted, "y", 0.3) == ys[int(np.ceil(len(ys) * 0.3)) - 1]


def test_factor_effects_match_a_dense_fit(spark):
    """Two factors and two numeric columns: grouped sums against numpy on dense rows."""
    rng = np.random.default_rng(3)
    n = 3000
    a, b = rng.choice(["x", "y", "z"], n), rng.choice(["k", "l", "m", "n"], n)
    u, v = rng.normal(50, 3, n), rng.uniform(0, 1, n)
    y = 2 + 0.5 * u - v + (a == "y") * 1.5 - (a == "z") * 2 + (b == "m") * 0.7 + rng.normal(0, 0.3, n)
    df = spark.createDataFrame(list(zip(y.tolist(), u.tolist(), a.tolist(), v.tolist(), b.tolist())), "y double, u double, a string, v double, b string")
    got = RG.ols(df, "y", ["u", "a", "v", "b"]).collect()
    assert [r.term for r in got] == ["(Intercept)", "u", "ay", "az", "v", "bl", "bm", "bn"]
    X = np.column_stack([np.ones(n), u, a == "y", a == "z", v, b == "l", b == "m", b == "n"]).astype(float)
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss[0] / (n - 8))
    np.testing.assert_allclose([r.estimate for r in got], beta, rtol=1e-9)
    np.testing.assert_allclose([r.std_error for r in got], se, rtol=1e-8)
    h = RG.ols_diagnostics(df, "y", ["u", "a", "v", "b"]).toPandas()
    assert h["leverage"].sum() == pytest.approx(8) and h["std_residual"].std() == pytest.approx(1, abs=0.02)
    f = RG.quantile_regression(df, "y", ["u", "a", "v", "b"], 0.5)
    assert f["status"] == "optimal" and f["coef"]["az"] == pytest.approx(-2, abs=0.1)
    seen = RG.quantile_predict(f, ["u", "a", "v", "b"], df).where("y < fitted").count()
    assert seen == pytest.approx(n / 2, abs=20)


def test_off_centre_and_degenerate_fits(spark):
    rows = [(float(3 * i + (i % 2)), 1e8 + i, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "y double, x double, i double")
    t = {r.term: r for r in RG.ols(df, "y", ["x"]).collect()}
    assert not t["x"].aliased and t["x"].estimate == pytest.approx(np.polyfit([r[2] for r in rows], [r[0] for r in rows], 1)[0], rel=1e-9)
    assert RG.aliased_columns(df, ["x", "i"], "y") == ["i"]
    two = RG.ols(df.limit(2), "y", ["x"]).collect()  # no residual degrees of freedom
    assert all(r.estimate is not None and r.std_error is None and r.p_value is None and r.r2_adj is None for r in two)
    flat = RG.ols(df.withColumn("y", F.lit(4.0)), "y", ["x"]).collect()
    assert all(r.r2 is None for r in flat) and flat[1].estimate == 0
    none = RG.ols(df.limit(0), "y", ["x"]).collect()
    assert all(r.estimate is None for r in none)
    assert RG.quantile_regression(df.limit(0), "y", ["x"], 0.5)["status"] == "no complete rows"


def test_hinge_models_take_factors(spark):
    rng = np.random.default_rng(8)
    c, x = rng.choice(["p", "q", "r"], 2000), rng.uniform(0, 1, 2000)
    y = 1 + 2.0 * (c == "q") + 3 * np.maximum(x - 0.5, 0) + rng.normal(0, 0.05, 2000)
    df = spark.createDataFrame(list(zip(y.tolist(), c.tolist(), x.tolist())), "y double, c string, x double")
    kept, coef, imp, _ = HG.mars(df, "y", ["c", "x"], degree=1, n_knots=9)
    effects = {HG.term_label(t): float(b) for t, b in zip(kept, coef[:, 0])}
    assert effects["h(cq-0)"] == pytest.approx(2, abs=0.05)
    assert {r[0] for r in imp if r[1]} == {"cq", "x"}
    assert HG.mars_predict(df, kept, coef).where("abs(y - fitted) > 0.5").count() < 20


def test_out_of_bag_votes_recounted(spark):
    """Votes come only from trees whose bootstrap left the row out; weights are Poisson(1) and reproducible."""
    from retailforge.operators import classify as CL
    rng = np.random.default_rng(2)
    rows = [(float(x), "a" if (x > 0.5) != (rng.uniform() < 0.1) else "b") for x in rng.uniform(0, 1, 400)]
    df = spark.createDataFrame(rows, "x double, c string").repartition(3)
    votes, error = CL.oob_forest(df, "c", ["x"], [], num_trees=6, mtry="all", max_depth=3)
    ids = spark.range(400).withColumnRenamed("id", "__row")
    w = ids.select([CL.bootstrap_weight("__row", t, 1).alias(f"w{t}") for t in range(6)]).toPandas().to_numpy()
    assert w.mean() == pytest.approx(1, abs=0.08) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.03)
    v = votes.toPandas()
    assert len(v) == 400 and v["votes"].sum() > 0.25 * 6 * 400
    seen = v[v["votes"] > 0]
    e = error.first()
    assert e.n == len(seen) == int(seen["predicted"].notna().sum())
    assert e.oob_error == pytest.approx((seen["predicted"] != seen["c"]).mean()) and 0.04 < e.oob_error < 0.25


def test_permutation_keeps_the_values(spark):
    from retailforge.operators import classify as CL
    df = spark.range(500).select("id", (F.col("id") * 2).alias("x"), F.col("id").alias("y"))
    got = CL.permute_column(df, "x", "id").toPandas()
    assert sorted(got["x"]) == sorted(range(0, 1000, 2)) and len(got) == 500
    assert (got["x"] == 2 * got["y"]).sum() < 15 and CL.permute_column(df.repartition(5), "x", "id").toPandas().set_index("id")["x"].equals(
        got.set_index("id")["x"].reindex(CL.permute_column(df.repartition(5), "x", "id").toPandas()["id"]))


@pytest.mark.parametrize("sizes", [(700, 300, 900), (1, 256, 0)])
def test_hinge_candidates_equal_their_formula_batch_after_batch(sizes):
    rng = np.random.default_rng(3)
    cands = [(pi, x, float(t)) for pi in range(3) for x in ("a", "b") for t in rng.normal(size=4)]
    columns = HG.Candidates(["a", "b"], cands)
    for n in sizes:  # a later batch must not see rows of an earlier one
        B, X = rng.normal(size=(n, 3)), rng.normal(size=(n, 2))
        right, left = columns(B, X)
        assert right.shape == left.shape == (n, len(cands))
        for k, (pi, x, t) in enumerate(cands):
            v = X[:, "ab".index(x)]
            assert np.array_equal(right[:, k], B[:, pi] * np.maximum(v - t, 0)) and np.array_equal(left[:, k], B[:, pi] * np.maximum(t - v, 0))
