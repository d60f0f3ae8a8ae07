"""Hand-made edge frames (FIXTURES.md §4) for the cleaning, netting, RFM, binning and series operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailforge.functions import calendar as K
from retailforge.operators import cleaning as C
from retailforge.operators import netting as N
from retailforge.operators import rfm as R
from retailforge.operators import segments as SG

SCHEMA = ("InvoiceNo string, StockCode string, Description string, Quantity long, InvoiceDate timestamp, "
          "UnitPrice double, CustomerID long, Country string")
T = dt.datetime(2011, 1, 5, 10, 0, 0)


def lines(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_cleaning_filters(spark):
    df = lines(spark, [
        ("A563185", "B", "Adjust bad debt", 1, T, 11062.06, None, "UK"),
        ("C536379", "D", "Discount", -1, T, 27.5, 14527, "UK"),
        ("536365", "85123A", "WHITE HANGER", 6, T, 2.55, 17850, "UK"),
        ("536366", "22633", "HAND WARMER", 0, T, 1.85, 17850, "UK"),
        ("536367", "22634", "HAND WARMER RED", 3, T, 0.0, None, "UK"),
    ])
    assert [r[0] for r in C.invalid_codes(df).collect()] == ["A563185", "C536379"]
    kept = C.drop_adjustments(df)
    assert kept.where(F.col("InvoiceNo") == "A563185").count() == 0
    assert C.drop_stock_upkeep(kept).where(F.col("InvoiceNo") == "536366").count() == 0
    assert C.drop_untrackable(kept).where(F.col("InvoiceNo") == "536367").count() == 0


def test_impute_price_reference_ratio(spark):
    df = lines(spark, [
        ("1", "11111", "MUG", 2, T, 3.0, 1, "UK"),
        ("2", "11111", "MUG", 4, T, 5.0, 2, "UK"),
        ("3", "11111", "MUG", 1, T, 0.0, 3, "UK"),
        ("4", "22222", "CUP", 1, T, 0.0, 3, "UK"),
    ])
    out = {r.InvoiceNo: r.UnitPrice for r in C.impute_price(df).collect()}
    assert out["3"] == pytest.approx((3.0 + 5.0) / (2 + 4))
    assert out["4"] is None  # unknown product: NULL, as the reference's NaN


def test_product_variations_and_lengths(spark):
    df = lines(spark, [
        ("1", "84029E", "RED WARMER", 1, T, 1.0, 1, "UK"),
        ("2", "84029G", "BLUE WARMER", 1, T, 1.0, 1, "UK"),
        ("3", "84029G", "BLUE WARMER", 1, T, 1.0, 1, "UK"),
        ("4", "85123", "HANGER", 1, T, 1.0, 1, "UK"),
        ("5", "POST", "POSTAGE", 1, T, 1.0, 1, "UK"),
        ("6", "1234567", "LONG", 1, T, 1.0, 1, "UK"),
    ])
    pv = {r.InvoiceNo: r.ProductVariations for r in C.product_variations(df).collect()}
    assert pv == {"1": 2, "2": 2, "3": 2, "4": 1, "5": 1, "6": 1}
    assert {r.InvoiceNo for r in C.drop_nonproduct(df).collect()} == {"1", "2", "3", "4", "6"}


def test_netting(spark):
    df = lines(spark, [
        ("C900", "11111", "MUG", -2, T, 1.0, 7, "UK"),        # matched
        ("C900", "33333", "PLATE", -1, T, 1.0, 7, "UK"),      # unmatched -> whole C900 dropped
        ("C901", "22222", "CUP", -5, T, 1.0, 7, "UK"),        # cancel larger than order
        ("100", "11111", "MUG", 3, T, 1.0, 7, "UK"),
        ("101", "22222", "CUP", 2, T, 1.0, 7, "UK"),
        ("C902", "44444", "BOWL", -1, T, 1.0, 8, "UK"),       # 2 cancels x 2 orders of one key
        ("C903", "44444", "BOWL", -1, T, 1.0, 8, "UK"),
        ("102", "44444", "BOWL", 2, T, 1.0, 8, "UK"),
        ("103", "44444", "BOWL", 3, T + dt.timedelta(days=1), 1.0, 8, "UK"),
    ])
    assert [r[0] for r in N.unmatched_cancel_invoices(df).collect()] == ["C900"]
    out = {(r.InvoiceNo, r.Quantity, r.OrderDetails) for r in N.cancellation_netting(df).collect()}
    # 100: its cancel invoice was dropped whole; 101: 2 - 5 <= 0; 102: 2 - 1 - 1 <= 0; 103 keeps its own line: 3 - 1 - 1
    assert out == {("100", 3, "11111|7"), ("103", 1, None)}


def test_netting_keeps_every_order_line(spark):
    """One cancel of a key with two order lines at different prices: both lines stay at their own price."""
    df = lines(spark, [
        ("C900", "11111", "MUG", -1, T, 1.0, 7, "UK"),
        ("100", "11111", "MUG", 10, T, 1.0, 7, "UK"),
        ("101", "11111", "MUG", 20, T + dt.timedelta(days=1), 9.0, 7, "UK"),
    ])
    assert sorted((r.InvoiceNo, r.Quantity, r.UnitPrice) for r in N.cancellation_netting(df).collect()) == [("100", 9, 1.0), ("101", 19, 9.0)]


def test_seeded_hash_draws_are_independent(spark):
    """Two seeds overlap in about f * f of the rows, and counts per block spread as a random draw's do."""
    from retailforge.operators.sampling import seeded_hash
    d = spark.range(100_000).select("id", (seeded_hash("id", 1) < 0.5 * 2 ** 32).cast("int").alias("a"),
                                    (seeded_hash("id", 2) < 0.5 * 2 ** 32).cast("int").alias("b"))
    both, a = d.agg(F.avg(F.col("a") * F.col("b")), F.avg("a")).first()
    assert abs(both - 0.25) < 0.01 and abs(a - 0.5) < 0.01
    blocks = [r[1] for r in d.groupBy((F.col("id") / 100).cast("long")).agg(F.sum("a")).collect()]
    assert 4.0 < np.std(blocks) < 6.0


def test_rfm_single_customer_and_inversion(spark):
    df = lines(spark, [
        ("1", "11111", "MUG", 2, dt.datetime(2011, 1, 31, 23, 59, 59), 3.0, 1, "UK"),
        ("2", "11111", "MUG", 1, dt.datetime(2011, 1, 1), 3.0, 1, "UK"),
    ])
    t = R.rfm(df, "InvoiceDate", "CustomerID", "UnitPrice", "Quantity", attach=False).first()
    assert t.RECENCY == 0.0            # min recency 0 <= 1: no inversion
    assert t.FREQUENCY == 2 and t.MONEY == 9.0
    assert t.RECENCY_normalised is None  # max = min
    df2 = lines(spark, [
        ("1", "1", "A", 1, dt.datetime(2011, 1, 1), 1.0, 1, "UK"),
        ("2", "1", "A", 1, dt.datetime(2011, 1, 11), 1.0, 2, "UK"),
    ])
    r = {x.CustomerID: x for x in R.rfm(df2, "InvoiceDate", "CustomerID", "UnitPrice", "Quantity",
                                         attach=False).collect()}
    close = 20 + (86399 / 86400)               # days from Jan 11 00:00 to Jan 31 23:59:59
    assert r[2].RECENCY == pytest.approx(1 / close)
    assert r[2].RECENCY_normalised == pytest.approx(5.0) and r[1].RECENCY_normalised == pytest.approx(1.0)


def test_bins_and_argmax(spark):
    df = spark.createDataFrame([(d, h, s) for d, h, s in zip(
        [1, 10, 11, 20, 21, 31, 5, 5], [0, 6, 7, 12, 13, 18, 19, 23],
        [1.4, 1.41, 2.4, 3.4, 4.4, 4.41, 0.2, 3.0])], "d int, h int, s double")
    rows = df.select(K.month_period("d").alias("mp"), K.day_period("h").alias("dp"),
                     K.score_bin("s").alias("sb")).collect()
    assert [r.mp for r in rows][:6] == ["Beginning of Month", "Beginning of Month", "Middle of Month",
                                        "Middle of Month", "End of Month", "End of Month"]
    assert [r.dp for r in rows] == ["Midnight", "Midnight", "Morning", "Morning", "Afternoon", "Afternoon",
                                    "Evening", "Evening"]
    assert [r.sb for r in rows] == [1, 2, 2, 3, 4, 5, 1, 3]
    sc = spark.createDataFrame([(3, 1, 1), (2, 2, 1), (1, 1, 1), (0, 5, 4)], "a int, b int, c int")
    labs = [r[0] for r in sc.select(K.argmax_label({"1": "a", "2": "b", "3": "c"})).collect()]
    assert labs == ["1", "NA", "NA", "2"]


def test_optimal_1d_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vals = np.r_[rng.normal(1, .2, 40), rng.normal(5, .5, 25), rng.normal(12, 1, 10)].round(3)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    bounds = SG.optimal_1d_bounds(df, "v", 3)
    xs = np.sort(np.unique(vals))
    w = np.array([np.sum(vals == x) for x in xs])

    def ss(a, b):
        x, ww = xs[a:b], w[a:b]
        m = np.average(x, weights=ww)
        return float(np.sum(ww * (x - m) ** 2))
    best = min(((ss(0, i) + ss(i, j) + ss(j, len(xs)), i, j) for i in range(1, len(xs) - 1)
                for j in range(i + 1, len(xs))))
    assert bounds == [xs[best[1] - 1], xs[best[2] - 1]]
    # fewer distinct values than k
    few = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double")
    assert SG.optimal_1d_bounds(few, "v", 3) == [1.0]
    assert SG.optimal_1d_bounds(few.limit(0), "v", 3) == []


@pytest.mark.parametrize("n, k", [(10, 3), (3_000, 4), (200_000, 3)])
def test_optimal_1d_is_one_method_at_every_size(spark, n, k):
    """Skewed values of any number: the cuts cost what the full dynamic program over all values finds."""
    x = np.sort(np.random.default_rng(n).lognormal(0, 1, n))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    bounds, total = SG.optimal_1d_solution(df, "v", k)
    d = x - x.mean()
    s, q = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])

    def ss(a, b):
        return q[b] - q[a] - (s[b] - s[a]) ** 2 / np.maximum(b - a, 1)
    at = [0, *np.searchsorted(x, bounds, "right").tolist(), n]
    assert abs(sum(ss(a, b) for a, b in zip(at, at[1:])) - total) < 1e-6 * max(total, 1)
    if n <= 3_000:
        f = np.array([ss(0, b) for b in range(n + 1)])
        for _ in range(k - 1):
            f = np.array([np.min(f[:b] + ss(np.arange(b), b)) if b else np.inf for b in range(n + 1)])
        assert abs(f[n] - total) < 1e-9 * max(total, 1)
    for i in range(1, k):  # no cut improves by moving to a neighbour
        for step in (-1, 1):
            c = at[i] + step
            if at[i - 1] < c < at[i + 1]:
                assert ss(at[i - 1], c) + ss(c, at[i + 1]) >= ss(at[i - 1], at[i]) + ss(at[i], at[i + 1]) - 1e-7


def test_sequential_index_is_a_permutation(spark):
    from retailforge.functions.ordering import sequential_index
    df = spark.range(0, 5003).selectExpr("(id * 7919) % 5003 AS k").repartition(6)
    got = sorted((r.k, r.idx) for r in sequential_index(df, ["k"]).collect())
    assert got == [(i, i) for i in range(5003)]


def test_no_silent_local_stage_folder():
    """Off a local master a missing spark.checkpoint.dir raises instead of staging on one machine's disk."""
    from retailforge.session import checkpoint_dir, is_local
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[3,2,1000]") and not is_local("yarn")

    class Ctx:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, k, d=None):
            return d

    class Session:
        sparkContext, conf = Ctx(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_workers_import_the_package_from_anywhere(tmp_path):
    """A driver outside the repository folder, without PYTHONPATH: grouped Python functions still run."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from retailforge.session import get_spark\n"
            "from retailforge.operators import smoothing as SM\n"
            "s = get_spark('local[2]', shuffle_partitions=2)\n"
            "d = s.createDataFrame([('a', t, float(10 + t % 3)) for t in range(1, 20)], 'k string, t int, value double')\n"
            "print('ROWS', SM.arima_forecasts(d, ['k'], h=3, order=(0, 0, 1)).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 3" in out.stdout, out.stderr[-2000:]


def test_auto_arima_keeps_every_series(spark):
    """Constant, one-point and gap series get a status row instead of vanishing or failing the job."""
    from retailforge.operators import smoothing as SM
    rng = np.random.default_rng(4)
    x = 50 + np.convolve(rng.normal(0, 1, 21), [1, 0.6])[1:21]
    rows = [("ok", t + 1, float(v)) for t, v in enumerate(x)] + [("constant", t, 7.0) for t in range(1, 16)]
    rows += [("one", 1, 3.0)] + [("gap", t, None if t == 4 else float(t % 5)) for t in range(1, 16)]
    got = {}
    for r in SM.auto_arima_forecasts(spark.createDataFrame(rows, "k string, t int, value double"), ["k"], h=2, max_p=1, max_q=1).collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == {"ok", "constant", "one", "gap"}
    assert len(got["ok"]) == 2 and got["ok"][0].point is not None and "(" in got["ok"][0].order
    assert got["one"][0].order == "no admissible model" and got["gap"][0].order == "no admissible model"


def test_every_series_fit_reports_a_status(spark):
    """Constant, zero, one-point and gap series survive all fits; good ones are not disturbed."""
    from retailforge.operators import smoothing as SM
    rows = [("flat", i + 1, 4.0) for i in range(30)] + [("zero", i + 1, 0.0) for i in range(30)] + [("one", 1, 2.0)]
    rows += [("gap", i + 1, None if i in (4, 9) else float(5 + i * i % 7)) for i in range(30)] + [("good", i + 1, float(5 + i * i % 7 + i % 12)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, t int, value double")
    status = {f.__name__: {r.k: r.status for r in f(df, ["k"]).select("k", "status").distinct().collect()}
              for f in (SM.ses, SM.holt, SM.holt_winters, SM.arima_forecasts, SM.arima_fitted)}
    for name, got in status.items():
        assert set(got) == {"flat", "zero", "one", "gap", "good"} and got["good"] == "ok" and got["gap"] == "missing values", name
    assert status["ses"]["flat"] == status["holt"]["zero"] == "ok" and status["holt"]["one"] == "fewer than 2 months"
    assert status["arima_forecasts"]["flat"] == status["arima_fitted"]["zero"] == "constant series"
    assert "zeros" in status["holt_winters"]["zero"] and status["holt_winters"]["flat"] == "ok"
    path = SM.smoothing_path(df, SM.ses(df, ["k"], steps=10), ["k"])
    assert {r.k: r.n for r in path.groupBy("k").agg(F.count("*").alias("n")).collect()} == {"flat": 30, "zero": 30, "one": 1, "good": 30}
    bounds = SM.smoothing_bounds(df, SM.ses(df, ["k"], steps=10), ["k"], 2).where("k = 'one'").collect()
    assert all(r.point == 2.0 and r.lo80 is None for r in bounds)


def test_monthly_clv_counts_lines_without_a_customer(spark):
    from retailforge.operators.aggregates import monthly_clv
    df = spark.createDataFrame([("2011-01-03", 10.0, 1, 2), ("2011-01-09", 7.0, None, 3), ("2011-02-01", 4.0, None, 1)],
                               "ts string, rev double, c int, q int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.MnthYr: (r.total_Rev, r.total_Pur, r.total_Cust) for r in monthly_clv(df, "ts", "rev", "c", "q").collect()}
    assert got == {"2011-01": (17.0, 5, 1), "2011-02": (4.0, 1, 0)}


def test_split_and_balance_select_by_rank(spark):
    """Against a sort on the driver; NULL classes, one row, empty tables."""
    from retailforge.operators import sampling as SP
    df = spark.range(300).select("id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.lit("b")).alias("c"))
    rows = df.withColumn("h", SP.seeded_hash("id", 3)).collect()
    first = {r.id for r in sorted(rows, key=lambda r: (r.h, r.id))[:210]}
    assert {r.id for r in SP.train_test_split(df, "id", 0.7).where("set = 'train'").collect()} == first
    want = {r.id for c in ("a", "b", None) for r in sorted((r for r in rows if r.c == c), key=lambda r: (r.h, r.id))[:43]}
    assert {r.id for r in SP.balance_classes(df, "c", "id").collect()} == want
    assert SP.train_test_split(df.limit(0), "id").count() == 0 and SP.balance_classes(df.limit(0), "c", "id").count() == 0
    assert [r["set"] for r in SP.train_test_split(df.limit(1), "id").collect()] == ["test"]


def test_schema_report(spark):
    from retailforge.operators.aggregates import schema_report
    df = spark.createDataFrame([(1, None, "x"), (2, 3.5, None)], "a int, `b.c` double, a string")
    got = [tuple(r) for r in schema_report(df).orderBy("position").collect()]
    assert got == [(0, "a", "int", 2, 0), (1, "b.c", "double", 2, 1), (2, "a", "string", 2, 1)]
    empty = schema_report(df.toDF("a", "b", "c").limit(0)).collect()
    assert [(r["type"], r.n_rows, r.n_null) for r in empty] == [("int", 0, 0), ("double", 0, 0), ("string", 0, 0)]


def test_accuracy_by_set(spark):
    """Against plain arithmetic; zero values, series shorter than the lag and one-row sets give NULL, no failure."""
    from retailforge.operators.series import accuracy_by_set
    y = [3.0, 5.0, 4.0, 8.0, 6.0, 9.0, 7.0]
    f = [None, 3.0, 4.5, 4.0, 7.0, 6.5, 6.5]
    rows = [("a", "train" if t < 5 else "test", t + 1, y[t], f[t]) for t in range(7)]
    rows += [("z", "train", 1, 0.0, None), ("z", "train", 2, 0.0, 0.0), ("z", "test", 3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, set string, t int, value double, forecast double")
    got = {(r.k, r.set): r for r in accuracy_by_set(df, ["k"], {"MASE": 1, "MASE_2": 2}).collect()}
    train, test = got["a", "train"], got["a", "test"]
    e = [y[t] - f[t] for t in range(1, 5)]
    one = sum(abs(y[t] - y[t - 1]) for t in range(1, 5)) / 4
    two = sum(abs(y[t] - y[t - 2]) for t in range(2, 5)) / 3
    mae = sum(map(abs, e)) / 4
    m = sum(e) / 4
    acf1 = sum((a - m) * (b - m) for a, b in zip(e, e[1:])) / sum((a - m) ** 2 for a in e)
    assert train.n == 4 and abs(train.ME - m) < 1e-12 and abs(train.MAE - mae) < 1e-12 and abs(train.ACF1 - acf1) < 1e-12
    assert abs(train.MASE - mae / one) < 1e-12 and abs(train.MASE_2 - mae / two) < 1e-12 and train.TheilU is None
    assert test.n == 2 and abs(test.MASE - (2.5 + 0.5) / 2 / one) < 1e-12
    assert abs(test.TheilU - abs((6.5 - 7) / 9) / abs((7 - 9) / 9)) < 1e-12
    zero = got["z", "test"]
    assert zero.RMSE == 0 and zero.MAPE is None and zero.MASE is None and zero.MASE_2 is None and zero.TheilU is None
