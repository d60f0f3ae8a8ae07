"""Published results of the reference, copied as literals (source: its dashboard CSV exports).

ARIMA(0,0,1) with mean on the two monthly CLV series must reproduce the
published forecasts and bounds, from order lines on; the order search on the
first 45 months of the third series must find the published seasonal model and
its forecasts; baskets rebuilt from the published counts must give the
published seller rules.
"""

import numpy as np
import pytest

from retailforge.operators.arima import fit_arima, sigma2_of
from retailforge.operators.smoothing import auto_arima_forecasts
from retailforge.operators.tidlists import basket_rules
from retailforge.plans.forecasting import EXPORT_NAMES, forecast_clv, write_fitted, write_forecasts
from retailforge.operators.smoothing import arima_fitted

# Monthly CLV series exported by the reference (13 and 20 months).
UCI_CLV = [644.38178943513, 661.060121304753, 592.684653199642, 596.069865738661, 545.847322274219,
           632.668642334994, 612.889348268839, 622.722348198908, 661.92705289245, 740.79425798722,
           708.873449973679, 678.950491802481, 569.67535188216]
# Published 12-step forecast of the first series, first two rows
# (point, lo80, hi80, lo95, hi95).
UCI_FC1 = [607.168747770621, 545.432163526303, 668.90533201494, 512.750789960264, 701.586705580978]
UCI_FC2 = [633.875221899108, 568.351498857025, 699.398944941191, 533.665335111692, 734.085108686524]
# Fixed value: first published fitted value of the first series.
UCI_FITTED1 = 634.482480273628


def test_arima_ma1_reproduces_published_forecast():
    f = fit_arima(UCI_CLV, (0, 0, 1))
    fc = f.forecast(12)
    np.testing.assert_allclose(fc[0], UCI_FC1, rtol=1e-5)
    for row in fc[1:]:
        np.testing.assert_allclose(row, UCI_FC2, rtol=1e-5)
    assert UCI_CLV[0] - f.resid[0] == pytest.approx(UCI_FITTED1, rel=1e-6)


def test_sigma2_df_correction():
    f = fit_arima(UCI_CLV, (0, 0, 1))
    assert sigma2_of(f, True) == pytest.approx(sigma2_of(f) * f.n / (f.n - f.npar))


# First 45 months of the third monthly CLV series.
THIRD_CLV = [473.374419354839, 201.746548387097, 843.214825396825, 463.116116666667, 411.897471428571,
             503.990501694915, 522.013234375, 408.33797761194, 699.644834482759, 440.079256097561,
             606.878728461539, 492.461956692913, 645.248485714286, 331.550863414634, 444.886144927536,
             487.40011971831, 452.877440298507, 361.352, 470.158015873016, 596.472034375,
             503.450861788618, 406.906537037037, 546.716465517241, 499.355608888889, 389.676270833333,
             676.805837209302, 553.420388235294, 474.822474358974, 590.937284210526, 445.686688172043,
             433.575344827586, 404.410394252874, 379.93285739645, 651.153769230769, 505.756334117647,
             615.448589041096, 666.581682539683, 383.096103846154, 544.843704201681, 323.820116346154,
             359.854055357143, 430.754604464286, 453.636509803922, 614.000079207921, 452.935793814433]
# Its published 12-step forecast (point, lo80, hi80, lo95, hi95).
THIRD_FC = [[464.019972517389, 320.462541496383, 607.577403538395, 244.467828008325, 683.572117026453],
            [480.622284552038, 330.968247527781, 630.276321576295, 251.74618577101, 709.498383333066],
            [455.455947261062, 305.2847577266, 605.627136795523, 225.788931967763, 685.122962554361],
            [437.567081936072, 287.351118681619, 587.783045190525, 207.831591147134, 667.30257272501],
            [524.228803307934, 374.008957025113, 674.448649590755, 294.487373939577, 753.970232676291],
            [474.976289813649, 324.75610672299, 625.196472904308, 245.234345342155, 704.718234285143],
            [542.056800920627, 391.836588615405, 692.277013225848, 312.314811769315, 771.798790071939],
            [531.11251655146, 380.892301712178, 681.332731390743, 301.370523524637, 760.854509578284],
            [509.619067309985, 359.398852250899, 659.839282369071, 279.877073947, 739.361060672969],
            [502.679173730867, 352.458958652715, 652.899388809018, 272.937180338724, 732.42116712301],
            [454.05358521562, 303.833370135815, 604.273800295425, 224.311591820948, 683.795578610292],
            [502.891970753382, 352.671755673433, 653.112185833331, 273.14997735849, 732.633964148273]]


def test_order_search_finds_the_published_seasonal_model(spark):
    """Without being told the order; series without a model keep a row with a status."""
    rows = [("third", i + 1, v) for i, v in enumerate(THIRD_CLV)] + [("flat", i + 1, 4.0) for i in range(30)] + [("one", 1, 2.0)]
    rows += [("gap", i + 1, None if i == 4 else float(i * i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, t int, value double")
    got = auto_arima_forecasts(df, ["k"], h=12).toPandas()
    third = got[got.k == "third"].sort_values("step")
    assert set(third["order"]) == {"(1,0,0)(1,0,0)[12]"} and set(third["tried"]) == {12}
    np.testing.assert_allclose(third[["point", "lo80", "hi80", "lo95", "hi95"]].to_numpy(float), THIRD_FC, rtol=1e-4)
    assert dict(zip(got.k, got.status)) == {"third": "ok", "flat": "constant series", "one": "1 months are too few for a model", "gap": "missing values"}


# Second monthly CLV series (20 months from 2017-01), first fitted values, first two forecast rows.
SECOND_CLV = [149.014409340659, 140.102023959647, 139.749195959596, 149.239757521329, 137.542768378063, 135.659529067879,
              125.007174258475, 132.361669099757, 147.158854397635, 142.499736243747, 135.115836258952, 131.488290725882,
              130.807702009092, 125.826112067616, 135.823518599562, 143.701546407186, 143.352102663873, 142.048019475161,
              140.07486852985, 131.960806299213]
SECOND_FITTED = [139.571117336773, 142.740179575698, 136.485812861465, 139.969460141142, 143.553280410878, 134.31469568421,
                 138.774677325046]
SECOND_FC1 = [134.003683125782, 126.37893469696, 141.628431554604, 122.342636693118, 145.664729558447]
SECOND_FC2 = [137.961466797468, 129.037046560044, 146.885887034892, 124.312743859957, 151.610189734979]


@pytest.fixture(scope="module")
def clv_lines(spark):
    """One order line a month and series whose revenue is the published CLV (one purchase, one customer)."""
    months = {"first": [f"{2010 + (11 + i) // 12}-{(11 + i) % 12 + 1:02d}-15" for i in range(len(UCI_CLV))],
              "second": [f"{2017 + i // 12}-{i % 12 + 1:02d}-01" for i in range(len(SECOND_CLV))]}
    rows = [(k, m, "c", v) for k, x in (("first", UCI_CLV), ("second", SECOND_CLV)) for m, v in zip(months[k], x)]
    rows += [(None, f"2017-{i + 1:02d}-01", "c", 5.0) for i in range(6)] + [("second", None, "c", 1e9)]
    return spark.createDataFrame(rows, "series string, day string, customer string, revenue double").selectExpr(
        "series", "to_timestamp(day) as day", "customer", "revenue")


def test_published_forecasts_from_order_lines(clv_lines, tmp_path, spark):
    got = forecast_clv(clv_lines, "day", "revenue", "customer", ["series"])
    table = got.orderBy("series", "step").toPandas()
    for name, label, one, two in (("first", "Jan 2012", UCI_FC1, UCI_FC2), ("second", "Sep 2018", SECOND_FC1, SECOND_FC2)):
        part = table[table.series == name]
        assert len(part) == 12 and part.month.iloc[0] == label and set(part.status) == {"ok"}
        values = part[list(EXPORT_NAMES)].to_numpy(float)
        np.testing.assert_allclose(values[0], one, rtol=1e-5)
        np.testing.assert_allclose(values[1:], [two] * 11, rtol=1e-5)
    lost = table[table.series.isna()]
    assert len(lost) == 1 and lost.status.iloc[0] != "ok" and np.isnan(lost.point.iloc[0])
    write_forecasts(got, str(tmp_path / "fc"), ["series"])
    back = spark.read.option("header", True).csv(str(tmp_path / "fc")).where("series = 'second'").collect()
    assert back[0].asDict().keys() == {"_c0", "Point.Forecast", "Lo.80", "Hi.80", "Lo.95", "Hi.95", "series"}
    assert [r["_c0"] for r in back][:3] == ["Sep 2018", "Oct 2018", "Nov 2018"] and len(back) == 12


def test_published_fitted_values(spark, tmp_path):
    df = spark.createDataFrame([("second", i + 1, v) for i, v in enumerate(SECOND_CLV)], "series string, t int, value double")
    write_fitted(arima_fitted(df, ["series"]), str(tmp_path / "fit"), ["series"])
    back = spark.read.option("header", True).csv(str(tmp_path / "fit")).collect()
    assert [r["_c0"] for r in back] == [str(i + 1) for i in range(20)]
    np.testing.assert_allclose([float(r["x"]) for r in back][:7], SECOND_FITTED, rtol=1e-5)


@pytest.mark.parametrize("model", ["ses", "holt"])
def test_smoothed_clv_keeps_every_series(clv_lines, model):
    got = forecast_clv(clv_lines, "day", "revenue", "customer", ["series"], 3, model).toPandas()
    assert sorted(got.groupby("series", dropna=False).size()) == [3, 3, 3]


def test_forecast_without_keys_and_of_nothing(clv_lines):
    one = clv_lines.where("series = 'first'")
    got = forecast_clv(one, "day", "revenue", "customer", [], 2).orderBy("step").toPandas()
    assert list(got.month) == ["Jan 2012", "Feb 2012"]
    assert forecast_clv(one.limit(0), "day", "revenue", "customer", ["series"], 2, "ses").count() == 0


# The published seller rules (sellers named by letters): baskets with both, with the left one, with the
# right one; support, confidence, coverage, lift.
SELLER_BASKETS = 92844
SELLER_RULES = [
    ("a", "b", 5, 10, 216, 5.3853776226789e-05, 0.5, 0.000107707552453578, 214.916666666667),
    ("c", "d", 5, 17, 40, 5.3853776226789e-05, 0.294117647058824, 0.000183102839171083, 682.676470588235),
    ("d", "c", 5, 40, 17, 5.3853776226789e-05, 0.125, 0.000430830209814312, 682.676470588235),
    ("e", "f", 6, 50, 886, 6.46245314721468e-05, 0.12, 0.00053853776226789, 12.5748081264108),
    ("g", "b", 8, 45, 216, 8.61660419628624e-05, 0.177777777777778, 0.000484683986041101, 76.4148148148148),
    ("h", "i", 6, 68, 1384, 6.46245314721468e-05, 0.0882352941176471, 0.000732411356684331, 5.91916014960898),
    ("j", "k", 9, 84, 1744, 9.69367972082202e-05, 0.107142857142857, 0.000904743440610056, 5.70388269986894),
    ("l", "m", 8, 105, 1781, 8.61660419628624e-05, 0.0761904761904762, 0.00113092930076257, 3.97182963022379),
    ("n", "o", 5, 88, 149, 5.3853776226789e-05, 0.0568181818181818, 0.000947826461591487, 35.4042098840757),
    ("n", "p", 7, 88, 161, 7.53952867175046e-05, 0.0795454545454545, 0.000947826461591487, 45.8715415019763),
    ("n", "q", 10, 88, 189, 0.000107707552453578, 0.113636363636364, 0.000947826461591487, 55.8225108225108),
    ("q", "n", 10, 189, 88, 0.000107707552453578, 0.0529100529100529, 0.00203567274137263, 55.8225108225108),
    ("r", "s", 7, 140, 239, 7.53952867175046e-05, 0.05, 0.00150790573435009, 19.4234309623431),
    ("q", "s", 11, 189, 239, 0.000118478307698936, 0.0582010582010582, 0.00203567274137262, 22.6092847180713),
    ("t", "k", 13, 209, 1744, 0.000140019818189651, 0.062200956937799, 0.00225108784627978, 3.31134498046618)]


def test_published_seller_rules(spark):
    """Baskets with exactly the published pair and single counts give the 15 published rules and no other."""
    rows, basket, single = [], 0, {}
    pairs = {frozenset(r[:2]): r[2] for r in SELLER_RULES}
    for r in SELLER_RULES:
        single.update({r[0]: r[3], r[1]: r[4]})
    for pair, count in pairs.items():
        for _ in range(count):
            rows += [(basket, s) for s in sorted(pair)]
            basket += 1
            for s in pair:
                single[s] -= 1
    for s, count in single.items():
        rows += [(basket + i, s) for i in range(count)]
        basket += count
    df = spark.createDataFrame(rows, "basket long, seller string").unionByName(
        spark.range(basket, SELLER_BASKETS).selectExpr("id as basket", "concat('other', id) as seller"))
    got = {r["rules"]: r for r in basket_rules(df, "basket", "seller", 5e-5, 0.05).collect()}
    assert got.keys() == {"{%s} => {%s}" % r[:2] for r in SELLER_RULES}
    for a, b, count, _, _, *published in SELLER_RULES:
        r = got["{%s} => {%s}" % (a, b)]
        assert r["count"] == count
        assert [r["support"], r["confidence"], r["coverage"], r["lift"]] == pytest.approx(published, rel=1e-12)
