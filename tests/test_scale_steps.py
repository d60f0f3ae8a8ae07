"""Steps that were changed to scale: same results, and what made them large is gone."""

import numpy as np
from pyspark.sql import functions as F

from retailforge.llm import langid
from retailforge.operators import baskets as B
from retailforge.operators import regress as RG
from retailforge.operators.design import Design, Rows, coded, make_design
from retailforge.plans.pipelines import segment_customers


def test_basket_matrix_is_one_aggregate(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "z"), (3, None), (None, "b")]
    df = B.basket_matrix(spark.createDataFrame(rows, "basket long, item string"), "basket", "item", ["a", "b"])
    assert {tuple(r) for r in df.collect()} == {(1, 1, 1), (2, 0, 0), (3, 0, 0), (None, 0, 1)}
    assert "pivotfirst" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_segments_with_few_columns(spark):
    rows = [(str(500000 + i), f"{10000 + i % 5}", f"thing {i % 5}", 1 + i % 4, 1.0 + i % 7, i % 6) for i in range(60)]
    lines = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity long, UnitPrice double, CustomerID long")
    lines = lines.withColumn("InvoiceDate", F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(cast(CustomerID + Quantity as int))"))
    few, whole = segment_customers(lines, columns=["clv"]), segment_customers(lines)
    assert few.columns == ["clv", "cluster"]
    key = F.round("clv", 9)
    assert sorted(map(tuple, few.select(key, "cluster").collect())) == sorted(map(tuple, whole.select(key, "cluster").collect()))


def test_remembered_words_are_bounded():
    assert langid.MEMO <= 150_000 and langid.TOGETHER <= 2048


def test_quantile_fits_share_their_sums():
    """Residuals and cross-products of all fits at once, from runs of equal levels, against dense rows."""
    rng = np.random.default_rng(4)
    n, levels = 300, {"a": ["k", "l", "m"], "b": [False, True]}
    design = Design(["u", "a", "v", "b"], levels, {"u": 2.0, "v": -1.0, "y": 0.5}, n)
    raw, codes = rng.normal(size=(3, n)), np.stack([rng.integers(0, 3, n), rng.integers(0, 2, n)])
    rows = Rows(design, "y", raw, codes)  # also right where equal levels do not stand together
    z, (a, b) = raw - np.array([[2.0], [-1.0], [0.5]]), codes
    X = np.column_stack([np.ones(n), z[0], a == 1, a == 2, z[1], b == 1, z[2]]).astype(float)
    coef, w = rng.normal(size=(4, 6)), rng.uniform(size=(4, n))
    np.testing.assert_allclose(rows.residuals(coef), z[2] - coef @ X[:, :-1].T, rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(rows.gram(w), np.einsum("tn,ni,nj->tij", w, X, X), rtol=1e-10, atol=1e-12)


def test_quantile_passes_read_numbers(spark):
    """Every row once, as doubles and places of levels."""
    df = spark.range(5000).select((F.col("id") * 1.5).alias("y"), (F.col("id") % 7).alias("u"), F.concat(F.lit("p"), F.col("id") % 3).alias("a"))
    design = make_design(df, ["a", "u"], "y")
    numbers = coded(df, design, "y")
    assert numbers.dtypes == [("z0", "double"), ("z1", "double"), ("f0", "int")]
    assert sorted(map(tuple, numbers.collect())) == [(i % 7, i * 1.5, i % 3) for i in sorted(range(5000), key=lambda i: (i % 7, i * 1.5))]
    found, = RG._quantile_pass(numbers, design, "y", [(0.5, np.zeros(4), np.zeros(4))], 1e-3)
    assert np.allclose(found[0], _dense_gram(design), rtol=1e-9) and abs(found[1] - 0.5 * sum(abs(i * 1.5 - design.means["y"]) for i in range(5000))) < 1e-3
    assert found[2] == 2500


def _dense_gram(design):
    i = np.arange(5000)
    y = i * 1.5 - design.means["y"]
    X = np.column_stack([np.ones(5000), i % 3 == 1, i % 3 == 2, i % 7 - design.means["u"], y]).astype(float)
    return (X * (0.5 / np.maximum(np.abs(y), 1e-3))[:, None]).T @ X
