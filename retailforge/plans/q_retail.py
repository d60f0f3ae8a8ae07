"""Queries over retail lines: profiling, cleaning, netting, RFM (6-31, 45-54, 126-127, 129)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailforge.functions.quantiles import exact_quantiles
from retailforge.operators import cleaning as C
from retailforge.operators import netting as N
from retailforge.operators import rfm as R
from retailforge.operators.aggregates import schema_report
from retailforge.plans.oracle_views import DIRTY_LINES, RETAIL_LINES, with_views
from retailforge.plans.pipelines import clean_retail, fmt_ts
from retailforge.plans.registry import query
from retailforge.sources.views import dirty_lines, retail_lines

W = with_views(RETAIL_LINES)
#: lines with faults, for the operators that find nothing to do in the given tables
WD = with_views(DIRTY_LINES)
TS = "strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate"
LINE_COLS_SQL = f"InvoiceNo, StockCode, Description, Quantity, {TS}, UnitPrice, CustomerID, Country"

#: customers as text, so that lines without one look alike in both engines
DIRTY_COLS_SQL = LINE_COLS_SQL.replace("CustomerID", "coalesce(CAST(CustomerID AS VARCHAR), 'none') AS CustomerID")


def _dirty_out(df):
    return _lines_out(df).withColumn("CustomerID", F.coalesce(F.col("CustomerID").cast("string"), F.lit("none")))


def _lines_out(df):
    return df.withColumn("InvoiceDate", fmt_ts("InvoiceDate"))


@query("q_invalid_codes", f"""{W}
SELECT DISTINCT InvoiceNo FROM retail_lines WHERE NOT regexp_matches(InvoiceNo, '^[0-9]+$') ORDER BY InvoiceNo""")
def q_invalid_codes(spark, sf):
    return C.invalid_codes(retail_lines(spark, sf))


@query("q_drop_adjustments", f"""{WD}
SELECT {DIRTY_COLS_SQL} FROM dirty_lines
WHERE contains(InvoiceNo, 'C') OR regexp_matches(InvoiceNo, '^[0-9]+$')""")
def q_drop_adjustments(spark, sf):
    return _dirty_out(C.drop_adjustments(dirty_lines(spark, sf)))


@query("q_adjustment_match", f"""{W}
SELECT {LINE_COLS_SQL} FROM retail_lines
WHERE InvoiceNo IN (SELECT substr(InvoiceNo, 2) FROM retail_lines WHERE NOT regexp_matches(InvoiceNo, '^[0-9]+$'))""")
def q_adjustment_match(spark, sf):
    return _lines_out(C.stripped_code_matches(retail_lines(spark, sf)))


def _describe(df, cols):
    rows = []
    for c in cols:
        q = exact_quantiles(df, c, [0.25, 0.5, 0.75])
        stats = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                       F.min(F.col(c).cast("double")).alias("min"),
                       F.max(F.col(c).cast("double")).alias("max"))
        rows.append(stats.select(F.lit(c).alias("column"), "count", F.round("mean", 6).alias("mean"),
                                 F.round("std", 6).alias("std"), "min",
                                 F.round(F.lit(q[0.25]), 9).alias("p25"), F.round(F.lit(q[0.5]), 9).alias("p50"),
                                 F.round(F.lit(q[0.75]), 9).alias("p75"), "max"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def describe(df, cols):
    """Summary statistics with exact quartiles (9).

    The quartile search makes several passes; the projected columns are
    staged once so the passes scan a narrow parquet table, not the joins.
    """
    from retailforge.session import stage
    return _describe(stage(df.select(*cols), "describe"), cols)


@query("q_describe", f"""{W}
SELECT * FROM (
  SELECT 'Quantity' AS "column", count(Quantity) AS "count", round(avg(Quantity), 6) AS mean,
         round(stddev_samp(Quantity), 6) AS std, CAST(min(Quantity) AS DOUBLE) AS "min",
         round(quantile_cont(Quantity, 0.25), 9) AS p25, round(quantile_cont(Quantity, 0.5), 9) AS p50,
         round(quantile_cont(Quantity, 0.75), 9) AS p75, CAST(max(Quantity) AS DOUBLE) AS "max"
  FROM retail_lines
  UNION ALL
  SELECT 'UnitPrice', count(UnitPrice), round(avg(UnitPrice), 6), round(stddev_samp(UnitPrice), 6),
         min(UnitPrice), round(quantile_cont(UnitPrice, 0.25), 9), round(quantile_cont(UnitPrice, 0.5), 9),
         round(quantile_cont(UnitPrice, 0.75), 9), max(UnitPrice)
  FROM retail_lines)""")
def q_describe(spark, sf):
    return describe(retail_lines(spark, sf), ["Quantity", "UnitPrice"])


@query("q_nonpositive_qty", f"""{W}
SELECT {LINE_COLS_SQL} FROM retail_lines WHERE Quantity <= 0""")
def q_nonpositive_qty(spark, sf):
    return _lines_out(C.nonpositive_quantity(retail_lines(spark, sf)))


@query("q_drop_stock_upkeep", f"""{WD}
SELECT {DIRTY_COLS_SQL} FROM dirty_lines WHERE NOT (NOT contains(InvoiceNo, 'C') AND Quantity <= 0)""")
def q_drop_stock_upkeep(spark, sf):
    return _dirty_out(C.drop_stock_upkeep(dirty_lines(spark, sf)))


@query("q_distinct_values", f"""{W}
SELECT DISTINCT Country FROM retail_lines""")
def q_distinct_values(spark, sf):
    return retail_lines(spark, sf).select("Country").distinct()


@query("q_drop_untrackable", f"""{WD}
SELECT {DIRTY_COLS_SQL} FROM dirty_lines WHERE NOT (UnitPrice = 0 AND CustomerID IS NULL)""")
def q_drop_untrackable(spark, sf):
    return _dirty_out(C.drop_untrackable(dirty_lines(spark, sf)))


@query("q_impute_price", f"""{W},
priced AS (
  SELECT Description, CAST(sum(UnitPrice) / sum(Quantity) AS DOUBLE) AS AvgPrice
  FROM retail_lines WHERE NOT (UnitPrice = 0 OR InvoiceNo LIKE 'C%') AND Description IS NOT NULL GROUP BY Description),
zeroed AS (SELECT * FROM retail_lines WHERE UnitPrice = 0 OR InvoiceNo LIKE 'C%')
SELECT r.InvoiceNo, r.StockCode, r.Description, r.Quantity, strftime(r.InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
       round(p.AvgPrice, 9) AS UnitPrice, r.CustomerID, r.Country
FROM zeroed r LEFT JOIN priced p ON r.Description = p.Description""")
def q_impute_price(spark, sf):
    # The driver tables hold no zero prices; cancellation lines are zeroed here
    # so that the imputation path (aggregate + left join) does real work.
    df = retail_lines(spark, sf)
    df = df.where((F.col("UnitPrice") == 0) | F.col("InvoiceNo").startswith("C")).withColumn(
        "UnitPrice", F.when(F.col("InvoiceNo").startswith("C"), F.lit(0.0)).otherwise(F.col("UnitPrice"))) \
        .unionByName(df.where(~((F.col("UnitPrice") == 0) | F.col("InvoiceNo").startswith("C"))))
    out = C.impute_price(df)
    zero_rows = out.join(df.where(F.col("UnitPrice") == 0).select("InvoiceNo").distinct(), "InvoiceNo", "left_semi")
    return _lines_out(zero_rows).withColumn("UnitPrice", F.round("UnitPrice", 9))


@query("q_drop_null_customer", f"""{WD}
SELECT {LINE_COLS_SQL} FROM dirty_lines WHERE CustomerID IS NOT NULL""")
def q_drop_null_customer(spark, sf):
    return _lines_out(C.drop_null(dirty_lines(spark, sf), "CustomerID"))


@query("q_code_length_profile", f"""{W}
SELECT length(StockCode) AS code_length, count(*) AS n_lines, count(DISTINCT StockCode) AS n_codes
FROM retail_lines GROUP BY 1""")
def q_code_length_profile(spark, sf):
    return C.code_length_profile(retail_lines(spark, sf)).withColumn("code_length", F.col("code_length").cast("long"))


@query("q_drop_nonproduct", f"""{W}
SELECT {LINE_COLS_SQL} FROM retail_lines WHERE length(StockCode) >= 6""")
def q_drop_nonproduct(spark, sf):
    # min length 6 keeps the variant codes only, so the filter removes real rows here
    return _lines_out(C.drop_nonproduct(retail_lines(spark, sf), min_len=6))


@query("q_product_variations", f"""{W},
nv AS (SELECT substr(StockCode, 1, 5) AS base, count(DISTINCT Description) AS n
       FROM retail_lines WHERE length(StockCode) = 6 GROUP BY 1)
SELECT r.InvoiceNo, r.StockCode, r.Description, r.Quantity, strftime(r.InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
       r.UnitPrice, r.CustomerID, r.Country,
       CASE WHEN length(r.StockCode) = 6 THEN coalesce(nv.n, 1) ELSE 1 END AS ProductVariations
FROM retail_lines r LEFT JOIN nv ON length(r.StockCode) = 6 AND substr(r.StockCode, 1, 5) = nv.base""")
def q_product_variations(spark, sf):
    return _lines_out(C.product_variations(retail_lines(spark, sf)))


@query("q_variant_sets", f"""{W}
SELECT substr(StockCode, 1, 5) AS BaseCode, list_sort(list_distinct(list(Description))) AS Descriptions
FROM retail_lines WHERE length(StockCode) = 6 GROUP BY 1""")
def q_variant_sets(spark, sf):
    return C.variant_sets(retail_lines(spark, sf))


@query("q_contains_group_count", f"""{W}
SELECT StockCode, Description, count(InvoiceNo) AS InvoiceNo, count(Quantity) AS Quantity,
       count(InvoiceDate) AS InvoiceDate, count(UnitPrice) AS UnitPrice, count(CustomerID) AS CustomerID,
       count(Country) AS Country
FROM retail_lines WHERE contains(Description, 'plate') GROUP BY StockCode, Description""")
def q_contains_group_count(spark, sf):
    return C.contains_group_count(retail_lines(spark, sf), "plate")


@query("q_point_lookup", f"""{W}
SELECT {LINE_COLS_SQL} FROM retail_lines WHERE CustomerID = 7 AND StockCode = (SELECT min(StockCode) FROM retail_lines WHERE CustomerID = 7)
ORDER BY InvoiceNo""")
def q_point_lookup(spark, sf):
    """All lines of one customer and product: the first stock code that customer 7 has bought."""
    df = retail_lines(spark, sf).where(F.col("CustomerID") == 7)
    return _lines_out(df.where(F.col("StockCode") == df.select(F.min("StockCode")).scalar()).orderBy("InvoiceNo"))


@query("q_split_cancels", f"""{W}
SELECT CASE WHEN contains(InvoiceNo, 'C') THEN 'cancel' ELSE 'order' END AS side,
       count(*) AS n_lines, sum(Quantity) AS total_qty, count(DISTINCT InvoiceNo) AS n_invoices
FROM retail_lines GROUP BY 1""")
def q_split_cancels(spark, sf):
    cancels, orders = C.split_cancels(retail_lines(spark, sf))

    def summ(df, side):
        return df.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("Quantity").alias("total_qty"),
                      F.countDistinct("InvoiceNo").alias("n_invoices")).select(F.lit(side).alias("side"), "*")
    return summ(cancels, "cancel").unionByName(summ(orders, "order"))


@query("q_complete_cases", f"""{WD}
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE InvoiceNo IS NOT NULL AND StockCode IS NOT NULL AND Description IS NOT NULL
                          AND Quantity IS NOT NULL AND InvoiceDate IS NOT NULL AND UnitPrice IS NOT NULL
                          AND CustomerID IS NOT NULL AND Country IS NOT NULL) AS n_complete,
       sum(CASE WHEN CustomerID IS NULL THEN 1 ELSE 0 END) AS null_CustomerID,
       sum(CASE WHEN Description IS NULL THEN 1 ELSE 0 END) AS null_Description
FROM dirty_lines""")
def q_complete_cases(spark, sf):
    from retailforge.session import stage
    lines = dirty_lines(spark, sf)
    # the counts ask of every value only whether it is there; several read the table, the joins run once
    df = stage(lines.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(True)).alias(c) for c in lines.columns]), "complete-cases")
    nulls = C.null_counts(df.select("CustomerID", "Description"))
    complete = C.drop_null(df).agg(F.count(F.lit(1)).alias("n_complete"))
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    # three one-row frames: combine as scalars (no cross join)
    return total.select("n_rows", complete.scalar().alias("n_complete"),
                        nulls.select("CustomerID").scalar().alias("null_CustomerID"),
                        nulls.select("Description").scalar().alias("null_Description"))


@query("q_unmatched_cancels", f"""{W},
cancels AS (SELECT * FROM retail_lines WHERE contains(InvoiceNo, 'C')),
orders_ AS (SELECT * FROM retail_lines WHERE NOT contains(InvoiceNo, 'C'))
SELECT DISTINCT c.InvoiceNo FROM cancels c
WHERE NOT EXISTS (SELECT 1 FROM orders_ o WHERE o.StockCode = c.StockCode AND o.CustomerID = c.CustomerID)""")
def q_unmatched_cancels(spark, sf):
    return N.unmatched_cancel_invoices(retail_lines(spark, sf))


NETTING_SQL = """
nc AS (
  SELECT * FROM {src}
  WHERE InvoiceNo NOT IN (
    SELECT DISTINCT c.InvoiceNo FROM {src} c
    WHERE contains(c.InvoiceNo, 'C') AND NOT EXISTS (
      SELECT 1 FROM {src} o WHERE NOT contains(o.InvoiceNo, 'C')
        AND o.StockCode = c.StockCode AND o.CustomerID = c.CustomerID))),
keys AS (SELECT StockCode, CustomerID, sum(Quantity) AS cancelled FROM nc WHERE contains(InvoiceNo, 'C') GROUP BY 1, 2),
netting AS (
  SELECT nc.* REPLACE (CAST(CASE WHEN k.cancelled IS NULL THEN nc.Quantity ELSE nc.Quantity + k.cancelled END AS BIGINT) AS Quantity),
         CASE WHEN k.cancelled IS NULL THEN nc.StockCode || '|' || CAST(nc.CustomerID AS VARCHAR) END AS OrderDetails
  FROM nc LEFT JOIN keys k ON nc.StockCode = k.StockCode AND nc.CustomerID = k.CustomerID
  WHERE NOT contains(nc.InvoiceNo, 'C'))"""


def _netting_sql(src: str) -> str:
    return NETTING_SQL.format(src=src)


@query("q_cancellation_netting", f"""{W},{_netting_sql('retail_lines')}
SELECT InvoiceNo, StockCode, Description, Quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
       UnitPrice, CustomerID, Country, OrderDetails
FROM netting WHERE Quantity > 0""")
def q_cancellation_netting(spark, sf):
    return _lines_out(N.cancellation_netting(retail_lines(spark, sf)))


CLEAN_SQL = """
s1 AS (SELECT * FROM retail_lines WHERE contains(InvoiceNo, 'C') OR regexp_matches(InvoiceNo, '^[0-9]+$')),
s2 AS (SELECT * FROM s1 WHERE NOT (NOT contains(InvoiceNo, 'C') AND Quantity <= 0)),
s3 AS (SELECT * FROM s2 WHERE NOT (UnitPrice = 0 AND CustomerID IS NULL)),
pp AS (SELECT Description, CAST(sum(UnitPrice) / sum(Quantity) AS DOUBLE) AS AvgPrice FROM s3
       WHERE UnitPrice <> 0 AND Description IS NOT NULL GROUP BY 1),
s4 AS (SELECT s3.* REPLACE (CASE WHEN s3.UnitPrice = 0 THEN pp.AvgPrice ELSE s3.UnitPrice END AS UnitPrice)
       FROM s3 LEFT JOIN pp ON s3.UnitPrice = 0 AND s3.Description = pp.Description),
s5 AS (SELECT * FROM s4 WHERE CustomerID IS NOT NULL),
nv AS (SELECT substr(StockCode, 1, 5) AS base, count(DISTINCT Description) AS n FROM s5
       WHERE length(StockCode) = 6 GROUP BY 1),
s6 AS (SELECT s5.*, CASE WHEN length(s5.StockCode) = 6 THEN coalesce(nv.n, 1) ELSE 1 END AS ProductVariations
       FROM s5 LEFT JOIN nv ON length(s5.StockCode) = 6 AND substr(s5.StockCode, 1, 5) = nv.base),
s7 AS (SELECT * FROM s6 WHERE length(StockCode) >= 5),"""


@query("q_clean_retail", f"""{W},{CLEAN_SQL}{_netting_sql('s7')}
SELECT InvoiceNo, StockCode, Description, Quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
       UnitPrice, CustomerID, Country, ProductVariations, OrderDetails
FROM netting WHERE Quantity > 0""")
def q_clean_retail(spark, sf):
    return _lines_out(clean_retail(retail_lines(spark, sf)))


@query("q_clean_dirty_lines", f"""{WD},{CLEAN_SQL.replace("FROM retail_lines", "FROM dirty_lines")}{_netting_sql('s7')}
SELECT InvoiceNo, StockCode, Description, Quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
       round(UnitPrice, 9) AS UnitPrice, CustomerID, Country, ProductVariations, OrderDetails
FROM netting WHERE Quantity > 0""")
def q_clean_dirty_lines(spark, sf):
    """The cleaning pipeline on lines with faults: every step drops or repairs rows (126)."""
    return _lines_out(clean_retail(dirty_lines(spark, sf))).withColumn("UnitPrice", F.round("UnitPrice", 9))


def rfm_sql(src: str) -> str:
    """Per-customer RFM CTEs (``per``, ``ref``, ``raw``) over the line table ``src``."""
    return f"""
per AS (SELECT CustomerID, max(InvoiceDate) AS last, count(InvoiceDate) AS FREQUENCY,
               sum(UnitPrice * Quantity) AS MONEY
        FROM {src} WHERE CustomerID IS NOT NULL GROUP BY 1),
ref AS (SELECT CAST(last_day(max(InvoiceDate)) AS TIMESTAMP) + INTERVAL 86399 SECOND AS t FROM {src}),
raw AS (SELECT CustomerID, (epoch_us(ref.t) - epoch_us(per.last)) / 86400e6 AS RECENCY, FREQUENCY, MONEY
        FROM per, ref)"""


RFM_SQL = rfm_sql("retail_lines")


@query("q_rfm", f"""{W},{RFM_SQL}
SELECT CustomerID, RECENCY, FREQUENCY, round(MONEY, 4) AS MONEY FROM raw""")
def q_rfm(spark, sf):
    t = R.rfm_table(retail_lines(spark, sf), "InvoiceDate", "CustomerID", "UnitPrice", "Quantity")
    return t.withColumn("MONEY", F.round("MONEY", 4))


def rfm_norm_sql(src: str) -> str:
    """RFM CTEs plus recency inversion and 1-5 scaling (``normed``) over ``src``."""
    return rfm_sql(src) + """,
inv AS (SELECT CustomerID,
               CASE WHEN (SELECT min(RECENCY) FROM raw) > 1 THEN 1.0 / RECENCY ELSE RECENCY END AS RECENCY,
               FREQUENCY, MONEY FROM raw),
mm AS (SELECT min(RECENCY) AS r0, max(RECENCY) AS r1, min(FREQUENCY) AS f0, max(FREQUENCY) AS f1,
              min(MONEY) AS m0, max(MONEY) AS m1 FROM inv),
normed AS (
  SELECT CustomerID, RECENCY, FREQUENCY, MONEY,
         CASE WHEN r1 <> r0 THEN (RECENCY - r0) / (r1 - r0) * 4.0 + 1.0 END AS RECENCY_normalised,
         CASE WHEN f1 <> f0 THEN (FREQUENCY - f0) / (f1 - f0) * 4.0 + 1.0 END AS FREQUENCY_normalised,
         CASE WHEN m1 <> m0 THEN (MONEY - m0) / (m1 - m0) * 4.0 + 1.0 END AS MONEY_normalised
  FROM inv, mm)"""


RFM_NORM_SQL = rfm_norm_sql("retail_lines")


@query("q_rfm_normalised", f"""{W},{RFM_NORM_SQL}
SELECT CustomerID, round(RECENCY, 12) AS RECENCY, FREQUENCY, round(MONEY, 4) AS MONEY,
       round(RECENCY_normalised, 9) AS RECENCY_normalised, round(FREQUENCY_normalised, 9) AS FREQUENCY_normalised,
       round(MONEY_normalised, 9) AS MONEY_normalised
FROM normed""")
def q_rfm_normalised(spark, sf):
    t = R.rfm(retail_lines(spark, sf), "InvoiceDate", "CustomerID", "UnitPrice", "Quantity", attach=False)
    return t.select("CustomerID", F.round("RECENCY", 12).alias("RECENCY"), "FREQUENCY",
                    F.round("MONEY", 4).alias("MONEY"),
                    *[F.round(f"{c}_normalised", 9).alias(f"{c}_normalised") for c in ("RECENCY", "FREQUENCY", "MONEY")])


@query("q_clv_score", f"""{W},{RFM_NORM_SQL}
SELECT r.InvoiceNo, r.StockCode, r.CustomerID, round(n.FREQUENCY_normalised * n.MONEY_normalised * n.RECENCY_normalised, 9) AS clv
FROM retail_lines r LEFT JOIN normed n ON r.CustomerID = n.CustomerID""")
def q_clv_score(spark, sf):
    df = R.rfm(retail_lines(spark, sf), "InvoiceDate", "CustomerID", "UnitPrice", "Quantity", attach=True)
    return R.clv_score(df).select("InvoiceNo", "StockCode", "CustomerID", F.round("clv", 9).alias("clv"))


@query("q_clv_global", f"""{W}
SELECT round(sum(UnitPrice * Quantity), 4) AS total_revenue, count(InvoiceDate) AS total_orders,
       count(DISTINCT CustomerID) AS total_customers,
       round(sum(UnitPrice * Quantity) / count(InvoiceDate), 4) AS avg_order_value,
       round(count(InvoiceDate) / count(DISTINCT CustomerID), 9) AS purchase_frequency,
       round(sum(UnitPrice * Quantity) / count(InvoiceDate) * (count(InvoiceDate) / count(DISTINCT CustomerID)), 4) AS clv
FROM retail_lines""")
def q_clv_global(spark, sf):
    g = R.clv_global(retail_lines(spark, sf), "UnitPrice", "Quantity", "InvoiceDate", "CustomerID")
    return g.select(F.round("total_revenue", 4).alias("total_revenue"), "total_orders", "total_customers",
                    F.round("avg_order_value", 4).alias("avg_order_value"),
                    F.round("purchase_frequency", 9).alias("purchase_frequency"), F.round("clv", 4).alias("clv"))


@query("q_preview", f"""{W}
SELECT {LINE_COLS_SQL} FROM retail_lines ORDER BY InvoiceNo, StockCode, Quantity, UnitPrice LIMIT 5""")
def q_preview(spark, sf):
    """``head()`` after an explicit total sort (135)."""
    df = retail_lines(spark, sf).orderBy("InvoiceNo", "StockCode", "Quantity", "UnitPrice").limit(5)
    return _lines_out(df)


#: the view's columns with their Spark types, and a derived one that has NULLs
_SCHEMA = [("InvoiceNo", "string"), ("StockCode", "string"), ("Description", "string"), ("Quantity", "bigint"), ("InvoiceDate", "timestamp_ntz"),
           ("UnitPrice", "double"), ("CustomerID", "bigint"), ("Country", "string"), ("CancelCode", "string")]
_SCHEMA_SQL = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM lines"
    for i, (c, kind) in enumerate(_SCHEMA))


@query("q_schema_report", f"""{W},
lines AS (SELECT *, CASE WHEN InvoiceNo LIKE 'C%' THEN InvoiceNo END AS CancelCode FROM retail_lines)
{_SCHEMA_SQL}""")
def q_schema_report(spark, sf):
    """Type, rows and NULLs of every column; the derived code is NULL on lines that are no cancellation (134)."""
    df = retail_lines(spark, sf)
    return schema_report(df.withColumn("CancelCode", F.when(F.col("InvoiceNo").startswith("C"), F.col("InvoiceNo"))))
