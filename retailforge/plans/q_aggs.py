"""Aggregation and scalar-function queries (42-62, 72-84, 136)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailforge.functions import calendar as K
from retailforge.functions import strings as S
from retailforge.operators import aggregates as A
from retailforge.plans.oracle_views import CLV_LINES, MERGED, RETAIL_LINES, with_views
from retailforge.plans.pipelines import marketplace_lines
from retailforge.plans.registry import query
from retailforge.sources.tables import read_table
from retailforge.sources.views import activity, clv_lines, retail_lines

WR = with_views(RETAIL_LINES)
WG = with_views(MERGED)
WC = with_views(CLV_LINES)


@query("q_monthly_revenue", f"""{WR}
SELECT strftime(InvoiceDate, '%Y-%m') AS MnthYr, round(sum(Quantity * UnitPrice), 4) AS total_Rev
FROM retail_lines GROUP BY 1""")
def q_monthly_revenue(spark, sf):
    df = retail_lines(spark, sf)
    m = A.monthly_clv(df, "InvoiceDate", F.col("Quantity") * F.col("UnitPrice"), "CustomerID", "Quantity")
    return m.select("MnthYr", F.round("total_Rev", 4).alias("total_Rev"))


@query("q_monthly_purchases", f"""{WG}
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS MnthYr, count(*) AS total_Pur FROM merged GROUP BY 1""")
def q_monthly_purchases(spark, sf):
    m = A.monthly_clv(marketplace_lines(spark, sf), "order_purchase_timestamp", "price", "customer_id")
    return m.select("MnthYr", "total_Pur")


@query("q_monthly_customers", f"""{WG}
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS MnthYr, count(DISTINCT customer_id) AS total_Cust
FROM merged GROUP BY 1""")
def q_monthly_customers(spark, sf):
    m = A.monthly_clv(marketplace_lines(spark, sf), "order_purchase_timestamp", "price", "customer_id")
    return m.select("MnthYr", "total_Cust")


def series_keys(df):
    """Two series families over the same lines: per nation and per market segment."""
    keys = F.explode(F.array(F.struct(F.lit("nation").alias("series_kind"), F.col("nation").alias("series_key")),
                             F.struct(F.lit("segment").alias("series_kind"), F.col("segment").alias("series_key"))))
    return df.select("*", keys.alias("__k")).select("*", "__k.series_kind", "__k.series_key").drop("__k")


CLV_SERIES_SQL = """
keyed AS (SELECT *, 'nation' AS series_kind, nation AS series_key FROM clv_lines
          UNION ALL SELECT *, 'segment', segment FROM clv_lines),
monthly AS (
  SELECT series_kind, series_key, strftime(order_ts, '%Y-%m') AS MnthYr,
         CAST(sum(CAST(revenue AS DECIMAL(24, 4))) AS DOUBLE) AS total_Rev,
         count(*) AS total_Pur, count(DISTINCT customer_id) AS total_Cust
  FROM keyed GROUP BY 1, 2, 3 HAVING strftime(order_ts, '%Y-%m') NOT IN ('2001-08')),
clv AS (SELECT *, total_Rev / total_Pur AS AVG_PUR_VAL, total_Pur / total_Cust AS AVG_PUR_FREQ,
               (total_Rev / total_Pur) * (total_Pur / total_Cust) AS total_CLV FROM monthly)"""

PARTIAL_MONTHS = ["2001-08"]


def monthly_clv_series(spark, sf):
    return A.monthly_clv(series_keys(clv_lines(spark, sf)), "order_ts", "revenue", "customer_id",
                         series=["series_kind", "series_key"], drop_months=PARTIAL_MONTHS, money_decimals=4)


@query("q_monthly_clv", f"""{WC},{CLV_SERIES_SQL}
SELECT series_kind, series_key, MnthYr, total_Rev, total_Pur, total_Cust, AVG_PUR_VAL, AVG_PUR_FREQ, total_CLV
FROM clv""")
def q_monthly_clv(spark, sf):
    m = monthly_clv_series(spark, sf)
    return m.select("series_kind", "series_key", "MnthYr", "total_Rev", "total_Pur", "total_Cust",
                    "AVG_PUR_VAL", "AVG_PUR_FREQ", "total_CLV")


CORR_COLS = ["review_score", "payment_installments", "payment_value", "price", "freight_value",
             "product_photos_qty"]


def _corr_sql():
    from itertools import combinations
    parts = [f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 9) AS corr FROM merged"
             for a, b in combinations(CORR_COLS, 2)]
    return "\nUNION ALL ".join(parts)


@query("q_correlation_matrix", f"""{WG}
{_corr_sql()}""")
def q_correlation_matrix(spark, sf):
    c = A.correlation_long(marketplace_lines(spark, sf), CORR_COLS)
    return c.withColumn("corr", F.round("corr", 9))


SCORE_SQL = """
catmean AS (SELECT product_category_name, avg(review_score) AS m FROM merged GROUP BY 1),
pred AS (
  SELECT g.order_id, g.order_item_id, g.review_score AS actual,
         CASE WHEN c.m <= 1.4 THEN 1 WHEN c.m <= 2.4 THEN 2 WHEN c.m <= 3.4 THEN 3 WHEN c.m <= 4.4 THEN 4
              WHEN c.m IS NOT NULL THEN 5 END AS predicted, c.m AS raw_prediction
  FROM merged g JOIN catmean c USING (product_category_name))"""


def category_mean_predictions(spark, sf):
    """Baseline review-score predictor: the mean score of the product's category, binned (81)."""
    g = marketplace_lines(spark, sf)
    means = g.groupBy("product_category_name").agg(F.avg("review_score").alias("raw_prediction"))
    return (g.join(means, "product_category_name")
             .select("order_id", "order_item_id", F.col("review_score").alias("actual"),
                     K.score_bin("raw_prediction").alias("predicted"), "raw_prediction"))


@query("q_score_bins", f"""{WG},{SCORE_SQL}
SELECT order_id, order_item_id, actual, predicted, round(raw_prediction, 9) AS raw_prediction FROM pred""")
def q_score_bins(spark, sf):
    return category_mean_predictions(spark, sf).withColumn("raw_prediction", F.round("raw_prediction", 9))


@query("q_confusion", f"""{WG},{SCORE_SQL}
SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2""")
def q_confusion(spark, sf):
    return A.confusion(category_mean_predictions(spark, sf), "actual", "predicted")


@query("q_accuracy", f"""{WG},{SCORE_SQL}
SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 12) AS accuracy, count(*) AS n FROM pred""")
def q_accuracy(spark, sf):
    a = A.accuracy(category_mean_predictions(spark, sf), "actual", "predicted")
    return a.withColumn("accuracy", F.round("accuracy", 12))


def brand_baskets(spark, sf):
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    p = read_table(spark, sf, "part", "p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("basket"),
                                                          F.col("p_brand").alias("item"))


BRAND_BASKETS_SQL = """
bb AS (SELECT DISTINCT l.l_orderkey AS basket, p.p_brand AS item
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


@query("q_item_frequency", f"""WITH {BRAND_BASKETS_SQL.strip()}
SELECT item, count(*) AS n_baskets, count(*) / (SELECT count(DISTINCT basket) FROM bb) AS support
FROM bb GROUP BY item ORDER BY n_baskets DESC, item LIMIT 10""")
def q_item_frequency(spark, sf):
    return A.item_frequency(brand_baskets(spark, sf), "basket", "item", top=10)


@query("q_description_tokens", f"""{WR}
SELECT token, count(*) AS n FROM (
  SELECT unnest(string_split_regex(trim(Description), '\\s+')) AS token
  FROM (SELECT DISTINCT Description FROM retail_lines WHERE Description IS NOT NULL))
WHERE token <> '' GROUP BY token""")
def q_description_tokens(spark, sf):
    return A.token_counts(retail_lines(spark, sf), "Description")


IMP_FEATURES = ["payment_installments", "payment_value", "price", "freight_value", "product_photos_qty"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _top3_sql():
    longs = "\nUNION ALL ".join(
        f"SELECT payment_type AS model, '{f}' AS term, abs(corr({f}, review_score)) AS importance "
        f"FROM merged GROUP BY payment_type" for f in IMP_FEATURES)
    cols = ", ".join(f"max(CASE WHEN model = '{s}' THEN term END) AS {s}" for s in SEGMENTS)
    return f""",
imp AS ({longs}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, term) AS rank FROM imp)
SELECT rank, {cols} FROM ranked WHERE rank <= 3 GROUP BY rank"""


@query("q_top3_importance", f"""{WG}{_top3_sql()}""")
def q_top3_importance(spark, sf):
    g = marketplace_lines(spark, sf)
    wide = g.groupBy(F.col("payment_type").alias("model")).agg(
        *[F.abs(F.corr(f, "review_score")).alias(f) for f in IMP_FEATURES])
    long = wide.select("model", F.explode(F.array(*[F.struct(F.lit(f).alias("term"), F.col(f).alias("importance"))
                                                    for f in IMP_FEATURES])).alias("t")).select("model", "t.*")
    top = A.top_n_per_group(long, "model", "importance", 3, "term")
    return A.pivot_wide(top, "rank", "model", "term", SEGMENTS).withColumn("rank", F.col("rank").cast("long"))


@query("q_string_features", f"""{WR}
SELECT InvoiceNo, StockCode, Description, regexp_matches(InvoiceNo, '^[0-9]+$') AS is_digits,
       contains(InvoiceNo, 'C') AS is_cancel, length(StockCode) AS code_length, substr(StockCode, 1, 5) AS base_code,
       lower(Description) AS desc_lower, upper(Description) AS desc_upper,
       split_part(Description, ' ', 1) AS first_word, starts_with(InvoiceNo, 'C') AS starts_c,
       CASE WHEN instr(Description, ' ') > 0
            THEN substr(Description, 1, instr(Description, ' ') - 1) || '_' || substr(Description, instr(Description, ' ') + 1)
            ELSE Description END AS desc_snake,
       Description || ' (' || StockCode AS product
FROM retail_lines""")
def q_string_features(spark, sf):
    from retailforge.operators.cleaning import is_cancel, is_digits
    df = retail_lines(spark, sf)
    return df.select("InvoiceNo", "StockCode", "Description", is_digits("InvoiceNo").alias("is_digits"),
                     is_cancel("InvoiceNo").alias("is_cancel"), F.length("StockCode").alias("code_length"),
                     F.substring("StockCode", 1, 5).alias("base_code"), F.lower("Description").alias("desc_lower"),
                     F.upper("Description").alias("desc_upper"), S.first_word("Description").alias("first_word"),
                     F.col("InvoiceNo").startswith("C").alias("starts_c"),
                     S.replace_first("Description", " ", "_").alias("desc_snake"),
                     S.retail_product_label().alias("product"))


@query("q_coarse_category", """
WITH cats AS (SELECT DISTINCT lower(p_type) || '_' || replace(p_name, ' ', '_') AS category FROM part)
SELECT CASE WHEN split_part(category, '_', 1) = 'fashio' THEN 'fashion' ELSE split_part(category, '_', 1) END AS coarse,
       count(*) AS n_categories
FROM cats GROUP BY 1""")
def q_coarse_category(spark, sf):
    p = read_table(spark, sf, "part", "p_type", "p_name")
    cats = p.select(F.concat(F.lower("p_type"), F.lit("_"), F.regexp_replace("p_name", " ", "_")).alias("category")) \
            .distinct()
    return cats.groupBy(S.coarse_category("category").alias("coarse")).agg(F.count(F.lit(1)).alias("n_categories"))


@query("q_product_label", f"""{WG}
SELECT DISTINCT product_category_name_english || '/' || CAST(seller_id AS VARCHAR) || ' (' || CAST(product_id AS VARCHAR) || ')' AS label
FROM merged""")
def q_product_label(spark, sf):
    return marketplace_lines(spark, sf).select(S.marketplace_product_label().alias("label")).distinct()


@query("q_calendar_features", """
SELECT event_id, strftime(ts, '%Y-%m') AS MnthYr, strftime(ts, '%y/') || '0' || CAST(quarter(ts) AS VARCHAR) AS year_quarter,
       dayname(ts) AS ts_DayofWeek, dayofmonth(ts) AS ts_DayofMonth, monthname(ts) AS ts_MonthName,
       hour(ts) AS ts_HourofDay, dayofweek(ts) + 1 AS ts_WeekdayNumber
FROM events""")
def q_calendar_features(spark, sf):
    ev = activity(spark, sf).select("event_id", "ts")
    out = K.calendar_features(ev, "ts", "ts")
    return out.select("event_id", K.year_month("ts").alias("MnthYr"), K.year_quarter_label("ts").alias("year_quarter"),
                      "ts_DayofWeek", "ts_DayofMonth", "ts_MonthName", "ts_HourofDay", "ts_WeekdayNumber")


@query("q_calendar_bins", """
SELECT event_id,
       CASE WHEN dayofmonth(ts) > 0 AND dayofmonth(ts) <= 10 THEN 'Beginning of Month'
            WHEN dayofmonth(ts) > 10 AND dayofmonth(ts) <= 20 THEN 'Middle of Month'
            WHEN dayofmonth(ts) > 20 AND dayofmonth(ts) <= 31 THEN 'End of Month' END AS MonthPeriod,
       CASE WHEN hour(ts) > -1 AND hour(ts) <= 6 THEN 'Midnight' WHEN hour(ts) > 6 AND hour(ts) <= 12 THEN 'Morning'
            WHEN hour(ts) > 12 AND hour(ts) <= 18 THEN 'Afternoon' WHEN hour(ts) > 18 AND hour(ts) <= 24 THEN 'Evening'
       END AS DayPeriod
FROM events""")
def q_calendar_bins(spark, sf):
    ev = activity(spark, sf)
    return ev.select("event_id", K.month_period(F.dayofmonth("ts")).alias("MonthPeriod"),
                     K.day_period(F.hour("ts")).alias("DayPeriod"))


@query("q_argmax_label", """
WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS s1,
                  count(*) FILTER (WHERE event_type = 'view') AS s2,
                  count(*) FILTER (WHERE event_type = 'purchase') AS s3 FROM events GROUP BY user_id)
SELECT user_id, s1, s2, s3,
       CASE WHEN s1 > s2 AND s1 > s3 THEN '1' WHEN s2 > s1 AND s2 > s3 THEN '2'
            WHEN s3 > s1 AND s3 > s2 THEN '3' ELSE 'NA' END AS label
FROM s""")
def q_argmax_label(spark, sf):
    ev = activity(spark, sf)
    s = ev.groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == t, 1)).alias(f"s{i}")
                                    for i, t in enumerate(["click", "view", "purchase"], 1)])
    return s.withColumn("label", K.argmax_label({"1": "s1", "2": "s2", "3": "s3"}))


@query("q_one_hot", f"""{WG}
SELECT order_id, order_item_id, {", ".join(f"CAST(payment_type = '{s}' AS INTEGER) AS payment_type_{s}" for s in SEGMENTS[1:])}
FROM merged""")
def q_one_hot(spark, sf):
    g = marketplace_lines(spark, sf).select("order_id", "order_item_id", "payment_type")
    return K.one_hot(g, "payment_type").drop("payment_type")
