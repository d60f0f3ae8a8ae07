"""Queries over the marketplace star: joins, dedupes, merge, delivery features (22, 32-43, 79, 128, 131)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailforge.operators import joins as J
from retailforge.plans.oracle_views import MARKET_TABLES, MERGED, RETAIL_LINES, with_views
from retailforge.plans.pipelines import delivery_features, fmt_ts, marketplace_lines, review_model_inputs
from retailforge.plans.registry import query
from retailforge.sources.views import marketplace_tables, retail_lines

WM = with_views(MARKET_TABLES)
WG = with_views(MERGED)


def _ts_out(df):
    for c, t in df.dtypes:
        if t.startswith("timestamp"):
            df = df.withColumn(c, fmt_ts(c))
    return df


def _ts_sql(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


@query("q_delivered", f"""{WM}
SELECT order_id, customer_id, order_status, {_ts_sql('order_purchase_timestamp')}
FROM m_orders WHERE order_status = 'delivered'""")
def q_delivered(spark, sf):
    o = marketplace_tables(spark, sf)["orders"]
    return _ts_out(o.where(F.col("order_status") == "delivered")
                    .select("order_id", "customer_id", "order_status", "order_purchase_timestamp"))


@query("q_status_counts", f"""{WM}
SELECT order_status, count(*) AS n FROM m_orders GROUP BY 1""")
def q_status_counts(spark, sf):
    o = marketplace_tables(spark, sf)["orders"]
    return o.groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))


@query("q_join_left", f"""{WM}
SELECT o.order_id, o.customer_id, c.customer_unique_id, c.customer_state, c.customer_segment
FROM m_orders o LEFT JOIN m_customers c ON o.customer_id = c.customer_id""")
def q_join_left(spark, sf):
    t = marketplace_tables(spark, sf)
    return J.left_join(t["orders"].select("order_id", "customer_id"), t["customers"], "customer_id")


@query("q_join_inner", f"""{WM}
SELECT o.order_id, o.order_status, r.review_score FROM m_orders o JOIN m_reviews r ON o.order_id = r.order_id""")
def q_join_inner(spark, sf):
    t = marketplace_tables(spark, sf)
    return J.inner_join(t["orders"].select("order_id", "order_status"), t["reviews"], "order_id")


@query("q_dedupe_first", f"""{WM}
SELECT order_id, payment_sequential, payment_type, payment_installments, payment_value FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id
     ORDER BY payment_sequential, payment_type, payment_installments, payment_value) AS rn
  FROM m_payments) WHERE rn = 1""")
def q_dedupe_first(spark, sf):
    return J.dedupe_first(marketplace_tables(spark, sf)["payments"], "order_id", ["payment_sequential"])


MERGED_COLS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
               "customer_unique_id", "customer_state", "customer_segment", "review_score",
               "payment_sequential", "payment_type", "payment_installments", "payment_value",
               "order_item_id", "product_id", "seller_id", "order_delivered_customer_date", "price",
               "freight_value", "line_number", "seller_state", "product_category_name", "product_brand",
               "product_photos_qty", "product_category_name_english", "order_estimated_delivery_date"]
_TS_COLS = {"order_purchase_timestamp", "order_approved_at", "order_delivered_customer_date",
            "order_estimated_delivery_date"}
MERGED_SQL_COLS = ", ".join(_ts_sql(c) if c in _TS_COLS else c for c in MERGED_COLS)


@query("q_olist_merge", f"""{WG}
SELECT {MERGED_SQL_COLS} FROM merged""")
def q_olist_merge(spark, sf):
    return _ts_out(marketplace_lines(spark, sf).select(*MERGED_COLS))


@query("q_join_truncated_key", f"""{with_views(RETAIL_LINES)},
c AS (SELECT DISTINCT InvoiceNo FROM retail_lines WHERE length(InvoiceNo) = 7),
o AS (SELECT DISTINCT InvoiceNo AS OrderInvoice FROM retail_lines WHERE length(InvoiceNo) = 6)
SELECT c.InvoiceNo, o.OrderInvoice FROM c LEFT JOIN o ON substr(c.InvoiceNo, 2) = o.OrderInvoice""")
def q_join_truncated_key(spark, sf):
    df = retail_lines(spark, sf)
    c = df.where(F.length("InvoiceNo") == 7).select("InvoiceNo").distinct()
    o = df.where(F.length("InvoiceNo") == 6).select(F.col("InvoiceNo").alias("OrderInvoice")).distinct()
    return J.truncated_key_join(c, o, "InvoiceNo", "OrderInvoice")


DELIVERY_SQL = """
feat AS (
  SELECT *, (epoch_us(order_delivered_customer_date) - epoch_us(order_approved_at)) / 86400e6 AS del_time,
         (epoch_us(order_estimated_delivery_date) - epoch_us(order_approved_at)) / 86400e6 AS est_del_time,
         (epoch_us(order_estimated_delivery_date) - epoch_us(order_delivered_customer_date)) / 86400e6 AS delta_time,
         price + freight_value AS total_price,
         CASE WHEN price <> 0 THEN freight_value / price END AS freight_ratio,
         dayofweek(order_approved_at) + 1 AS purchase_day_of_week
  FROM merged)"""


@query("q_delivery_features", f"""{WG},{DELIVERY_SQL}
SELECT order_id, order_item_id, product_id, del_time, est_del_time, delta_time,
       CASE WHEN delta_time < 0 THEN 1 ELSE 0 END AS Late, round(total_price, 6) AS total_price,
       round(freight_ratio, 12) AS freight_ratio, purchase_day_of_week
FROM feat""")
def q_delivery_features(spark, sf):
    f = delivery_features(marketplace_lines(spark, sf))
    return f.select("order_id", "order_item_id", "product_id", "del_time", "est_del_time", "delta_time",
                    "Late", F.round("total_price", 6).alias("total_price"),
                    F.round("freight_ratio", 12).alias("freight_ratio"), "purchase_day_of_week")


@query("q_review_features", f"""{WG},{DELIVERY_SQL}
SELECT review_score, payment_type, payment_installments, payment_value, freight_value, product_photos_qty,
       del_time, est_del_time, delta_time, CASE WHEN delta_time < 0 THEN 1 ELSE 0 END AS Late,
       round(total_price, 6) AS total_price, round(freight_ratio, 12) AS freight_ratio, purchase_day_of_week
FROM feat
WHERE review_score IS NOT NULL AND payment_type IS NOT NULL AND payment_installments IS NOT NULL
  AND payment_value IS NOT NULL AND freight_value IS NOT NULL AND product_photos_qty IS NOT NULL
  AND freight_ratio IS NOT NULL""")
def q_review_features(spark, sf):
    f = review_model_inputs(marketplace_lines(spark, sf), version=2)
    return (f.withColumn("total_price", F.round("total_price", 6))
             .withColumn("freight_ratio", F.round("freight_ratio", 12)))
