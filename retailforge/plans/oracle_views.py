"""DuckDB text of the views in ``retailforge.sources.views`` (oracle side only).

These mirror the fixed mapping expressions of the Spark views so that each
oracle query can start ``WITH retail_lines AS (...)``.
"""

RETAIL_LINES = """
retail_lines AS (
  SELECT (CASE WHEN l.l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(500000 + l.l_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(10000 + p.p_partkey // 4 AS VARCHAR)
           || (CASE WHEN p.p_partkey % 4 > 0 THEN chr(CAST(64 + p.p_partkey % 4 AS INTEGER)) ELSE '' END) AS StockCode,
         p.p_name AS Description,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS BIGINT) AS Quantity,
         o.o_orderdate AS InvoiceDate,
         l.l_extendedprice / l.l_quantity AS UnitPrice,
         o.o_custkey AS CustomerID,
         n.n_name AS Country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

DIRTY_LINES = RETAIL_LINES + """,
dirty_lines AS (
  SELECT CASE WHEN InvoiceNo NOT LIKE 'C%' AND Quantity % 17 = 0 THEN 'A' || InvoiceNo ELSE InvoiceNo END AS InvoiceNo, StockCode,
         CASE WHEN StockCode NOT LIKE '%C' THEN Description END AS Description,
         CASE WHEN InvoiceNo NOT LIKE 'C%' AND Quantity % 7 = 0 THEN -Quantity ELSE Quantity END AS Quantity, InvoiceDate,
         CASE WHEN Quantity % 5 = 0 THEN 0.0 ELSE UnitPrice END AS UnitPrice,
         CASE WHEN CustomerID % 11 <> 0 THEN CustomerID END AS CustomerID, Country
  FROM retail_lines
)"""

MARKET_TABLES = """
m_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
         o_orderdate AS order_purchase_timestamp, o_orderdate AS order_approved_at
  FROM orders),
m_customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, c_nationkey AS customer_state,
         c_mktsegment AS customer_segment FROM customer),
m_reviews AS (
  SELECT o_orderkey AS order_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS review_score FROM orders),
m_payments AS (
  SELECT o.o_orderkey AS order_id, l.l_linenumber AS payment_sequential, c.c_mktsegment AS payment_type,
         l.l_linenumber AS payment_installments, o.o_totalprice AS payment_value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
m_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         l_shipdate AS order_delivered_customer_date, l_extendedprice AS price,
         l_extendedprice * l_tax AS freight_value, l_linenumber AS line_number
  FROM lineitem),
m_sellers AS (SELECT s_suppkey AS seller_id, s_nationkey AS seller_state FROM supplier),
m_products AS (
  SELECT p_partkey AS product_id, p_type AS product_category_name, p_brand AS product_brand,
         p_size AS product_photos_qty FROM part),
m_translation AS (
  SELECT DISTINCT product_category_name, lower(product_category_name) AS product_category_name_english FROM m_products)"""

CLV_LINES = """
clv_lines AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderdate AS order_ts,
         o.o_totalprice AS revenue, n.n_name AS nation, c.c_mktsegment AS segment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views)

MERGED = MARKET_TABLES + """,
m_rev1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_score) AS rn
                          FROM m_reviews) WHERE rn = 1),
m_pay1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id
             ORDER BY payment_sequential, payment_type, payment_installments, payment_value) AS rn
           FROM m_payments) WHERE rn = 1),
m_prod AS (SELECT * FROM (SELECT p.*, t.product_category_name_english,
             row_number() OVER (PARTITION BY p.product_id ORDER BY p.product_category_name, p.product_brand,
                                p.product_photos_qty, t.product_category_name_english) AS rn
           FROM m_products p JOIN m_translation t USING (product_category_name)) WHERE rn = 1),
merged AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
         c.customer_unique_id, c.customer_state, c.customer_segment, r.review_score,
         p.payment_sequential, p.payment_type, p.payment_installments, p.payment_value,
         i.order_item_id, i.product_id, i.seller_id, i.order_delivered_customer_date, i.price, i.freight_value,
         i.line_number, s.seller_state, pr.product_category_name, pr.product_brand, pr.product_photos_qty,
         pr.product_category_name_english,
         o.order_purchase_timestamp + to_days(CAST(5 + i.line_number * 10 AS INTEGER)) AS order_estimated_delivery_date
  FROM m_orders o
  LEFT JOIN m_customers c ON o.customer_id = c.customer_id
  JOIN m_rev1 r ON o.order_id = r.order_id
  LEFT JOIN m_pay1 p ON o.order_id = p.order_id
  JOIN m_items i ON o.order_id = i.order_id
  JOIN m_sellers s ON i.seller_id = s.seller_id
  JOIN m_prod pr ON i.product_id = pr.product_id
  WHERE o.order_status = 'delivered')"""
