"""Views that present the driver tables in the reference's data model.

* ``retail_lines``  - online-retail invoice lines (InvoiceNo ... Country)
* ``marketplace_tables`` - the marketplace star (orders, customers, reviews,
  payments, items, sellers, products) that ``merge_marketplace`` denormalises
* ``clv_lines``     - order lines keyed by a series id, for monthly CLV series
* ``activity``      - timestamped events with time of day

The mapping expressions are fixed so that the DuckDB oracle can rebuild the
same views (see ``retailforge.plans.oracle_views``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailforge.sources.tables import read_table


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation is a fixed 25-row dimension: broadcasting it is bounded by definition.
    return F.broadcast(read_table(spark, sf_dir, "nation", "n_nationkey", "n_name"))


def stock_code(partkey) -> F.Column:
    """Five-digit base code, plus a variant letter A-C for three of every four parts."""
    base = (F.lit(10000) + F.expr(f"{partkey} div 4")).cast("string")
    letter = F.when(F.expr(f"{partkey} % 4") > 0,
                    F.expr(f"char(64 + cast({partkey} % 4 as int))")).otherwise(F.lit(""))
    return F.concat(base, letter)


def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation as retail invoice lines."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity",
                    "l_extendedprice", "l_returnflag")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    cn = c.join(_nation_names(spark, sf_dir), c.c_nationkey == F.col("n_nationkey"))
    cancel = F.col("l_returnflag") == "R"
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey)
           .join(cn, o.o_custkey == cn.c_custkey))
    return j.select(
        F.concat(F.when(cancel, F.lit("C")).otherwise(F.lit("")),
                 (F.lit(500000) + F.col("l_orderkey")).cast("string")).alias("InvoiceNo"),
        stock_code("p_partkey").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.when(cancel, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )


def marketplace_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven marketplace tables the merge (operator 41) consumes."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderdate", "o_orderpriority", "o_totalprice")
    orders = o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
         .when(F.col("o_orderstatus") == "O", "shipped").otherwise("processing").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("o_orderdate").alias("order_approved_at"))
    customers = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_state"), F.col("c_mktsegment").alias("customer_segment"))
    reviews = o.select(
        F.col("o_orderkey").alias("order_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"))
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_extendedprice", "l_tax", "l_shipdate")
    seg = customers.select("customer_id", F.col("customer_segment").alias("payment_type"))
    payments = (li.select("l_orderkey", "l_linenumber")
                  .join(o.select("o_orderkey", "o_custkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
                  .join(seg, F.col("o_custkey") == F.col("customer_id"))
                  .select(F.col("o_orderkey").alias("order_id"),
                          F.col("l_linenumber").alias("payment_sequential"),
                          F.col("payment_type"),
                          F.col("l_linenumber").alias("payment_installments"),
                          F.col("o_totalprice").alias("payment_value")))
    items = li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("order_delivered_customer_date"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        F.col("l_linenumber").alias("line_number"))
    sellers = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("seller_state"))
    products = read_table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_size").select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"),
        F.col("p_brand").alias("product_brand"), F.col("p_size").alias("product_photos_qty"))
    translation = products.select("product_category_name").distinct().select(
        "product_category_name", F.lower("product_category_name").alias("product_category_name_english"))
    return {"orders": orders, "customers": customers, "reviews": reviews, "payments": payments,
            "items": items, "sellers": sellers, "products": products, "translation": translation}


def clv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation: one row per order with two series keys."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    cn = c.join(_nation_names(spark, sf_dir), c.c_nationkey == F.col("n_nationkey"))
    return o.join(cn, o.o_custkey == cn.c_custkey).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_ts"), F.col("o_totalprice").alias("revenue"),
        F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a real time of day (hour and weekday features)."""
    return read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def dirty_lines(spark, sf_dir: str) -> DataFrame:
    """Retail lines with the faults that cleaning is for, which the given tables lack.

    Derived from the lines' own values: adjustment codes (order quantities
    divisible by 17), stock upkeep (by 7: quantity negated), zero prices (by
    5), lines without a customer (customers divisible by 11) and without a
    description (stock codes ending in C).
    """
    q, order = F.col("Quantity"), ~F.col("InvoiceNo").startswith("C")
    return retail_lines(spark, sf_dir).select(
        F.when(order & (q % 17 == 0), F.concat(F.lit("A"), "InvoiceNo")).otherwise(F.col("InvoiceNo")).alias("InvoiceNo"), "StockCode",
        F.when(~F.col("StockCode").endswith("C"), F.col("Description")).alias("Description"),
        F.when(order & (q % 7 == 0), -q).otherwise(q).alias("Quantity"), "InvoiceDate",
        F.when(q % 5 == 0, F.lit(0.0)).otherwise(F.col("UnitPrice")).alias("UnitPrice"),
        F.when(F.col("CustomerID") % 11 != 0, F.col("CustomerID")).alias("CustomerID"), "Country")
