"""Composite pipelines: the public jobs of the engine (126-133)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailforge.operators import cleaning as C
from retailforge.operators.joins import merge_marketplace
from retailforge.operators.netting import cancellation_netting
from retailforge.operators.rfm import days_between


def clean_retail(lines: DataFrame, impute_method: str = "reference") -> DataFrame:
    """Raw invoice lines -> cleaned lines (126).

    Steps in the reference's order: drop adjustments (7), drop stock upkeep
    (11), drop untrackable (13), impute zero prices (14), drop NULL customers
    (15), variant counts (18), drop non-product codes (17), then netting of
    cancellations (21, 36-38, 69, 23).
    """
    from retailforge.session import stage
    df = C.drop_adjustments(lines)
    df = C.drop_stock_upkeep(df)
    df = stage(C.drop_untrackable(df), "filtered")  # read by three branches below
    df = C.impute_price(df, method=impute_method)
    df = C.drop_null(df, "CustomerID")
    df = C.product_variations(df)
    df = stage(C.drop_nonproduct(df), "repaired")   # netting reads its input six times
    return cancellation_netting(df, materialize=False)


def fmt_ts(c: str) -> F.Column:
    """Timestamp as ``yyyy-MM-dd HH:mm:ss`` text, for engine-neutral result tables."""
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


def marketplace_lines(spark, sf_dir: str) -> DataFrame:
    """Merged marketplace order lines (128) plus the estimated delivery date of the fixture mapping."""
    from retailforge.sources.views import marketplace_tables
    m = merge_marketplace(marketplace_tables(spark, sf_dir))
    est = F.col("order_purchase_timestamp") + F.make_dt_interval(
        F.lit(5) + F.col("line_number") * F.lit(10))
    return m.withColumn("order_estimated_delivery_date", est)


def delivery_features(df: DataFrame) -> DataFrame:
    """Delivery-time features of the review model, v2 inputs (79)."""
    approved, delivered = F.col("order_approved_at"), F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return (df.withColumn("del_time", days_between(delivered, approved))
              .withColumn("est_del_time", days_between(estimated, approved))
              .withColumn("delta_time", days_between(estimated, delivered))
              .withColumn("Late", F.when(F.col("delta_time") < 0, 1).otherwise(0))
              .withColumn("total_price", F.col("price") + F.col("freight_value"))
              .withColumn("freight_ratio", F.try_divide(F.col("freight_value"), F.col("price")))
              .withColumn("purchase_day_of_week", F.dayofweek(approved)))


REVIEW_V1 = ["review_score", "payment_type", "payment_installments", "payment_value", "price",
             "freight_value", "product_photos_qty"]
REVIEW_V2 = ["review_score", "payment_type", "payment_installments", "payment_value", "freight_value",
             "product_photos_qty", "del_time", "est_del_time", "delta_time", "Late", "total_price",
             "freight_ratio", "purchase_day_of_week"]


def review_model_inputs(df: DataFrame, version: int = 2) -> DataFrame:
    """Review-score model frame (131): v1 raw columns, v2 adds delivery features and drops price.

    Columns are chosen by name (24) and incomplete rows dropped (25).
    """
    if version == 1:
        return df.select(*REVIEW_V1).dropna()
    return delivery_features(df).select(*REVIEW_V2).dropna()


def segment_customers(lines: DataFrame, k: int = 3, columns: list[str] | None = None) -> DataFrame:
    """Cleaned lines -> RFM -> row score -> exact 1-D k-means labels (130).

    All rows are returned, with all columns or with ``columns`` (``clv`` among
    them) and the label; between the stages only what these need is written.
    """
    from retailforge.operators.rfm import clv_score, rfm
    from retailforge.operators.segments import optimal_1d_segments
    from retailforge.session import stage
    clean = clean_retail(lines)
    if columns is not None:
        clean = clean.select(*[c for c in clean.columns if c in {*columns, "InvoiceDate", "CustomerID", "UnitPrice", "Quantity"}])
    scored = clv_score(rfm(stage(clean, "cleaned"), "InvoiceDate", "CustomerID", "UnitPrice", "Quantity"))
    scored = stage(scored if columns is None else scored.select(*columns), "scored")
    return optimal_1d_segments(scored, "clv", k)
