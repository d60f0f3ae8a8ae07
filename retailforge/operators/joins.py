"""Joins of the marketplace star and key-expression joins (operators 32-41, 128)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailforge.functions.ordering import first_by


def left_join(df: DataFrame, other: DataFrame, on, how: str = "left") -> DataFrame:
    """Left equi join (32); keys are expected non-NULL (NULL never joins in Spark)."""
    return df.join(other, on=on, how=how)


def inner_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Inner equi join (33, 34)."""
    return df.join(other, on=on, how="inner")


def dedupe_first(df: DataFrame, key: str | list[str], order_cols: list[str] | None = None) -> DataFrame:
    """Keep one row per key: the first under ``order_cols`` then every other column (40, 65)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    order = list(order_cols or []) + [c for c in rest if c not in (order_cols or [])]
    return first_by(df, keys, order, keep=rest).select(*df.columns)


def truncated_key_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str,
                       drop_prefix: int = 1, how: str = "left") -> DataFrame:
    """Left join on an expression key: ``substr(left, 1 + drop_prefix) = right`` (35)."""
    key = F.substring(F.col(left_col).cast("string"), 1 + drop_prefix, 1 << 30)
    return left.join(right, key == F.col(right_col).cast("string"), how)


def merge_marketplace(t: dict[str, DataFrame], status: str = "delivered", items_how: str = "inner",
                      review_order: list[str] | None = None,
                      payment_order: list[str] | None = None) -> DataFrame:
    """Denormalise the marketplace star (41).

    delivered orders (22) ⟕ customers (32) ⋈ first review (33, 40)
    ⟕ first payment (32, 40) ⋈ items ⋈ sellers ⋈ (products ⋈ translation,
    first per product) (34).  The three joins after the payments were written
    as left joins with a misspelt argument in the reference and therefore ran
    as inner joins; ``items_how`` keeps that as the default.

    Dedupes run *before* their join as ``min(struct)`` aggregates (partial
    aggregation, no window over a possibly hot key); the joins on order_id
    share one hash partitioning, so only the incoming side shuffles.
    """
    orders = t["orders"].where(F.col("order_status") == status)
    df = orders.join(t["customers"], on="customer_id", how="left")
    reviews = dedupe_first(t["reviews"], "order_id", review_order)
    df = df.join(reviews, on="order_id", how="inner")
    payments = dedupe_first(t["payments"], "order_id", payment_order or ["payment_sequential"])
    df = df.join(payments, on="order_id", how="left")
    df = df.join(t["items"], on="order_id", how=items_how)
    df = df.join(t["sellers"], on="seller_id", how=items_how)
    products = t["products"].join(t["translation"], on="product_category_name", how=items_how)
    products = dedupe_first(products, "product_id")
    return df.join(products, on="product_id", how=items_how)
