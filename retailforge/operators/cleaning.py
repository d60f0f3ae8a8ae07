"""Row filters and repairs of retail invoice lines (operators 6-25, 126).

All repairs are predicate filters or joins on the whole frame: no positional
index tricks, so every step is a narrow transformation or one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = "^[0-9]+$"


def is_digits(c: str | Column) -> Column:
    """``str.isdigit()`` on the string form of a code (NULL counts as not digits)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string").rlike(DIGITS), F.lit(False))


def is_cancel(c: str | Column = "InvoiceNo") -> Column:
    """Cancellation marker: the letter C anywhere in the invoice number (kept as in the reference)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string").contains("C"), F.lit(False))


def invalid_codes(df: DataFrame, col: str = "InvoiceNo") -> DataFrame:
    """Distinct non-numeric codes, sorted (6)."""
    return df.where(~is_digits(col)).select(col).distinct().orderBy(col)


def adjustment_lines(df: DataFrame, col: str = "InvoiceNo") -> DataFrame:
    """Lines whose code is neither numeric nor a cancellation (7, the dropped set)."""
    return df.where(~is_cancel(col) & ~is_digits(col))


def drop_adjustments(df: DataFrame, col: str = "InvoiceNo") -> DataFrame:
    """Keep cancellations and numeric invoices only (7)."""
    return df.where(is_cancel(col) | is_digits(col))


def stripped_code_matches(df: DataFrame, col: str = "InvoiceNo") -> DataFrame:
    """Lines whose invoice equals the code of some non-numeric invoice minus its first letter (8).

    A ``left_semi`` join on the stripped code: answers "does the source invoice
    exist?" for every prefixed invoice in one shuffle.
    """
    stripped = (df.where(~is_digits(col)).select(F.substring(col, 2, 1 << 30).alias("__code"))
                  .distinct())
    return df.join(stripped, F.col(col) == F.col("__code"), "left_semi")


def nonpositive_quantity(df: DataFrame, qty: str = "Quantity") -> DataFrame:
    """``Quantity <= 0`` (10)."""
    return df.where(F.col(qty) <= 0)


def drop_stock_upkeep(df: DataFrame, qty: str = "Quantity", inv: str = "InvoiceNo") -> DataFrame:
    """Drop non-cancelled lines with quantity <= 0 (11); NULL quantities are kept."""
    return df.where(~(~is_cancel(inv) & F.coalesce(F.col(qty) <= 0, F.lit(False))))


def drop_untrackable(df: DataFrame, price: str = "UnitPrice", cust: str = "CustomerID") -> DataFrame:
    """Drop lines with price 0 and no customer (13)."""
    return df.where(~(F.coalesce(F.col(price) == 0, F.lit(False)) & F.col(cust).isNull()))


def product_price_table(df: DataFrame, key: str = "Description", price: str = "UnitPrice",
                        qty: str = "Quantity", method: str = "reference") -> DataFrame:
    """Per-product replacement price from lines with a non-zero price (14).

    ``reference``: ΣUnitPrice / ΣQuantity (the reference's own ratio);
    ``mean``: average unit price; ``weighted``: Σ(price·qty) / Σqty.
    """
    priced = df.where((F.col(price) != 0) & F.col(key).isNotNull())
    if method == "reference":
        val = F.try_divide(F.sum(price), F.sum(qty))
    elif method == "mean":
        val = F.avg(price)
    elif method == "weighted":
        val = F.try_divide(F.sum(F.col(price) * F.col(qty)), F.sum(qty))
    else:
        raise ValueError(method)
    return priced.groupBy(key).agg(val.cast("double").alias("AvgPrice"))


def impute_price(df: DataFrame, key: str = "Description", price: str = "UnitPrice",
                 qty: str = "Quantity", method: str = "reference") -> DataFrame:
    """Replace zero prices by the product's price from ``product_price_table`` (14).

    Only the zero-price lines are joined (left join, so an unknown product
    gets NULL, as pandas' NaN); the rest pass through untouched, so the big
    frame is never shuffled for the lookup.
    """
    table = product_price_table(df, key, price, qty, method)
    zero = F.coalesce(F.col(price) == 0, F.lit(False))
    fixed = (df.where(zero).join(table, on=key, how="left")
               .withColumn(price, F.col("AvgPrice")).drop("AvgPrice"))
    return df.where(~zero).unionByName(fixed.select(*df.columns))


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows with NULL in ``cols`` (15); all columns when none given (25)."""
    return df.dropna(how="any", subset=list(cols) or None)


def null_counts(df: DataFrame) -> DataFrame:
    """``sum(is.na(col))`` for every column, one row (25)."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])


def code_length_profile(df: DataFrame, col: str = "StockCode") -> DataFrame:
    """Line counts by code length (16)."""
    return (df.groupBy(F.length(F.col(col).cast("string")).alias("code_length"))
              .agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct(col).alias("n_codes")))


def drop_nonproduct(df: DataFrame, col: str = "StockCode", min_len: int = 5) -> DataFrame:
    """Drop codes shorter than five characters (17)."""
    return df.where(F.length(F.col(col).cast("string")) >= min_len)


def variant_base(col: str = "StockCode", base_len: int = 5) -> Column:
    return F.substring(F.col(col).cast("string"), 1, base_len)


def variant_sets(df: DataFrame, col: str = "StockCode", desc: str = "Description",
                 variant_len: int = 6, base_len: int = 5) -> DataFrame:
    """Base code -> sorted set of descriptions of its variants (57)."""
    v = df.where(F.length(F.col(col).cast("string")) == variant_len)
    return (v.groupBy(variant_base(col, base_len).alias("BaseCode"))
             .agg(F.sort_array(F.collect_set(desc)).alias("Descriptions")))


def variant_counts(df: DataFrame, col: str = "StockCode", desc: str = "Description",
                   variant_len: int = 6, base_len: int = 5) -> DataFrame:
    """Base code -> number of distinct descriptions among its variant codes (18)."""
    v = df.where(F.length(F.col(col).cast("string")) == variant_len)
    return (v.groupBy(variant_base(col, base_len).alias("__base"))
             .agg(F.countDistinct(desc).cast("long").alias("__nvar")))


def product_variations(df: DataFrame, col: str = "StockCode", desc: str = "Description",
                       variant_len: int = 6, base_len: int = 5, name: str = "ProductVariations") -> DataFrame:
    """Add the variant count of each 6-character code, default 1 (18, 39).

    A grouped count and a left join on the base code replace the per-row
    dictionary lookup; the count table has one row per base product.
    """
    counts = variant_counts(df, col, desc, variant_len, base_len)
    is_var = F.coalesce(F.length(F.col(col).cast("string")) == variant_len, F.lit(False))
    # Non-variant lines never touch the join: a NULL join key would send them
    # all to one shuffle partition.
    plain = df.where(~is_var).withColumn(name, F.lit(1).cast("long"))
    var = (df.where(is_var).withColumn("__base", variant_base(col, base_len))
             .join(counts, on="__base", how="left")
             .withColumn(name, F.coalesce(F.col("__nvar"), F.lit(1).cast("long")))
             .drop("__base", "__nvar"))
    return plain.unionByName(var)


def contains_group_count(df: DataFrame, needle: str, col: str = "Description",
                         keys: tuple[str, ...] = ("StockCode", "Description")) -> DataFrame:
    """Filter on a substring, then per-group non-null counts of every other column (19)."""
    others = [c for c in df.columns if c not in keys]
    return (df.where(F.col(col).contains(needle)).groupBy(*keys)
              .agg(*[F.count(c).alias(c) for c in others]))


def split_cancels(df: DataFrame, inv: str = "InvoiceNo") -> tuple[DataFrame, DataFrame]:
    """(cancellations, orders) by the C marker (21)."""
    return df.where(is_cancel(inv)), df.where(~is_cancel(inv))
