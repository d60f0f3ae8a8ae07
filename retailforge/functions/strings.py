"""String helpers of the reference's feature code (operators 72-74)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_word(c: str | Column, sep: str = " ") -> Column:
    """First token of a string (``split(...)[0]``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.split(c, sep, -1), 1)


def replace_first(c: str | Column, literal: str, repl: str) -> Column:
    """R ``sub`` with a fixed pattern: replace only the first occurrence of ``literal``."""
    c = F.col(c) if isinstance(c, str) else c
    pos = F.instr(c, literal)
    before = F.substring_index(c, literal, 1)
    after = F.substr(c, pos + F.lit(len(literal)))
    return F.when(pos > 0, F.concat(before, F.lit(repl), after)).otherwise(c)


# Spelling repairs of category first words; fixed values that must equal the
# reference's intent (its own `sub("fashio","fashion")` also hit "fashion").
CATEGORY_REPAIRS = {"fashio": "fashion"}


def coarse_category(c: str | Column, repairs: dict[str, str] | None = None) -> Column:
    """First word of an underscore-separated category, with spelling repairs (73)."""
    repairs = CATEGORY_REPAIRS if repairs is None else repairs
    w = first_word(c, "_")
    out = w
    for bad, good in repairs.items():
        out = F.when(w == bad, F.lit(good)).otherwise(out)
    return out


def retail_product_label(desc: str = "Description", code: str = "StockCode") -> Column:
    """``Description (StockCode`` - the reference's label lacks the closing bracket (74)."""
    return F.concat(F.col(desc), F.lit(" ("), F.col(code))


def marketplace_product_label(cat: str = "product_category_name_english", seller: str = "seller_id",
                              product: str = "product_id") -> Column:
    """``category/seller (product)`` (74)."""
    return F.concat(F.col(cat), F.lit("/"), F.col(seller).cast("string"), F.lit(" ("),
                    F.col(product).cast("string"), F.lit(")"))
