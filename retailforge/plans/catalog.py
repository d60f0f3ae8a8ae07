"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from retailforge.plans import q_aggs, q_market, q_model, q_retail, q_rules, q_series, q_stream  # noqa: F401
from retailforge.plans.registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Raw retail lines -> cleaned -> RFM + CLV score per customer line."""
    from pyspark.sql import functions as F

    from retailforge.operators.rfm import clv_score, rfm
    from retailforge.plans.pipelines import clean_retail
    from retailforge.session import configure
    from retailforge.sources.views import retail_lines
    configure(spark)
    clean = clean_retail(retail_lines(spark, sf_dir))
    scored = clv_score(rfm(clean, "InvoiceDate", "CustomerID", "UnitPrice", "Quantity"))
    return scored.withColumn("InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"))
