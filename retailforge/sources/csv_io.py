"""CSV sources and sinks (operators 1-5).

Between stages the jobs exchange parquet; CSV is for the edges where the
reference reads or writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV scan (1, 3).  Pass a schema in production; inference is a test-only path."""
    r = spark.read.option("header", header).option("encoding", encoding)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return strip_bom(r.csv(path))


def strip_bom(df: DataFrame) -> DataFrame:
    """CSV scan with a byte-order mark (2): drop the BOM from the first header name."""
    first = df.columns[0] if df.columns else None
    if first and first.startswith(BOM):
        df = df.withColumnRenamed(first, first[len(BOM):])
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink without an index column (4)."""
    df.write.mode(mode).option("header", True).csv(path)


def with_row_id(df: DataFrame, *order_cols: str, name: str = "") -> DataFrame:
    """CSV sink layout with a leading 1-based row id (5), ordered by the result's own key.

    The id comes from a range-partitioned sort and ``zipWithIndex``, so no
    single task ever holds the whole frame.
    """
    from retailforge.functions.ordering import sequential_index
    idx = sequential_index(df, list(order_cols), name="__rid")
    return idx.select((F.col("__rid") + 1).cast("string").alias(name), *df.columns)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
