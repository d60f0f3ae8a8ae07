"""Vectors as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: components beyond this are treated like non-finite ones: squared distances would no longer fit a long
LARGEST = 65_536.0


def finite(vector: Column) -> Column:
    """True for vectors whose components are all there and finite; NULL vectors are not."""
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def within_range(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.abs(x.cast("double")) < LARGEST), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as ``array<int>``."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent vector length (ties: the smaller); 0 for an empty table."""
    top = df.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return int(top.d) if top else 0


def matrix(column: pa.Array, dim: int, kind=np.int64) -> np.ndarray:
    """List column of equal lengths -> (rows, dim)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)
