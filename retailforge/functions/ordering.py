"""Global positions without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequential_index(df: DataFrame, order_cols: list, name: str = "idx") -> DataFrame:
    """Attach a 0-based position in ``order_cols`` order, JVM-side only.

    ``orderBy`` range-partitions the data (distributed sort);
    ``monotonically_increasing_id`` numbers rows inside each partition; the
    per-partition row counts (one row per partition) give prefix offsets,
    joined back as a broadcast of that partition-sized table.  No task sees
    more than its own range.  ``order_cols`` must make the order total.
    ``_kept`` of the result is the sorted frame, to unpersist when the result
    is no longer read.
    """
    from pyspark import StorageLevel
    from pyspark.sql import Window

    ordered = (df.orderBy(*order_cols)
                 .select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__mid"))
                 .persist(StorageLevel.MEMORY_AND_DISK))
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)   # over partitions, not rows
    offsets = counts.select("__pid", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    out = ordered.join(F.broadcast(offsets), "__pid").select(*df.columns, (F.col("__off") + local).alias(name))
    out._kept = ordered
    return out


def first_by(df: DataFrame, keys: list[str], order_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Keep the first row per key under an explicit total order (operators 40, 65).

    Expressed as ``min(struct(order..., payload...))`` so Spark pre-aggregates
    map-side: a hot key never lands whole in one task, unlike a
    ``row_number()`` window partitioned by the key.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in keys]
    payload = [c for c in keep if c not in order_cols]
    fields = order_cols + payload
    packed = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    out = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return out.select(*keys, *[F.col(f"__first.f{i}").alias(c) for i, c in enumerate(fields)]) \
              .select(*keys, *keep)
