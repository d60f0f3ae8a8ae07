"""Monthly CLV table kept up to date from an appended order-line folder (operator 55, incremental).

Structured Streaming reads new parquet files; every micro-batch writes
(a) exact partial sums per (series, month) and (b) the distinct
(series, month, customer) keys, both partitioned by batch id with dynamic
partition overwrite, so a batch replayed after a failure replaces its own
output instead of doubling it.  ``read_monthly_clv`` folds the partials:
sums add up, distinct customers are counted over the key table - the only
exact way to merge distinct counts across batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailforge.functions.calendar import year_month
from retailforge.session import checkpoint_dir


def run_monthly_clv_stream(spark: SparkSession, source: DataFrame, enrich, ts: str, revenue: str, customer: str,
                           series: list[str], out_dir: str | None = None) -> str:
    """Process everything available in ``source`` (a streaming DataFrame) and return the output folder.

    ``enrich(batch_df) -> DataFrame`` adds the series columns (a stream-static join).
    """
    base = out_dir or f"{checkpoint_dir(spark).rstrip('/')}/retailforge-streams/monthly-{uuid.uuid4().hex}"

    def batch(df: DataFrame, epoch: int) -> None:
        keyed = enrich(df).withColumn("MnthYr", year_month(ts)).withColumn("batch", F.lit(epoch))
        parts = keyed.groupBy("batch", *series, "MnthYr").agg(
            F.sum(F.col(revenue).cast("decimal(24,4)")).alias("rev"), F.count(F.lit(1)).alias("pur"))
        keys = keyed.select("batch", *series, "MnthYr", customer).distinct()
        for name, frame in (("partials", parts), ("customers", keys)):
            (frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                  .partitionBy("batch").parquet(f"{base}/{name}"))

    q = (source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/_checkpoint")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return base


def read_monthly_clv(spark: SparkSession, base: str, series: list[str], customer: str,
                     drop_months: list[str] | None = None) -> DataFrame:
    """Fold the streamed partials into the monthly CLV table of ``aggregates.monthly_clv``."""
    p = (spark.read.parquet(f"{base}/partials").groupBy(*series, "MnthYr")
              .agg(F.sum("rev").cast("double").alias("total_Rev"), F.sum("pur").alias("total_Pur")))
    c = (spark.read.parquet(f"{base}/customers").select(*series, "MnthYr", customer).distinct()
              .groupBy(*series, "MnthYr").agg(F.count(customer).alias("total_Cust")))
    g = p.join(c, series + ["MnthYr"])
    if drop_months:
        g = g.where(~F.col("MnthYr").isin(list(drop_months)))
    val = F.try_divide(F.col("total_Rev"), F.col("total_Pur"))
    freq = F.try_divide(F.col("total_Pur"), F.col("total_Cust"))
    return (g.withColumn("AVG_PUR_VAL", val).withColumn("AVG_PUR_FREQ", freq)
             .withColumn("total_CLV", F.col("AVG_PUR_VAL") * F.col("AVG_PUR_FREQ")))
