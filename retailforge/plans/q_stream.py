"""Streaming form of the monthly CLV table, checked against the batch oracle (55)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailforge.plans.oracle_views import CLV_LINES, with_views
from retailforge.plans.q_aggs import CLV_SERIES_SQL, PARTIAL_MONTHS
from retailforge.plans.registry import query
from retailforge.sources.tables import read_table
from retailforge.streaming.monthly import read_monthly_clv, run_monthly_clv_stream

SERIES = ["series_kind", "series_key"]


@query("q_monthly_clv_stream", f"""{with_views(CLV_LINES)},{CLV_SERIES_SQL}
SELECT series_kind, series_key, MnthYr, total_Rev, total_Pur, total_Cust, AVG_PUR_VAL, AVG_PUR_FREQ, total_CLV
FROM clv""")
def q_monthly_clv_stream(spark, sf):
    orders_schema = read_table(spark, sf, "orders").schema
    src = (spark.readStream.schema(orders_schema).option("pathGlobFilter", "orders.parquet")
                .option("maxFilesPerTrigger", 1).parquet(sf))
    cust = read_table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nat = F.broadcast(read_table(spark, sf, "nation", "n_nationkey", "n_name"))
    dims = cust.join(nat, cust.c_nationkey == nat.n_nationkey)

    def enrich(batch):
        j = batch.join(dims, batch.o_custkey == dims.c_custkey)
        keys = F.explode(F.array(F.struct(F.lit("nation").alias("series_kind"), F.col("n_name").alias("series_key")),
                                 F.struct(F.lit("segment").alias("series_kind"),
                                          F.col("c_mktsegment").alias("series_key"))))
        return j.select("o_orderdate", "o_totalprice", "o_custkey", keys.alias("k")).select("*", "k.*").drop("k")
    base = run_monthly_clv_stream(spark, src, enrich, "o_orderdate", "o_totalprice", "o_custkey", SERIES)
    m = read_monthly_clv(spark, base, SERIES, "o_custkey", drop_months=PARTIAL_MONTHS)
    return m.select(*SERIES, "MnthYr", "total_Rev", "total_Pur", "total_Cust", "AVG_PUR_VAL", "AVG_PUR_FREQ",
                    "total_CLV")
