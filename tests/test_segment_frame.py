"""The segment models start from cleaned lines (S5 reads the cleaned table)."""

from pyspark.sql import functions as F

from retailforge.plans import q_model as Q
from retailforge.plans.pipelines import clean_retail


def test_segment_models_start_from_cleaned_lines(spark, monkeypatch):
    rows = [(str(500000 + i), f"{10000 + i % 5}", f"thing {i % 5}", 2 + i % 4, 1.0 + i % 7, i % 6, "here" if i % 3 else "there") for i in range(60)]
    rows += [("C500001", "10001", "thing 1", -2, 2.0, 1, "here"), ("C600000", "10002", "thing 2", -1, 3.0, 2, "here"),  # one met by an order, one not
             ("A500070", "10003", "thing 3", 5, 4.0, 3, "here"), ("500071", "POST", "postage", 1, 4.0, 3, "here")]
    lines = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity long, UnitPrice double, CustomerID long, Country string")
    lines = lines.withColumn("InvoiceDate", F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(cast(CustomerID + abs(Quantity) as int))")).cache()
    monkeypatch.setattr(Q, "retail_lines", lambda spark, sf: lines)
    train, test = Q.segment_model_frame(spark, "")
    got = train.unionByName(test).select("Quantity", "UnitPrice", "Country").collect()
    want = clean_retail(lines).select("Quantity", "UnitPrice", "Country").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and min(r.Quantity for r in got) > 0 and len(got) < len(rows)
    assert train.count() == len(want) * 7 // 10
    train.unpersist()
    test.unpersist()
    lines.unpersist()
