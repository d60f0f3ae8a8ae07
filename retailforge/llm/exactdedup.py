"""Exact deduplication by content sort.

Texts are equal when they are identical after deleting white space.  Rows
are range-partitioned by sampled splitters and sorted (Spark's external
sort), so equal texts are neighbours; each row is then compared in full with
the one before it.  Splitters and sort key hold the first bytes of the
normalised text and its digest instead of whole texts, so what the sampling
sends to the driver is bounded; the identifier closes the key, so a group
that holds a third of all rows is cut over many partitions.  Runs that touch
a partition border are compared with their neighbour across it, and chained
by a window over one row per partition.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailforge.session import stage

WHITE = " \t\n\x0b\x0c\r"
PREFIX = 48

_RUNS = ("doc_id long, text_sha256 string, n_chars long, pid int, run long, head boolean, first_run boolean, "
         "last_run boolean, size long, norm string, best_id long, best_chars long")


def _runs(batches):
    """Sorted rows -> the same rows with run number and size; border runs carry one copy of their text."""
    pid = TaskContext.get().partitionId()
    run, prev, sha, ids, chars = -1, None, None, [], []

    def close(last):
        n, edge = len(ids), run == 0 or last
        for a in range(0, n, 10_000):
            m = min(10_000, n - a)
            head = [a == 0 and i == 0 for i in range(m)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[a:a + m], pa.int64()), pa.array([sha] * m, pa.string()), pa.array(chars[a:a + m], pa.int64()),
                pa.array([pid] * m, pa.int32()), pa.array([run] * m, pa.int64()), pa.array(head, pa.bool_()),
                pa.array([run == 0] * m, pa.bool_()), pa.array([last] * m, pa.bool_()), pa.array([n] * m, pa.int64()),
                pa.array([prev if h and edge else None for h in head], pa.string()),
                pa.array([ids[0]] * m, pa.int64()), pa.array([chars[0]] * m, pa.int64()),
            ], names=["doc_id", "text_sha256", "n_chars", "pid", "run", "head", "first_run", "last_run", "size", "norm",
                      "best_id", "best_chars"])

    ready, held = [], 0
    for b in batches:
        norms, docs, ns, shas = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("norm", "doc_id", "n_chars", "sha"))
        for norm, d, n, s in zip(norms, docs, ns, shas):
            if norm != prev:
                if ids:
                    ready += close(False)
                    held += len(ids)
                run, prev, sha, ids, chars = run + 1, norm, s, [], []
            ids.append(d)
            chars.append(n)
        if held >= 2_000:
            yield from _merged(ready)
            ready, held = [], 0
    if ids:
        ready += close(True)
    yield from _merged(ready)


def _merged(parts):
    return pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text,
    then the smallest identifier, is kept.  NULL text counts as empty, a NULL
    identifier sorts first; of rows that agree in both, one is kept.  An
    empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = src.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.translate("text", WHITE, "").alias("norm"))
    keyed = keyed.withColumn("sha", F.sha2("norm", 256)).withColumn("prefix", F.substring("norm", 1, PREFIX))
    order = [F.col("prefix"), F.col("sha"), F.col("n_chars").desc(), F.col("doc_id").asc()]
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    rows = stage(ranged.sortWithinPartitions(*order).drop("prefix").mapInArrow(_runs, _RUNS), "content-sort")

    # one row per partition: does its first run continue the last run of the partition before it?
    edges = rows.where("head AND (first_run OR last_run)")
    parts = edges.groupBy("pid").agg(F.max((F.col("first_run") & F.col("last_run")).cast("int")).alias("single"))
    by_pid = Window.orderBy("pid")  # at most one row per partition of the sort
    parts = parts.withColumn("prev_pid", F.lag("pid").over(by_pid))
    first = edges.where("first_run").select("pid", F.col("norm").alias("first_norm"))
    last = edges.where("last_run").select(F.col("pid").alias("prev_pid"), F.col("norm").alias("last_norm"))
    parts = (parts.join(first, "pid").join(last, "prev_pid", "left")
             .select("pid", "single", F.coalesce(F.col("first_norm") == F.col("last_norm"), F.lit(False)).alias("cont")))
    starts = F.max(F.when((F.col("single") == 0) | ~F.col("cont"), F.col("pid"))).over(by_pid)
    parts = parts.withColumn("last_chain", starts).withColumn("first_chain", F.lag("last_chain").over(by_pid))
    runs = (edges.join(parts, "pid")
            .withColumn("chain", F.when(F.col("last_run") & ~(F.col("first_run") & F.col("cont")), F.col("pid"))
                        .when(F.col("first_run") & F.col("cont"), F.col("first_chain"))
                        .when(F.col("last_run"), F.col("last_chain")))
            .where("chain IS NOT NULL")
            .select("pid", "run", "chain", "size", "best_id", "best_chars"))
    totals = runs.groupBy("chain").agg(
        F.sum("size").alias("group_size"), F.count("*").alias("n_runs"),
        F.min(F.struct("pid", "run", "best_id")).alias("best"))
    chained = (runs.join(totals, "chain").where("n_runs > 1")
               .select("pid", "run", F.col("group_size").alias("chain_size"), F.col("best.best_id").alias("chain_id"),
                       ((F.col("best.pid") == F.col("pid")) & (F.col("best.run") == F.col("run"))).alias("chain_head")))
    # at most two runs of each partition of the sort: safe to broadcast
    out = rows.join(F.broadcast(chained), ["pid", "run"], "left")
    in_chain = F.col("chain_size").isNotNull()
    return out.select("doc_id", F.when(in_chain, F.col("chain_id")).otherwise(F.col("best_id")).alias("keep_id"),
                      F.coalesce("chain_size", "size").alias("group_size"),
                      (F.col("head") & F.coalesce("chain_head", F.lit(True))).alias("kept"), "text_sha256")
