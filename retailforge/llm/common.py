"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailforge.session import configure, stage
from retailforge.sources.tables import read_table

#: Rows of one Arrow batch: texts can be long, so batches stay small and a worker holds few of them.
ARROW_ROWS, ARROW_BYTES = 512, "16m"


def prepare(spark: SparkSession) -> None:
    """Session settings of every query of this subpackage."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def give_back() -> None:
    """Return freed memory to the system; a reused worker otherwise keeps the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """A function of Arrow batches whose worker gives freed memory back before and after it."""
    def tidied(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


_held: dict = {}


def held(key, make):
    """``make()``, kept by this process until another key is asked for.

    A worker serves the operators one after another; it holds the vocabulary
    of one of them, not of all that it has met.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
        give_back()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def small_enough(df: DataFrame, max_rows: int, size: Column | None = None, max_bytes: int = 0) -> bool:
    """True when ``df`` has at most ``max_rows`` rows, whose ``size`` sums up to ``max_bytes`` at most; reads no further than those rows."""
    if size is None:
        return df.limit(max_rows + 1).count() <= max_rows
    got = df.select(size.cast("long").alias("size")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    return got.n <= max_rows and got.b <= max_bytes


def with_row(df: DataFrame, text_col: str) -> DataFrame:
    """``(row, text)``: all columns as one struct, so that result columns cannot clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))


def sorted_groups(batches, keys: int):
    """Groups of equal leading ``keys`` long columns of sorted Arrow batches: yields lists of batch slices."""
    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(c[a]) for c in cols)
            if key != last and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def column(parts: list[pa.RecordBatch], i: int) -> pa.Array:
    return parts[0].column(i) if len(parts) == 1 else pa.concat_arrays([p.column(i) for p in parts])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the connected components of ``(a, b)`` long pairs; root is the smallest node.

    Large-star and small-star steps alternate until nothing changes; each
    step is two shuffles of at most two rows per edge, written to the shared
    folder so that a lost executor costs one step.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before or not state.n:
            break
        before = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        links = stage(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
                      .where("a <> b").distinct(), "links")
    return links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
