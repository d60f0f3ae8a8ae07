"""Centroid clustering with heap-ordered bounds, in exact integer distances.

Every vector has a gap: a lower bound of its distance to any other centroid
less an upper bound of the distance to its own.  When centroids move, the
gaps of a cluster shrink by at most its own move plus the largest move of the
others, so a cluster keeps one number, its accumulated drift, and a heap of
``gap + drift at insertion``.  Only vectors whose entry has fallen to the
cluster's drift are popped and compared with all centroids exactly; all
others cannot have changed and are not touched.

Vectors lie in blocks.  A block's vectors are written once, in buckets of
the block number; its heaps travel from round to round as a small table that
is joined to them without moving the vectors.  A round sends on sums of the
vectors that changed cluster, added up per task.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailforge.llm import vectors as V
from retailforge.session import discard, release, stage, stage_path

#: vectors of a block
BLOCK = 4096
#: relative widening of every bound, far above the rounding of a double
WIDER = 1e-12
_STATE = "block long, size binary, row binary, key binary, popped long, delta array<long>"


def _blocks(dim: int):
    """``id, v`` -> blocks of up to BLOCK vectors."""
    def run(batches):
        pid, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush(batch):
            ids, x = batch.column(0), V.matrix(batch.column(1), dim, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([pid << 32 | number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "vectors"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n, number = [], 0, number + 1
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids) in 64-bit integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


def _scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and the gap to the second nearest."""
    d = squared_distances(x, centroids)
    own = d.argmin(1)
    at = np.arange(len(x))
    upper = np.sqrt(d[at, own].astype(float)) * (1 + WIDER)
    if len(centroids) == 1:
        return own, np.full(len(x), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    return own, np.sqrt(d.min(1).astype(float)) * (1 - WIDER) - upper


def first_heaps(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> list[list]:
    """All vectors compared with all centroids: one heap of (key, vector) per cluster."""
    own, gap = _scan(x, centroids)
    heaps: list[list] = [[] for _ in centroids]
    for i, (c, g) in enumerate(zip(own.tolist(), gap.tolist())):
        heaps[c].append((g + drift[c], i))
    for h in heaps:
        heapq.heapify(h)
    return heaps


def expired(heaps: list[list], drift: np.ndarray) -> list[tuple[int, int]]:
    """Pops the (cluster, vector) entries whose gap may be used up; an equal distance counts, for ties."""
    out = []
    for c, h in enumerate(heaps):
        limit = drift[c] * (1 + WIDER)
        while h and h[0][0] <= limit:
            out.append((c, heapq.heappop(h)[1]))
    return out


def _round(centroids: np.ndarray, drift: np.ndarray, first: bool):
    """Blocks (with their heaps) -> heaps after one assignment, and what it changed in the clusters' sums."""
    k, dim = centroids.shape

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, x = batch.column(0)[i].as_py(), _vectors(batch.column(1)[i], dim)
                change = np.zeros((k, dim + 1), np.int64)
                if first:
                    heaps = first_heaps(x, centroids, drift)
                    popped = len(x)
                    for c, h in enumerate(heaps):
                        rows = [r for _, r in h]
                        change[c, 0], change[c, 1:] = len(rows), x[rows].sum(0)
                else:
                    heaps = _heaps(*[batch.column(j)[i].as_py() for j in (2, 3, 4)])
                    out = expired(heaps, drift)
                    popped = len(out)
                    if out:
                        rows = np.array([r for _, r in out])
                        own, gap = _scan(x[rows], centroids)
                        for (old, r), c, g in zip(out, own.tolist(), gap.tolist()):
                            heapq.heappush(heaps[c], (g + drift[c], r))
                            if c != old:
                                for to, sign in ((old, -1), (c, 1)):
                                    change[to, 0] += sign
                                    change[to, 1:] += sign * x[r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *_state(heaps), pa.array([popped], pa.int64()), pa.array([change.ravel().tolist()], pa.list_(pa.int64()))],
                    names=["block", "size", "row", "key", "popped", "delta"])
    return run


def _vectors(cell, dim: int) -> np.ndarray:
    return np.frombuffer(cell.as_py(), np.int32).reshape(-1, dim).astype(np.int64)


def _state(heaps: list[list]) -> list[pa.Array]:
    """Heaps one behind the other, each in heap order."""
    flat = [e for h in heaps for e in h]
    arrays = (np.array([len(h) for h in heaps], "<i4"), np.array([r for _, r in flat], "<i4"), np.array([x for x, _ in flat], "<f8"))
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def _heaps(size: bytes, row: bytes, key: bytes) -> list[list]:
    entries = list(zip(np.frombuffer(key, "<f8").tolist(), np.frombuffer(row, "<i4").tolist()))
    stop = np.cumsum(np.frombuffer(size, "<i4")).tolist()
    return [entries[a:b] for a, b in zip([0, *stop], stop)]


def _summed(batches):
    """Sum of the blocks' changes in this task."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = V.matrix(batch.column(0), len(batch.column(0)[0]))
            total = x.sum(0) if total is None else total + x.sum(0)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pos", "s"])


def _members(centroids: np.ndarray):
    """Blocks and final heaps -> one row per vector with its exact distance."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _vectors(batch.column(1)[i], centroids.shape[1])
                own = np.zeros(len(x), np.int64)
                for c, h in enumerate(_heaps(*[batch.column(j)[i].as_py() for j in (2, 3, 4)])):
                    own[[r for _, r in h]] = c
                d = ((x - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(own.astype(np.int32)), pa.array(d)],
                                                 names=["id", "cluster", "distance"])
    return run


def cluster_vectors(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = 5, scale: int = 256,
                    dim: int = 64, seed: str = "2", trace: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of every usable vector, and the final (k, dim) integer centroids.

    Left out are NULL vectors, vectors of another length than ``dim``, and
    those with NULL or non-finite components or a component beyond
    ``vectors.LARGEST``.  Centroids start as the rows with the smallest
    SHA-256 of ``<seed>:<id>``; rows of one identifier follow each other by
    their components, rows without an identifier are clustered but never
    start one.  With fewer rows there are fewer clusters; an empty table, or one without
    identifiers, gives no rows and no centroids.  Empty clusters keep their
    centroid.  ``trace`` receives the number of vectors compared per round.
    """
    spark = df.sparkSession
    col = F.col(f"`{vector_col}`")
    usable = df.where(F.size(col) == dim).where(V.finite(col) & V.within_range(col)).select(
        F.col(f"`{id_col}`").alias("id"), V.integers(col, scale).alias("v"))
    id_type = usable.schema["id"].dataType
    found = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    seeds = (usable.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
             .orderBy("h", "v").limit(k).select("v").collect())
    if not seeds:
        return spark.createDataFrame([], found), np.zeros((0, dim), np.int64)
    centroids = np.array([r.v for r in seeds], np.int64)
    k = len(centroids)

    name = f"cluster_blocks_{uuid.uuid4().hex}"
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("vectors", T.BinaryType())])
    path = stage_path(spark, "cluster-blocks")
    (usable.mapInArrow(_blocks(dim), shape).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
     .option("path", path).saveAsTable(name))
    blocks = spark.table(name)

    drift, sums, state = np.zeros(k), np.zeros((k, dim + 1), np.int64), None
    for step in range(rounds + 1):
        if state is None:
            rows = blocks.select("block", "vectors")
        else:
            rows = blocks.select("block", "vectors").join(state.select("block", "size", "row", "key").hint("shuffle_hash"), "block")
        new = stage(rows.mapInArrow(_round(centroids, drift, state is None), _STATE), "cluster-heaps")
        if state is not None:
            release(state)
        state = new
        if trace is not None:
            trace.append(state.agg(F.sum("popped")).first()[0])
        if step == rounds:
            break
        change = state.select("delta").mapInArrow(_summed, "pos long, s long").groupBy("pos").agg(F.sum("s").alias("s")).collect()
        flat = sums.ravel()
        for r in change:  # k * (dim + 1) numbers
            flat[r.pos] += r.s
        moved = centroids.copy()
        some = sums[:, 0] > 0
        moved[some] = sums[some, 1:] // sums[some, :1]
        move = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)) * (1 + WIDER)
        for c in range(k):
            drift[c] += move[c] + max([*move[:c], *move[c + 1:]], default=0.0)
        centroids = moved
    out = blocks.select("block", "ids", "vectors").join(state.select("block", "size", "row", "key").hint("shuffle_hash"), "block")
    out = stage(out.select("ids", "vectors", "size", "row", "key").mapInArrow(_members(centroids), found), "clusters")
    release(state)
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)
    return out, centroids


def centroid_sha256(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
