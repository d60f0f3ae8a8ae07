"""Vector code compression: product codes found in the Walsh-Hadamard domain, in integers only.

Vectors become integers and are cut into parts; every part is replaced by
the index of its nearest codebook entry.  Parts and entries are padded with
zeros to a power of two and taken through the integer Walsh-Hadamard
transform, whose squared differences add up to exactly ``width`` times the
squared distance.  They are added in sequency order (slow coefficients
first): a few leading coefficients for all entries, then one by one for the
entries that can still win.  An entry is out as soon as its partial sum
exceeds the whole sum of a known entry, so the result is exact, ties
included.

Codebooks are refined by Lloyd rounds.  A round is one pass over the
vectors: every task adds up its parts per entry and sends on at most one row
per entry, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailforge.llm import vectors as V
from retailforge.session import stage

#: leading coefficients that are added for all entries before the first elimination
HEAD = 4
#: vectors that are compared with a codebook at once
ROWS = 2048


def width_of(length: int) -> int:
    return 1 << max(0, length - 1).bit_length()


def sequency_order(width: int) -> np.ndarray:
    """Rows of the natural-order Hadamard matrix by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")


def transformed(x: np.ndarray) -> np.ndarray:
    """(rows, length) integers -> (rows, width) Walsh-Hadamard coefficients in sequency order."""
    width = width_of(x.shape[1])
    out = np.zeros((len(x), width), np.int64)
    out[:, :x.shape[1]] = x
    step = 1
    while step < width:
        pairs = out.reshape(len(x), -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
        step *= 2
    return out[:, sequency_order(width)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each transformed row's nearest transformed entry (ties: the lower), and the squared distance."""
    n, width = x.shape
    head = min(HEAD, width)
    partial = np.zeros((n, len(entries)), np.int64)
    for j in range(head):
        partial += (x[:, j, None] - entries[None, :, j]) ** 2
    known = partial.argmin(1)
    bound = ((x - entries[known]) ** 2).sum(1)
    row, k = np.nonzero(partial <= bound[:, None])
    d = partial[row, k]
    for j in range(head, width):
        d += (x[row, j] - entries[k, j]) ** 2
        alive = d <= bound[row]
        row, k, d = row[alive], k[alive], d[alive]
    # rows ascend, and entries inside a row
    least = np.minimum.reduceat(d, np.searchsorted(row, np.arange(n)))
    best = np.flatnonzero(d == least[row])
    first = best[np.unique(row[best], return_index=True)[1]]
    return k[first], least // width


def _coded(x: np.ndarray, books: list[np.ndarray]):
    """Codes (rows, parts) and squared distance summed over the parts."""
    length = books[0].shape[1]
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        entries = transformed(book)
        for a in range(0, len(x), ROWS):
            part = x[a:a + ROWS, p * length:(p + 1) * length]
            codes[a:a + ROWS, p], d = nearest(transformed(part), entries)
            error[a:a + ROWS] += d
    return codes, error


def _sums(books: list[np.ndarray], dim: int):
    """Vectors -> per part and entry of this task: number and componentwise sum of its parts."""
    def run(batches):
        length, k = books[0].shape[1], len(books[0])
        count, total = np.zeros((len(books), k), np.int64), np.zeros((len(books), k, length), np.int64)
        for batch in batches:
            x = _padded(V.matrix(batch.column(0), dim), length * len(books))
            codes, _ = _coded(x, books)
            for p in range(len(books)):
                count[p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(total[p], codes[:, p], x[:, p * length:(p + 1) * length])
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "s"])
    return run


def _assigned(books: list[np.ndarray], dim: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = _coded(_padded(V.matrix(batch.column(1), dim), books[0].shape[1] * len(books)), books)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(error)], names=["row", "codes", "error"])
    return run


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256,
             rounds: int = 4, scale: int = 1024, dim: int | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """``row, codes, error`` of every usable vector, and the final codebooks (one (entries, length) array per part).

    ``row`` holds all other columns unchanged, whatever their names.  Left out
    are NULL vectors, vectors with NULL or non-finite components, with a
    component beyond ``vectors.LARGEST``, and vectors of another length than
    ``dim`` (default: the most frequent length).  A length that the parts
    do not divide is filled up with zeros.  Codebooks start from the rows
    with the ``entries`` smallest identifiers, copies of an identifier one
    entry each, NULL identifiers never; with fewer rows they have fewer
    entries.  An empty table, or one without identifiers, gives no rows and
    no codebooks.
    """
    col = F.col(f"`{vector_col}`")
    others = [F.col(f"`{c}`") for c in df.columns if c != vector_col]
    usable = df.where(V.finite(col) & V.within_range(col)).select(
        F.struct(*others).alias("row"), F.col(f"`{id_col}`").alias("id"), V.integers(col, scale).alias("v"))
    usable = stage(usable, "code-vectors")
    dim = dim or V.usual_length(usable, "v")
    usable = usable.where(F.size("v") == dim)
    schema = T.StructType([usable.schema["row"], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    seeds = usable.where("id IS NOT NULL").orderBy("id", "v").select("v").limit(entries).collect() if dim else []
    if not seeds:
        return df.sparkSession.createDataFrame([], schema), []
    length = -(-dim // parts)
    start = _padded(np.array([r.v for r in seeds], np.int64), length * parts)
    books = [start[:, p * length:(p + 1) * length] for p in range(parts)]
    for _ in range(rounds):
        sums = usable.select("v").mapInArrow(_sums(books, dim), "part long, entry long, n long, s array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(length)]).alias("s"))
        books = [b.copy() for b in books]
        for r in total.collect():  # at most parts * entries rows
            books[r.part][r.entry] = [x // r.n for x in r.s]
    return usable.select("row", "v").mapInArrow(_assigned(books, dim), schema), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, decimal and joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
