"""Best-fit packing of documents into token sequences, with swap-based local search.

Documents are encoded, closed with an end token and cut into pieces of at
most ``CAPACITY`` tokens; full pieces are sequences of their own.  The others
are dealt over shards of bounded size by a hash.  In a shard, best-fit
decreasing places them, then documents move between underfull bins - one by
one, one for one, or two for one - whenever that raises the sum of squared
fills, which drains the emptiest bins until they vanish.  The few least full
bins of all shards are dealt again over fewer shards, until one is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailforge.llm import bpe
from retailforge.llm.common import tidy
from retailforge.llm.tokencount import piece_sizes, vocabulary_path
from retailforge.session import stage

CAPACITY = 1024
END = 2
#: pieces of a shard, and least full bins of each that are packed again
SHARD, CARRY = 16_384, 12


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        e = bpe.encoder(vocabulary_path(path), counts=False)
        for batch in batches:
            ids_in = batch.column(0)
            rows, piece, start, length, crc = [], [], [], [], []
            for p in e.blocks(batch.column(1)):
                r, sizes = piece_sizes(p, e)
                special = p.special >= 0
                flat = np.empty(int(sizes.sum()), np.uint32)
                if special.any():
                    own = np.repeat(special, sizes)
                    flat[~own] = e.tokens.gather(r[~special])
                    flat[own] = p.special[special]
                else:
                    flat = e.tokens.gather(r)
                stop = np.concatenate([[0], np.cumsum(sizes)])[p.first].tolist()
                for i in range(len(stop) - 1):
                    ids = np.append(flat[stop[i]:stop[i + 1]], np.uint32(end)).astype("<u4")
                    n = len(ids)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]  # the first piece may be shorter
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(p.row + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [ids_in.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items, longest first, each into the fullest bin that still has room: lists of item numbers."""
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = 0  # bit f: some bin has f free
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        above = levels >> s
        if above:
            f = s + ((above & -above).bit_length() - 1)
            b = free_bins[f].pop()
            if not free_bins[f]:
                levels &= ~(1 << f)
        else:
            f, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if f - s:
            free_bins[f - s].append(b)
            levels |= 1 << (f - s)
    return bins


class LocalSearch:
    """Moves and exchanges between underfull bins.

    A step takes tokens out of one bin and fills another: a document moves
    into the fullest bin with room for it, or one or two documents are
    exchanged for a smaller one: so that the other bin becomes exactly full,
    or else for the most that it can gain.  Each step raises the sum of
    squared fills, so the search ends - where no step is left.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        #: (free, size) -> underfull bins that had that much room and such a document; free -> bins
        self.holding: dict[tuple[int, int], set[int]] = {}
        self.free: dict[int, set[int]] = {}
        #: free -> the sizes that its bins hold, ascending
        self.held: dict[int, list[int]] = {}
        for b in range(len(bins)):
            self._list(b)

    def _list(self, b: int, add: bool = True) -> None:
        f = self.capacity - self.fill[b]
        if not f or not self.bins[b]:
            return
        held = self.held.setdefault(f, [])
        for n in {self.sizes[i] for i in self.bins[b]}:
            at = self.holding.setdefault((f, n), set())
            if add:
                if not at:
                    insort(held, n)
                at.add(b)
            else:
                at.discard(b)
                if not at:
                    del self.holding[(f, n)], held[bisect_left(held, n)]
        at = self.free.setdefault(f, set())
        at.add(b) if add else at.discard(b)
        if not at:
            del self.free[f], self.held[f]

    def _exchange(self, a: int, b: int, go: list[int], come: list[int]) -> None:
        self._list(a, False)
        self._list(b, False)
        for i in go:
            self.bins[a].remove(i)
            self.bins[b].append(i)
        for i in come:
            self.bins[b].remove(i)
            self.bins[a].append(i)
        d = sum(self.sizes[i] for i in go) - sum(self.sizes[i] for i in come)
        self.fill[a] -= d
        self.fill[b] += d
        self._list(a)
        self._list(b)

    def _other(self, at: set[int] | None, a: int) -> int | None:
        return next((b for b in at if b != a), None) if at else None

    def _best(self, a: int, n: int, levels: list[int]) -> tuple[int, int, int] | None:
        """(gain, free, size) of the exchange of ``n`` tokens of bin ``a`` for one smaller document that gains the other bin most."""
        best, room = None, self.capacity - self.fill[a]
        for f in reversed(levels):
            if best and f <= best[0]:
                break
            held = self.held[f]
            for k in range(bisect_left(held, n - f), len(held)):
                gain = n - held[k]
                if gain <= max(0, f - room, best[0] if best else 0):
                    break
                if self._other(self.holding[(f, held[k])], a) is not None:
                    best = gain, f, held[k]
                    break
        return best

    def _trade(self, a: int, go: list[int], best: tuple[int, int, int]) -> bool:
        _, f, n = best
        b = self._other(self.holding[(f, n)], a)
        self._exchange(a, b, go, [next(i for i in self.bins[b] if self.sizes[i] == n)])
        return True

    def step(self, a: int) -> bool:
        """One step out of bin ``a``; False if there is none."""
        size, levels = self.sizes, sorted(self.free)
        mine = {size[i]: i for i in self.bins[a]}  # one document per size stands for all
        for n in sorted(mine, reverse=True):
            for f in levels:  # the least room that is enough
                b = self._other(self.free[f], a) if f >= n else None
                if b is not None and self.fill[b] + n > self.fill[a]:
                    self._exchange(a, b, [mine[n]], [])
                    return True
        for f in reversed(levels):
            for n, i in mine.items():
                b = self._other(self.holding.get((f, n - f)), a)
                if b is not None:
                    self._exchange(a, b, [i], [next(j for j in self.bins[b] if size[j] == n - f)])
                    return True
        items = sorted(self.bins[a], key=lambda i: size[i])
        tried = set()
        for k, i in enumerate(items):
            for j in items[k + 1:]:
                n = size[i] + size[j]
                if n in tried or n > 2 * self.capacity:
                    continue
                tried.add(n)
                for f in reversed(levels):
                    b = self._other(self.holding.get((f, n - f)), a)
                    if b is not None:
                        self._exchange(a, b, [i, j], [next(x for x in self.bins[b] if size[x] == n - f)])
                        return True
        # no exchange fills a bin: the one that gains another most, of one document or else of two
        best = max(((x, n) for n in mine if (x := self._best(a, n, levels))), default=None)
        if best:
            return self._trade(a, [mine[best[1]]], best[0])
        best, go, tried = None, [], set()
        for k, i in enumerate(items):
            for j in items[k + 1:]:
                n = size[i] + size[j]
                if n not in tried:
                    tried.add(n)
                    x = self._best(a, n, levels)
                    if x and (best is None or x > best):
                        best, go = x, [i, j]
        return self._trade(a, go, best) if best else False

    def run(self) -> list[list[int]]:
        bound = -(-sum(self.fill) // self.capacity)
        left = sum(1 for b in self.bins if b)
        while True:
            steps = 0
            under = sorted((b for at in self.free.values() for b in at), key=lambda b: (self.fill[b], b))
            for a in under:
                if left <= bound:
                    break
                while self.bins[a] and self.fill[a] < self.capacity and self.step(a):
                    steps += 1
                left -= not self.bins[a]
            if not steps or left <= bound:
                break
        return [b for b in self.bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    return LocalSearch(sizes, best_fit(sizes, capacity), capacity).run()


def _pack_shard(capacity: int, carry: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid").reset_index(drop=True)
        sizes, uid = pdf["length"].tolist(), pdf["uid"].to_numpy()
        bins = pack(sizes, capacity)
        fills = [sum(sizes[i] for i in b) for b in bins]
        again = set(sorted((k for k in range(len(bins)) if fills[k] < capacity), key=lambda k: fills[k])[:carry])
        seq, off, open_ = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i], open_[i] = uid[b[0]], at, k in again
                at += sizes[i]
        return pd.DataFrame({"uid": uid, "length": pdf["length"], "sequence_id": seq, "offset": off, "open": open_})
    return run


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end: int = END, shard: int = SHARD, carry: int = CARRY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    NULL text is empty and packs as the end token alone.  Repeated rows are
    packed each for itself.  An empty table gives no rows; other columns are
    ignored.  A shard of ``shard`` pieces is one task's work.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = src.mapInArrow(tidy(_pieces(vocabulary, capacity, end)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stage(pieces.withColumn("uid", F.monotonically_increasing_id()), "token-pieces")
    open_ = pieces.where(F.col("length") < capacity).select("uid", "length")
    placed = pieces.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n, before = open_.count(), None
    while n:
        shards = -(-n // shard)
        # where the least full bins hold most pieces, packing them again gains little: the round places all
        again = carry if shards > 1 and (before is None or 2 * n <= before) else 0
        dealt = (open_.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
                 .repartition(shards, "shard").groupBy("shard")
                 .applyInPandas(_pack_shard(capacity, again),
                                "uid long, length long, sequence_id long, offset long, open boolean"))
        dealt = stage(dealt, "packed-shards")
        placed = placed.unionByName(dealt.where("NOT open").select("uid", "sequence_id", "offset"))
        open_ = dealt.where("open").select("uid", "length")
        n, before = open_.count() if again else 0, n
    return pieces.join(placed, "uid").drop("uid")
