"""Embedding near-duplicates by range search over a robust-pruned flat graph.

Vectors of one direction are one class.  Classes are dealt to overlapping
cluster shards: a shard that is too large is split by centres fitted on a
sample of its own, every class going to its nearest ``overlap`` centres,
until all shards are small.  Each shard builds a graph (nearest and random
candidates, thinned out by robust pruning); the lists that a class got in
its shards are united.  A list may lead out of a shard, since the neighbour
stands in other shards as well: the search goes on there.

Every class is a query.  In each of its shards it starts from the medoid and
from itself, follows a beam of the most similar nodes, and expands every node
in range until none is left.  A node in range that also stands in a shard
the query has not seen is a message: the query visits that shard in the next
round, starting there, until no messages are left.  Links are cosines in
double precision; a task sends on sums and a spanning forest of the links
it found, never the pairs.  A link is counted in the first shard that both
ends share, and for a visit in the first visited shard of the other end.

Recall is audited against all vectors; while it is too low the graph is
built again with more overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailforge.llm import vectors as V
from retailforge.llm.common import column, components, small_enough, sorted_groups
from retailforge.session import release, stage

#: vectors that a shard is meant to have, and from which on it is split
TARGET, LIMIT = 2048, 8192
#: vectors that the centres of one split are fitted on, most centres, rounds of the fit, splits of a shard
SAMPLE, CENTRES, FIT_ROUNDS, LEVELS = 8192, 256, 6, 6
#: graph: candidates (nearest, random), kept of each, reverse edges of a node, and the pruning factor
NEAREST, RANDOM, DEGREE, LONG, REVERSE, ALPHA = 48, 24, 24, 6, 48, 1.2
#: search: most similar nodes that are followed, and how far below the threshold nodes are still expanded
BEAM, SLACK = 4, 0.05
#: audit: queries of either kind, wanted recall, most overlap
AUDIT, RECALL, MOST_OVERLAP = 64, 0.98, 4
SHIFT = CENTRES + 1
#: queries that are searched at once, and (query, node) pairs that are expanded at once
BLOCK, EXPANDED = 512, 50_000
BROADCAST_ROWS = 500_000


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast hint for tables of a few long columns that are checked to be small."""
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


# -- classes ------------------------------------------------------------------

def _unit_rows(batches):
    """``row, v`` -> ``row, u, key``: the unit vector, and its components in steps of 1e-12, so that multiples are equal."""
    for b in batches:
        units, keys = [], []
        for v in b.column(1).to_pylist():
            if v is None:
                units.append(None)
                keys.append(None)
                continue
            x = np.array(v)
            x /= np.abs(x).max()
            x /= np.sqrt(x @ x)
            units.append(x.tobytes())
            keys.append(np.rint(x * 1e12).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.binary()), pa.array(keys, pa.binary())], names=["row", "u", "key"])


def _keyed(df: DataFrame, vector_col: str) -> DataFrame:
    """``row, u, key, h``: key is NULL for vectors that link with nothing."""
    col = F.col(f"`{vector_col}`")
    usable = V.finite(col) & F.exists(col, lambda x: x != 0)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != vector_col]).alias("row"),
                     F.when(usable, F.transform(col, lambda x: x.cast("double"))).alias("v"))
    shape = T.StructType([rows.schema["row"], T.StructField("u", T.BinaryType()), T.StructField("key", T.BinaryType())])
    return rows.mapInArrow(_unit_rows, shape).withColumn("h", F.xxhash64("key"))


def _stack(col: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), np.float64)
    return x.reshape(len(col), -1) if len(col) else x.reshape(0, 0)


# -- shards -------------------------------------------------------------------

def fit_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A few rounds of k-means over a sample, from sample rows; around the mean, so that close vectors stay apart."""
    mean = x.mean(0)
    y = x - mean
    c = y[np.sort(np.random.default_rng(seed).permutation(len(y))[:k])]
    for _ in range(FIT_ROUNDS):
        own = nearest_centres(y, c, 1)[:, 0]
        for j in np.unique(own):
            c[j] = y[own == j].mean(0)
    return c + mean


def nearest_centres(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    mean = c.mean(0)
    x, c = x - mean, c - mean
    d = (c * c).sum(1) - 2 * (x @ c.T)
    n = min(n, len(c))
    return np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(x), 1))


def _fit(overlap: int, target: int):
    def run(pdf):
        import pandas as pd
        shard, n = int(pdf["shard"].iloc[0]), int(pdf["n"].iloc[0])
        pdf = pdf.sort_values("node")
        x = np.frombuffer(b"".join(pdf["u"]), np.float64).reshape(len(pdf), -1)
        k = max(2 * overlap + 1, min(CENTRES, -(-overlap * n // target)))
        return pd.DataFrame({"shard": [shard], "u": [fit_centres(x, min(k, len(x)), shard % (1 << 31)).tobytes()]})
    return run


def _deal(overlap: int):
    """Groups of (shard, salt): the centres (kind 0), then vectors -> each vector once per near centre, in the new shard."""
    def run(batches):
        for parts in sorted_groups(batches, 2):
            shard, kind, u = column(parts, 0)[0].as_py(), column(parts, 2).to_numpy(), column(parts, 5)
            node, w = column(parts, 3).to_numpy(), column(parts, 4).to_numpy()
            rows = np.flatnonzero(kind == 1)
            if not len(rows):
                continue
            x = _stack(u.take(pa.array(rows)))
            c = np.frombuffer(u[0].as_py(), np.float64).reshape(-1, x.shape[1])
            to = nearest_centres(x, c, overlap)
            at = np.repeat(rows, to.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(shard * SHIFT + 1 + to.ravel()), pa.array(node[at]), pa.array(w[at]), u.take(pa.array(at))],
                                             names=["shard", "node", "w", "u"])
    return run


def _salted(sizes: DataFrame, per: int) -> DataFrame:
    return sizes.withColumn("salts", F.ceil(F.col("n") / per).cast("long"))


def _each_salt() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")


def deal_out(members: DataFrame, overlap: int, target: int, limit: int) -> DataFrame:
    """``shard, node, w, u`` with shards split until none has more than ``limit`` vectors."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for level in range(LEVELS):
        sizes = stage(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > limit), "large-shards")
        if sizes.isEmpty():
            release(sizes)
            break
        salted = _salted(sizes, limit)
        large = members.join(_checked(salted), "shard")
        sample = large.where(F.pmod(F.xxhash64("node", F.lit(level)), F.col("n")) < SAMPLE).select("shard", "n", "node", "u")
        centres = stage(sample.groupBy("shard").applyInPandas(_fit(overlap, target), "shard long, u binary"), "centres")
        head = centres.join(salted, "shard").select("shard", _each_salt(), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("w"), "u")
        body = large.select("shard", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "node", "w", "u")
        dealt = (head.unionByName(body).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
                 .mapInArrow(_deal(overlap), "shard long, node long, w long, u binary"))
        small = members.join(_checked(sizes.select("shard")), "shard", "left_anti").withColumn("shard", F.col("shard") * SHIFT)
        new = stage(small.unionByName(dealt), "shards")
        release(members, sizes, centres)
        members = new
    return members


# -- graph --------------------------------------------------------------------

def robust_prune(x: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Per row of ``of``, up to ``degree`` of its candidates (indices into x; -1: none).

    The nearest candidate is kept; those that are ``alpha`` times closer to
    it than to the row itself go; and so on with the nearest of the rest.
    """
    d = 2 - 2 * np.einsum("ij,ikj->ik", x[of], x[cand])
    d[cand == of[:, None]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    y = x[cand]
    between = alpha * alpha * (2 - 2 * np.matmul(y, y.transpose(0, 2, 1)))
    alive, out, at = np.isfinite(d), np.full((len(of), degree), -1), np.arange(len(of))
    # a node that comes twice counts once
    twice = np.argsort(cand, axis=1, kind="stable")
    c = np.take_along_axis(cand, twice, 1)
    np.put_along_axis(alive, twice[:, 1:], np.take_along_axis(alive, twice[:, 1:], 1) & (c[:, 1:] != c[:, :-1]), 1)
    for j in range(degree):
        first = alive.argmax(1)
        some = alive[at, first]
        if not some.any():
            break
        out[some, j] = cand[some, first[some]]
        alive &= ~(some[:, None] & (between[at, first] <= d))
        alive[at, first] = False
    return out


def build_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency lists (indices into x): pruned nearest and random candidates, and their reverse edges."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    near, rng, lists = min(NEAREST, m - 1), np.random.default_rng(seed), []
    for a in range(0, m, BLOCK):
        of = np.arange(a, min(a + BLOCK, m))
        s = x[of] @ x.T
        s[np.arange(len(of)), of] = -np.inf
        top = np.argpartition(-s, near - 1, axis=1)[:, :near]
        far = rng.integers(0, m, (len(of), RANDOM))
        lists.append(np.hstack([robust_prune(x, of, top, DEGREE), robust_prune(x, of, far, LONG)]))
    out = np.vstack(lists)
    p, j = np.nonzero(out >= 0)
    q = out[p, j]
    # reverse edges: of each node the most similar ones
    similar = np.einsum("ij,ij->i", x[p], x[q])
    order = np.lexsort((-similar, q))
    q2, p2 = q[order], p[order]
    rank = np.arange(len(q2)) - np.searchsorted(q2, q2)
    q2, p2 = q2[rank < REVERSE], p2[rank < REVERSE]
    edges = np.unique(np.concatenate([p * m + q, q2 * m + p2]))
    return np.split(edges % m, np.searchsorted(edges, np.arange(1, m) * m))


def _build(batches):
    """Sorted ``shard, node, w, u`` -> adjacency lists and the medoid of each shard."""
    for parts in sorted_groups(batches, 1):
        shard, node, w, u = (column(parts, i) for i in range(4))
        x, ids = _stack(u), node.to_numpy()
        lists = build_graph(x, abs(int(shard[0].as_py())) % (1 << 31))
        medoid = np.zeros(len(x), bool)
        medoid[(x @ x.mean(0)).argmax()] = True
        for a in range(0, len(x), BLOCK):
            yield pa.RecordBatch.from_arrays(
                [shard.slice(a, BLOCK), node.slice(a, BLOCK), w.slice(a, BLOCK), u.slice(a, BLOCK), pa.array(medoid[a:a + BLOCK]),
                 pa.array([ids[n] for n in lists[a:a + BLOCK]], pa.list_(pa.int64()))], names=["shard", "node", "w", "u", "medoid", "near"])


def united_graph(members: DataFrame) -> DataFrame:
    """``shard, node, w, u, medoid, shards, near``: each class in each of its shards, with its lists united."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = members.select("shard", "node", "w", "u").repartition(parts, "shard").sortWithinPartitions("shard", "node").mapInArrow(
        _build, "shard long, node long, w long, u binary, medoid boolean, near array<long>")
    # at most overlap ** levels lists a node
    one = lists.groupBy("node").agg(F.first("w").alias("w"), F.first("u").alias("u"), F.array_sort(F.collect_list(F.struct("shard", "medoid"))).alias("places"),
                                    F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    shards = F.transform("places", lambda p: p["shard"]).alias("shards")
    return stage(one.select(F.explode("places").alias("p"), "node", "w", "u", shards, "near").select(
        "p.shard", "node", "w", "u", "p.medoid", "shards", "near"), "near-graph")


# -- search -------------------------------------------------------------------

def range_search(x: np.ndarray, first: np.ndarray, near: np.ndarray, q: np.ndarray, start_q: np.ndarray, start_u: np.ndarray, low: float):
    """Greedy search for many queries at once: (query, node, cosine) of all nodes reached with cosine >= low.

    ``near[first[i]:first[i + 1]]`` are the neighbours of node i.  A query
    expands the BEAM most similar nodes it has met, and every node in range.
    """
    m, seen = len(x), np.zeros(len(q) * len(x), bool)
    beam_q = beam_u = np.zeros(0, np.int64)
    beam_s, done = np.zeros(0), np.zeros(0, bool)
    hits = []
    key, waiting = np.unique(start_q * m + start_u), np.zeros(0, np.int64)
    while len(key) or len(waiting):
        seen[key] = True
        nq, nu = key // m, key % m
        ns = np.concatenate([np.einsum("ij,ij->i", q[nq[a:a + 65536]], x[nu[a:a + 65536]]) for a in range(0, len(key), 65536)])
        inside = ns >= low
        hits.append((nq[inside], nu[inside], ns[inside]))
        # the beam of each query: most similar first
        bq, bu, bs = np.concatenate([beam_q, nq]), np.concatenate([beam_u, nu]), np.concatenate([beam_s, ns])
        bd = np.concatenate([done, np.zeros(len(nq), bool)])
        order = np.lexsort((bu, -bs, bq))
        bq, bu, bs, bd = bq[order], bu[order], bs[order], bd[order]
        keep = np.arange(len(bq)) - np.searchsorted(bq, bq) < BEAM
        beam_q, beam_u, beam_s, done = bq[keep], bu[keep], bs[keep], bd[keep]
        grow = np.concatenate([np.unique(np.concatenate([(beam_q * m + beam_u)[~done], key[inside]])), waiting])
        grow, waiting = grow[:EXPANDED], grow[EXPANDED:]
        done = np.ones(len(beam_q), bool)
        gq, gu = grow // m, grow % m
        n = first[gu + 1] - first[gu]
        at = np.repeat(first[gu] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        key = np.repeat(gq, n) * m + near[at]
        key = np.unique(key[~seen[key]])
    return [np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, np.int64 if i < 2 else float) for i in range(3)]


class Shard:
    """The graph rows of one shard, and what queries found in them."""

    def __init__(self, shard, node, w, u, medoid, shards, near):
        self.shard, self.ids, self.w, self.x = shard, node, w, _stack(u)
        self.medoid = np.flatnonzero(medoid)
        self.shards = [np.array(s, np.int64) for s in shards]
        # members of other shards, by shard
        self.also: dict[int, np.ndarray] = {}
        for i, s in enumerate(self.shards):
            for c in s.tolist():
                self.also.setdefault(c, np.zeros(len(node), bool))[i] = True
        flat, size = near.flatten().to_numpy(zero_copy_only=False), near.value_lengths().to_numpy(zero_copy_only=False)
        inside = self.position(flat)
        ok = inside >= 0
        owner = np.repeat(np.arange(len(node)), size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(owner[ok], minlength=len(node)))])
        self.near = inside[ok]

    def position(self, ids: np.ndarray) -> np.ndarray:
        """Index of identifiers in this shard, -1 for others; ``ids`` of the shard ascend."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def counted(self, us: np.ndarray, before: list[int], now: list[int]) -> np.ndarray:
        """Which of the found nodes are this shard's to count for a query that has seen ``before`` and sees ``now``."""
        out = np.ones(len(us), bool)
        for c in [*before, *[c for c in now if c < self.shard]]:
            if c in self.also:
                out &= ~self.also[c][us]
        return out


_FOUND = "kind int, q long, a long, b long, u binary, known array<long>"


class _Rows:
    """Result rows: 0 (query, links), 1 (node, linked node), 2 (query, shard to visit, node to start from, vector, shards seen)."""

    def __init__(self):
        self.cols = [[], [], [], [], [], []]

    def add(self, kind, q, a, b=0, u=None, known=None):
        for c, v in zip(self.cols, (kind, q, a, b, u, known)):
            c.append(v)

    def batch(self):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.cols, kinds)], names=["kind", "q", "a", "b", "u", "known"])


def _report(rows: _Rows, s: Shard, label: np.ndarray, q_id: int, q_at: int, us, sims, threshold: float, before, now, vector):
    """One query's findings: links to count, edges that join what was apart in this task, shards still to visit."""
    order = np.lexsort((us, -sims))
    us, sims = us[order], sims[order]
    links = us[(sims >= threshold) & (s.ids[us] != q_id)]
    if len(links):
        n = int(s.w[links[s.counted(links, before, now)]].sum())
        if n:
            rows.add(0, q_id, n)
        own = label[q_at]
        apart, at = np.unique(label[links], return_index=True)
        for l, i in zip(apart.tolist(), at.tolist()):
            if l != own:
                rows.add(1, q_id, int(s.ids[links[i]]))
        if len(apart) > 1 or apart[0] != own:
            label[np.isin(label, apart)] = own
    known = {*before, *now}
    for c, stand in s.also.items():
        if c not in known and stand[us].any():
            rows.add(2, q_id, c, int(s.ids[us[stand[us].argmax()]]), vector, sorted(known))


def _graph_shard(parts, rows: slice) -> Shard:
    get = lambda name: _named(parts, name).slice(rows.start, rows.stop - rows.start)
    return Shard(_named(parts, "shard")[0].as_py(), get("node").to_numpy(), get("w").to_numpy(), get("u"), get("medoid").to_numpy(zero_copy_only=False),
                 get("shards").to_pylist(), get("near"))


def _named(parts, name: str):
    return column(parts, parts[0].schema.names.index(name))


def _search_own(threshold: float):
    """Sorted graph rows -> findings of every class in its own shards."""
    def run(batches):
        for parts in sorted_groups(batches, 1):
            s = _graph_shard(parts, slice(0, sum(p.num_rows for p in parts)))
            m = len(s.ids)
            # (query, node): links found from either side, and nodes in the wider range
            found, label = np.zeros((m, m), bool), np.arange(m)
            wide_q, wide_u, wide_s = [], [], []
            for a in range(0, m, BLOCK):
                of = np.arange(a, min(a + BLOCK, m))
                n = len(of)
                q, u, sim = range_search(s.x, s.first, s.near, s.x[of], np.concatenate([np.arange(n), np.repeat(np.arange(n), len(s.medoid))]),
                                         np.concatenate([of, np.tile(s.medoid, n)]), threshold - SLACK)
                found[q[sim >= threshold] + a, u[sim >= threshold]] = True
                near = sim < threshold
                wide_q.append(q[near] + a)
                wide_u.append(u[near])
                wide_s.append(sim[near])
            for a in range(0, m, BLOCK):
                both = found[a:a + BLOCK] | found[:, a:a + BLOCK].T
                found[a:a + BLOCK] = both
                found[:, a:a + BLOCK] = both.T
            wq, wu, ws = np.concatenate(wide_q), np.concatenate(wide_u), np.concatenate(wide_s)
            order = np.argsort(wq, kind="stable")
            wq, wu, ws = wq[order], wu[order], ws[order]
            stop = np.searchsorted(wq, np.arange(m + 1))
            rows = _Rows()
            for i in range(m):
                us = np.flatnonzero(found[i])
                wide = slice(stop[i], stop[i + 1])
                if len(us) == 1 and wide.start == wide.stop:
                    continue  # itself alone
                sims = np.maximum(s.x[us] @ s.x[i], threshold)
                _report(rows, s, label, int(s.ids[i]), i, np.concatenate([us, wu[wide]]), np.concatenate([sims, ws[wide]]), threshold,
                        [], s.shards[i].tolist(), s.x[i].tobytes())
                if len(rows.cols[0]) > 8192:
                    yield rows.batch()
                    rows = _Rows()
            yield rows.batch()
    return run


def _search_visits(threshold: float):
    """Groups of (shard, salt): graph rows (kind 0), then visiting queries -> the queries' findings."""
    def run(batches):
        for parts in sorted_groups(batches, 2):
            kind = column(parts, 2).to_numpy()
            g = int((kind == 0).sum())
            if g == len(kind) or not g:
                continue
            s = _graph_shard(parts, slice(0, g))
            ids = _named(parts, "node").slice(g)
            u = _named(parts, "u").slice(g)
            before, now, entries = (_named(parts, c).slice(g).to_pylist() for c in ("shards", "now", "near"))
            label, rows = np.arange(len(s.ids) + len(ids)), _Rows()
            for a in range(0, len(ids), BLOCK):
                vectors = _stack(u.slice(a, BLOCK))
                n = len(vectors)
                start = [np.union1d(s.position(np.array(e, np.int64)), s.medoid) for e in entries[a:a + n]]
                q, hit, sim = range_search(s.x, s.first, s.near, vectors, np.repeat(np.arange(n), [len(e) for e in start]), np.concatenate(start),
                                           threshold - SLACK)
                order = np.argsort(q, kind="stable")
                q, hit, sim = q[order], hit[order], sim[order]
                stop = np.searchsorted(q, np.arange(n + 1))
                for i in range(n):
                    at = slice(stop[i], stop[i + 1])
                    _report(rows, s, label, ids[a + i].as_py(), len(s.ids) + a + i, hit[at], sim[at], threshold, before[a + i], now[a + i],
                            vectors[i].tobytes())
            yield rows.batch()
    return run


def search_all(graph: DataFrame, threshold: float, limit: int) -> list[DataFrame]:
    """Findings of all rounds, each a staged table of ``_FOUND`` rows."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = [stage(graph.repartition(parts, "shard").sortWithinPartitions("shard", "node").mapInArrow(_search_own(threshold), _FOUND), "found")]
    while not rounds[-1].where("kind = 2").isEmpty():
        asked = rounds[-1].where("kind = 2").groupBy("q").agg(F.first("u").alias("u"), F.first("known").alias("before"),
                                                              F.collect_set(F.struct(F.col("a").alias("shard"), F.col("b").alias("entry"))).alias("to"))
        now = F.array_sort(F.array_distinct(F.transform("to", lambda t: t["shard"])))
        visits = stage(asked.withColumn("now", now).select("q", "u", "before", "now", "to", F.explode("now").alias("shard")).select(
            "shard", F.col("q").alias("node"), "u", "before", "now",
            F.transform(F.filter("to", lambda t: t["shard"] == F.col("shard")), lambda t: t["entry"]).alias("entries")), "visits")
        sizes = _salted(visits.groupBy("shard").agg(F.count("*").alias("n")), limit)
        sizes = _checked(stage(sizes, "visited-shards"))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("array<long>")
        head = graph.join(sizes, "shard").select("shard", _each_salt(), F.lit(0).alias("kind"),
                                                 "node", "w", "u", "medoid", "shards", "near", none.alias("now"))
        body = visits.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "node",
                                                  zero.alias("w"), "u", F.lit(False).alias("medoid"), F.col("before").alias("shards"),
                                                  F.col("entries").alias("near"), "now")
        met = head.unionByName(body).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "node")
        rounds.append(stage(met.mapInArrow(_search_visits(threshold), _FOUND), "found"))
    return rounds


# -- audit and result ---------------------------------------------------------

def _true_links(sample: list[tuple[int, bytes]], threshold: float):
    """All classes against the audited ones: weight of those at or above the threshold."""
    by: dict[int, list] = {}
    for node, u in sample:
        by.setdefault(len(u), []).append((node, u))

    def run(batches):
        total: dict[int, int] = {}
        for b in batches:
            ids, w, u = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            size = np.array([len(x) for x in u])
            for length, asked in by.items():
                rows = np.flatnonzero(size == length)
                if len(rows):
                    x = np.frombuffer(b"".join(u[i] for i in rows), np.float64).reshape(len(rows), -1)
                    s = x @ np.frombuffer(b"".join(v for _, v in asked), np.float64).reshape(len(asked), -1).T >= threshold
                    for j, (node, _) in enumerate(asked):
                        total[node] = total.get(node, 0) + int(w[rows][s[:, j] & (ids[rows] != node)].sum())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])
    return run


def audited_recall(units: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the true links that were found for AUDIT classes by hash and AUDIT linked ones; 1.0 if they have none."""
    h = F.xxhash64("node", F.lit(12))
    some = units.join(links, "node", "left").select("node", "u", "n")
    asked = some.orderBy(h).limit(AUDIT).collect() + some.where("n > 0").orderBy(h).limit(AUDIT).collect()
    found = {r.node: r.n or 0 for r in asked}
    sample = list({r.node: bytes(r.u) for r in asked}.items())
    if not sample:
        return 1.0
    true = units.select("node", "w", "u").mapInArrow(_true_links(sample, threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    whole = sum(r.n for r in true)
    return sum(min(found[r.node], r.n) for r in true) / whole if whole else 1.0


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, target: int = TARGET,
                    limit: int = LIMIT) -> DataFrame:
    """``row, n_links, component_id, audit_recall``: every row with its links at cosine >= threshold.

    ``row`` holds all other columns unchanged, whatever their names.
    ``n_links`` counts other rows, copies included; ``component_id`` is the
    smallest identifier reachable by links (NULL identifiers are passed
    over unless all are).  Vectors that are NULL, all zero or hold NULL or
    non-finite components link with nothing, and so do vectors of different
    lengths.  Repeated rows link with each other.  An empty table gives no
    rows.  ``audit_recall`` is the measured recall of the search.
    """
    id_name = f"row.`{id_col}`"
    rows = _keyed(df, vector_col)
    classes = rows.where("key IS NOT NULL").groupBy("h", "key").agg(F.min(F.col(id_name)).alias("low"), F.count("*").alias("copies"), F.min("u").alias("u"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # vectors of one length start as one shard
    units = stage(classes.select((F.octet_length("u") / 8).cast("long").alias("shard"), "node", F.col("copies").alias("w"), "u"), "units")
    overlap = 2
    while True:
        members = deal_out(stage(units, "members"), overlap, target, limit)
        graph = united_graph(members)
        rounds = search_all(graph, threshold, limit)
        release(members, graph)
        links = rounds[0].where("kind = 0")
        for r in rounds[1:]:
            links = links.unionByName(r.where("kind = 0"))
        links = stage(links.groupBy(F.col("q").alias("node")).agg(F.sum("a").alias("n")), "links")
        recall = audited_recall(units, links, threshold)
        if recall >= RECALL or overlap >= MOST_OVERLAP:
            break
        release(links, *rounds)
        overlap += 1
    edges = rounds[0].where("kind = 1")
    for r in rounds[1:]:
        edges = edges.unionByName(r.where("kind = 1"))
    roots = stage(components(edges.select("q", F.col("a").alias("b")).withColumnRenamed("q", "a")), "near-components")
    low = roots.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_low"))
    linked = roots.join(_checked(low), "root").select("node", "component_low")
    found = stage(classes.select("h", "key", "low", "copies", "node").join(links, "node", "left").join(linked, "node", "left").select(
        F.col("h").alias("c_h"), F.col("key").alias("c_key"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component_low", "low").alias("component")), "near-classes")
    release(classes, units, links, roots, *rounds)
    out = rows.join(found, (rows["h"] == found["c_h"]) & (rows["key"] == found["c_key"]), "left")
    return out.select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("c_h").isNull(), F.col(id_name)).otherwise(F.col("component")).alias("component_id"),
                      F.lit(float(recall)).alias("audit_recall"))
