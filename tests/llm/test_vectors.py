"""Operators on embeddings against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailforge.llm import clustering, common, neargraph, vectorcode
from tests.conftest import spark  # noqa: F401

SCHEMA = "vec_id long, embedding array<double>, label int, row string, codes string, n_links string, id string"


def frame(spark, rows):  # noqa: F811
    common.prepare(spark)
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "r", "c", "n", "i") for i, v, lab in rows],
                                 SCHEMA).repartition(4)


def plain_codes(rows, parts, entries, rounds, scale):
    x = {k: [int(np.floor(scale * c)) for c in v] for k, v in rows}
    length = -(-len(next(iter(x.values()))) // parts)
    x = {k: v + [0] * (length * parts - len(v)) for k, v in x.items()}
    books = [[x[k][p * length:(p + 1) * length] for k in sorted(x)[:entries]] for p in range(parts)]

    def assign(v, p):
        part = v[p * length:(p + 1) * length]
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), j) for j, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for v in x.values():
                own.setdefault(assign(v, p)[1], []).append(v[p * length:(p + 1) * length])
            new.append([[sum(c) // len(own[j]) for c in zip(*own[j])] if j in own else e for j, e in enumerate(books[p])])
        books = new
    return {k: ([assign(v, p)[1] for p in range(parts)], sum(assign(v, p)[0] for p in range(parts))) for k, v in x.items()}, books


def test_transform_keeps_scaled_distances():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-1000, 1000, (50, 13)), rng.integers(-1000, 1000, (50, 13))
    assert (((vectorcode.transformed(x) - vectorcode.transformed(y)) ** 2).sum(1) == 16 * ((x - y) ** 2).sum(1)).all()
    h = vectorcode.transformed(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in h] == list(range(8))
    # ties go to the lower entry, whatever is eliminated on the way
    entries = rng.integers(-3, 3, (40, 5))
    q = rng.integers(-3, 3, (300, 5))
    d = ((q[:, None] - entries) ** 2).sum(2)
    k, least = vectorcode.nearest(vectorcode.transformed(q), vectorcode.transformed(entries))
    assert (k == d.argmin(1)).all() and (least == d.min(1)).all()


@pytest.mark.parametrize("dim", [8, 10])
def test_codes(spark, dim):  # noqa: F811
    rng = np.random.default_rng(dim)
    good = [(i, rng.normal(0, 0.2, dim).round(1)) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(40)]  # copies
    bad = [(200, None), (201, [None] * dim), (202, [float("nan")] * dim), (203, [float("inf")] * dim), (204, [1e9] * dim), (205, [0.5] * (dim - 1)), (206, [])]
    rows = [(i, v, None if i % 7 == 0 else i % 3) for i, v in good + bad]
    out, books = vectorcode.compress(frame(spark, rows), parts=4, entries=9, rounds=3, scale=64)
    want, plain = plain_codes(good, 4, 9, 3, 64)
    assert {r.row.vec_id: (r.codes, r.error) for r in out.collect()} == want
    assert [b.tolist() for b in books] == plain
    flat = ",".join(str(x) for b in plain for e in b for x in e)
    assert vectorcode.codebooks_sha256(books) == hashlib.sha256(flat.encode()).hexdigest()
    none, books = vectorcode.compress(frame(spark, rows).limit(0))
    assert none.count() == 0 and books == []
    assert vectorcode.compress(frame(spark, bad_rows(bad)))[0].count() == 0


def bad_rows(bad):
    return [(i, v, 0) for i, v in bad if i != 205]


def plain_clusters(rows, k, rounds, scale, seed="2"):
    x = {i: np.floor(np.array(v) * scale).astype(np.int64) for i, v in rows}
    c = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]]
    near = lambda v: min((int(((v - m) ** 2).sum()), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = {}
        for v in x.values():
            own.setdefault(near(v)[1], []).append(v)
        c = [np.array([int(s) // len(own[j]) for s in np.sum(own[j], 0)]) if j in own else m for j, m in enumerate(c)]
    return {i: (near(v)[1], near(v)[0]) for i, v in x.items()}, np.array(c)


def test_clusters(spark, monkeypatch):  # noqa: F811
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (6, 5))
    good = [(i, (middle[i % 6] + rng.normal(0, 0.1, 5)).round(2)) for i in range(400)] + [(500 + i, [0.5] * 5) for i in range(200)]
    bad = [(900, None), (901, [None] * 5), (902, [float("nan")] * 5), (903, [0.0] * 4), (904, [-float("inf")] * 5), (905, [])]
    df = frame(spark, [(i, v, 0) for i, v in good + bad])
    trace = []
    out, c = clustering.cluster_vectors(df, 9, rounds=4, scale=16, dim=5, trace=trace)
    want, centroids = plain_clusters(good, 9, 4, 16)
    assert {r.id: (r.cluster, r.distance) for r in out.collect()} == want and (c == centroids).all()
    # every vector once, then only those whose gap expired
    assert trace[0] == len(good) and sum(trace[1:]) < 2 * len(good)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cluster_blocks")]
    few, c = clustering.cluster_vectors(df.where("vec_id < 3"), 40, dim=5)
    assert few.count() == 3 and len(c) == 3
    one, c = clustering.cluster_vectors(df, 1, dim=5)
    assert one.select("cluster").distinct().count() == 1
    none, c = clustering.cluster_vectors(df.limit(0), 40, dim=5)
    assert none.count() == 0 and len(c) == 0


def test_expired_gaps_are_conservative():
    """Heaps after several moves give the assignment of a full scan, ties included."""
    rng = np.random.default_rng(5)
    x = rng.integers(-4, 5, (500, 3))
    c = rng.integers(-4, 5, (7, 3))
    drift = np.zeros(7)
    heaps = clustering.first_heaps(x, c, drift)
    for _ in range(6):
        new = c + rng.integers(-1, 2, c.shape)
        move = np.sqrt(((new - c) ** 2).sum(1)) * (1 + clustering.WIDER)
        drift += [m + max(np.delete(move, i)) for i, m in enumerate(move)]
        c = new
        out = clustering.expired(heaps, drift)
        own, gap = clustering._scan(x[[r for _, r in out]], c)
        for (_, r), k, g in zip(out, own.tolist(), gap.tolist()):
            clustering.heapq.heappush(heaps[k], (g + drift[k], r))
        got = {r: k for k, h in enumerate(heaps) for _, r in h}
        assert [got[i] for i in range(len(x))] == ((x[:, None] - c) ** 2).sum(2).argmin(1).tolist()


def plain_links(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, v) in enumerate(ok):
        for j, w in ok[:a]:
            if len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (n[i], find(i)) for i in n}


def test_near_duplicates(spark):  # noqa: F811
    """Groups over many small shards, chains, copies and multiples of a vector, other lengths, unusable vectors."""
    rng = np.random.default_rng(7)
    rows = [rng.normal(0, 1, 12) for _ in range(700)]
    hot = rng.normal(0, 1, 12)
    rows += [hot + rng.normal(0, 0.12, 12) for _ in range(300)]
    rows += [hot * (1 + i) for i in range(5)] + [rows[3]] * 4
    for k in range(30):  # chains of vectors that turn slowly
        a, b = rng.normal(0, 1, (2, 12))
        rows += [a * np.cos(0.4 * t) + b * np.sin(0.4 * t) for t in range(4)]
    rows += [rng.normal(0, 1, 3) for _ in range(40)]
    rows = list(enumerate(rows)) + [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [None] * 12), (5004, []), (5005, [0.0] * 12)]
    want = plain_links(rows)
    out = neargraph.near_duplicates(frame(spark, [(i, v, 0) for i, v in rows]), target=64, limit=128).collect()
    assert len(out) == len(rows)
    got = {r.row.vec_id: (r.n_links, r.component_id) for r in out}
    assert all(got[i][0] <= n for i, (n, _) in want.items())  # none below the threshold, none twice
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert out[0].audit_recall >= 0.95
    assert sum(got[i][1] == c for i, (_, c) in want.items()) >= 0.97 * len(want)
    # one shard: nothing is missed here
    rows = rows[600:1100] + rows[-6:]
    out = neargraph.near_duplicates(frame(spark, [(i, v, 0) for i, v in rows])).collect()
    assert {r.row.vec_id: (r.n_links, r.component_id) for r in out} == plain_links(rows)


def test_near_duplicates_edges(spark):  # noqa: F811
    df = frame(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.1], 0), (2, [0.0, 1.0], 0), (None, [0.0, -1.0], 0), (3, None, 0)])
    got = sorted((r.row.vec_id or 0, r.n_links, r.component_id) for r in neargraph.near_duplicates(df).collect())
    assert got == [(0, 0, None), (0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3)] or got == [(0, 2, 1), (0, 0, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3)]
    assert neargraph.near_duplicates(df.limit(0)).count() == 0
    assert neargraph.near_duplicates(df.where(F.col("vec_id") == 3)).count() == 1
