"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same set of word 5-grams form a class; only classes are
compared.  Classes that agree in all values of some band of their MinHash
signature meet in a bucket.  Inside a bucket the signatures are compared a
few values at a time, and a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below the
tolerance.  Pairs that survive connect classes to candidate groups (a bucket
reports a star per group, not its pairs); inside a candidate group every
pair runs through the same incremental test and the survivors are verified
on their full gram sets.  Buckets and groups beyond a block are cut into
blocks, and every pair of blocks is a group of its own.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailforge.llm import wordnum as W
from retailforge.llm.common import column, components, small_enough, sorted_groups, tidy
from retailforge.session import stage

GRAM = 5
#: similarity threshold as a fraction, so that the exact test is in whole numbers
THRESHOLD = (4, 5)
HASHES, BAND = 128, 4
#: values compared at a time, and the posterior probability below which a pair is dropped
STEP, TOLERANCE = 16, 1e-9
#: classes of a block of a bucket, and of a block of a candidate group
BUCKET_BLOCK, GROUP_BLOCK = 1024, 384
BROADCAST_ROWS = 500_000

_FACTORS = (W.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * W._BASE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def gram_sets(b: W.Block):
    """Sorted different gram hashes of each text of a block; a text of fewer words is one gram, no words none."""
    g = W.gram_hashes(b.hashes, GRAM)
    out = []
    for u, v in zip(b.first[:-1].tolist(), b.first[1:].tolist()):
        if v - u >= GRAM:
            out.append(np.unique(g[u:v - GRAM + 1]))
        elif v > u:
            out.append(W.gram_hashes(b.hashes[u:v], v - u) ^ np.uint64(v - u))
        else:
            out.append(g[:0])
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """Smallest value of the grams under every hash function."""
    x = (grams >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(low, (x[a:a + 512] * _FACTORS).min(0), out=low)
    return low


def least_matches(step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): posterior of the similarity from a flat prior."""
    num, den = THRESHOLD
    t, out = num / den, []
    for n in range(step, HASHES + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(similarity >= t | m matches of n) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no step of the incremental comparison drops."""
    matches, a = np.zeros(len(i), np.int32), 0
    for n, least in rule:
        matches += (sig[i, a:n] == sig[j, a:n]).sum(1, dtype=np.int32)
        go = matches >= least
        i, j, matches, a = i[go], j[go], matches[go], n
        if not len(i):
            break
    return i, j


def block_pairs(n: int, side: np.ndarray, lo: int, hi: int):
    """Index pairs of a group: all pairs of one block, or all across two."""
    if lo == hi:
        for a in range(0, n, 512):
            i = np.arange(a, min(a + 512, n))
            x, y = np.meshgrid(i, np.arange(a + 1, n), indexing="ij")
            keep = y > x
            yield x[keep], y[keep]
        return
    left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    for a in range(0, len(left), 512):
        x, y = np.meshgrid(left[a:a + 512], right, indexing="ij")
        yield x.ravel(), y.ravel()


class Union:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i, j) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)


def _sign(batches):
    for batch in batches:
        n = batch.num_rows
        size, digest, sig = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), [None] * n
        for b in W.blocks(batch.column(2), size=W.BLOCK // 4):
            for i, g in enumerate(gram_sets(b)):
                k = b.row + i
                if len(g):
                    size[k] = len(g)
                    digest[k] = (W.mix(g).sum(), W.mix(g ^ W._M1).sum())
                    sig[k] = signature(g).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
             pa.array(sig, pa.binary())], names=["doc_id", "k_text", "n_grams", "d1", "d2", "sig"])


def _band_keys(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
        keys = np.zeros((len(sig), HASHES // BAND), np.uint64) + np.arange(HASHES // BAND, dtype=np.uint64)
        for k in range(BAND):
            keys = W.mix(keys * W._BASE + sig[:, k::BAND])
        flat = pa.array(keys.view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), flat)],
            names=["cid", "keys"])


def _candidate_stars(batches):
    """Sorted ``key, lo, hi, cid, side, sig`` -> (smallest class of the local group, class)."""
    rule = least_matches()
    a_out, b_out = [], []
    for parts in sorted_groups(batches, 3):
        cid = column(parts, 3).to_numpy()
        if len(cid) < 2:
            continue
        lo, hi = int(parts[0].column(1)[0].as_py()), int(parts[0].column(2)[0].as_py())
        side = column(parts, 4).to_numpy()
        sig = np.frombuffer(b"".join(column(parts, 5).to_pylist()), np.uint32).reshape(-1, HASHES)
        order = np.argsort(cid)
        cid, side, sig = cid[order], side[order], sig[order]
        u = Union(len(cid))
        for i, j in block_pairs(len(cid), side, lo, hi):
            u.join(*surviving(sig, i, j, rule))
        for k in range(len(cid)):
            r = u.find(k)
            if r != k:
                a_out.append(cid[r])
                b_out.append(cid[k])
        if len(a_out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
            a_out, b_out = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _gram_rows(batches):
    """``root, n, cid, copies, text`` -> the same with grams and signature in place of the text."""
    for batch in batches:
        grams, sig = [], []
        for b in W.blocks(batch.column(4), size=W.BLOCK // 4):
            for g in gram_sets(b):
                grams.append(g.tobytes())
                sig.append(signature(g).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(grams, pa.binary()), pa.array(sig, pa.binary())],
                                         names=["root", "n", "cid", "copies", "grams", "sig"])


def shared_grams(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs (i, j) of sorted gram sets."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    used = np.unique(np.concatenate([i, j]))
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    flat = np.concatenate([sets[k] for k in used])
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, word, count = np.unique(flat, return_inverse=True, return_counts=True)
    many = count > 1
    new = np.cumsum(many) - 1
    keep = many[word]
    row, word = row[keep], new[word[keep]]
    o = np.argsort(word, kind="stable")
    row, word = row[o], word[o]
    out = np.zeros((len(used), len(used)), np.float32)
    width = max(1, (8 << 20) // len(used))
    for a in range(0, int(many.sum()), width):
        u, v = np.searchsorted(word, (a, a + width))
        held = np.zeros((len(used), width), np.float32)
        held[row[u:v], word[u:v] - a] = 1
        out += held @ held.T  # counts stay far below 2**24, so they are exact
    return out[at[i], at[j]].astype(np.int64)


def _verified(batches):
    """Sorted ``root, lo, hi, cid, side, copies, grams, sig`` -> links of each class and the head of its local group."""
    rule = least_matches()
    num, den = THRESHOLD
    rows: list[tuple] = []
    for parts in sorted_groups(batches, 3):
        cid = column(parts, 3).to_numpy()
        lo, hi = int(parts[0].column(1)[0].as_py()), int(parts[0].column(2)[0].as_py())
        order = np.argsort(cid)
        order = order[np.append(True, np.diff(cid[order]) > 0)]  # a repeated row stands for its class once
        cid, side = cid[order], column(parts, 4).to_numpy()[order]
        copies = column(parts, 5).to_numpy()[order]
        blobs, sigs = column(parts, 6), column(parts, 7)
        sets = [np.frombuffer(blobs[k].as_py(), np.uint64) for k in order.tolist()]
        sig = np.frombuffer(b"".join(sigs[k].as_py() for k in order.tolist()), np.uint32).reshape(-1, HASHES)
        size = np.array([len(s) for s in sets])
        links, docs, u = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64), Union(len(cid))
        for i, j in block_pairs(len(cid), side, lo, hi):
            i, j = surviving(sig, i, j, rule)
            if not len(i):
                continue
            both = shared_grams(sets, i, j)
            good = both * den >= num * (size[i] + size[j] - both)
            i, j = i[good], j[good]
            for x, y in ((i, j), (j, i)):
                links += np.bincount(x, minlength=len(cid))
                docs += np.bincount(x, copies[y], len(cid)).astype(np.int64)
            u.join(i, j)
        rows += [(int(cid[k]), int(links[k]), int(docs[k]), int(cid[u.find(k)])) for k in range(len(cid))]
        if len(rows) > 5000:
            yield _links(rows)
            rows = []
    yield _links(rows)


def _links(rows):
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cid", "links", "docs", "head"])


def _blocks(df: DataFrame, key: str, n: str, block: int) -> DataFrame:
    """One row per pair of blocks of its group that a row belongs to: adds ``lo, hi, side``."""
    df = df.withColumn("nb", F.ceil(F.col(n) / block)).withColumn("side", F.pmod(F.xxhash64("cid"), F.col("nb")))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    return (df.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
            .repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, k_text, uid, class_id, class_size, group_id, n_links, n_near_classes, has_words, component``.

    ``class_id`` is the smallest identifier among the documents with the same
    set of word 5-grams, ``group_id`` that of all documents connected through
    links, ``n_links`` the number of other documents of similarity 0.8 or
    more, copies included, ``n_near_classes`` the number of different texts
    among them.  Words are lower-cased runs of letters, digits and non-ASCII
    characters; ``component`` tells the groups apart where identifiers are
    NULL or repeated.  A text of one to four words is one gram.  NULL texts and
    texts without a word have no links and are groups of their own.  Repeated
    rows are documents of one class; an empty table gives no rows.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("k_text"),
                      F.col(f"`{text_col}`").alias("text"))
    signed = src.mapInArrow(tidy(_sign), "doc_id long, k_text long, n_grams long, d1 long, d2 long, sig binary")
    signed = stage(signed.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    classes = stage(signed.where("n_grams > 0").groupBy("d1", "d2").agg(
        F.min("uid").alias("cid"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies"),
        F.min(F.struct("uid", "doc_id", "k_text")).alias("one"), F.first("sig").alias("sig")), "classes")

    # buckets of two and more classes; buckets with the same members are kept once
    keys = classes.select("cid", "sig").mapInArrow(tidy(_band_keys), "cid long, keys array<long>").select("cid", F.explode("keys").alias("key"))
    keys = stage(keys, "bands")
    shared = (keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"),
                                      F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y")).where("n > 1")
              .groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    members = stage(keys.join(shared, "key"), "buckets").join(classes.select("cid", "sig"), "cid")
    stars = _blocks(members, "key", "n", BUCKET_BLOCK).select("key", "lo", "hi", "cid", "side", "sig").mapInArrow(
        tidy(_candidate_stars), "a long, b long")
    groups = components(stars)
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    wanted = stage(groups.join(sizes, "root").join(classes.select(F.col("cid").alias("node"), "copies", "one"), "node")
                   .select("root", "n", F.col("node").alias("cid"), "copies", F.col("one.doc_id").alias("w_id"),
                           F.col("one.k_text").alias("w_text")), "candidate-groups")
    right = F.broadcast(wanted) if small_enough(wanted, BROADCAST_ROWS) else wanted
    texts = src.join(right, src["doc_id"].eqNullSafe(right["w_id"]) & (src["k_text"] == right["w_text"]))
    grams = texts.select("root", "n", "cid", "copies", "text").mapInArrow(
        tidy(_gram_rows), "root long, n long, cid long, copies long, grams binary, sig binary")
    checked = stage(_blocks(grams, "root", "n", GROUP_BLOCK).select("root", "lo", "hi", "cid", "side", "copies", "grams", "sig")
                    .mapInArrow(tidy(_verified), "cid long, links long, docs long, head long"), "links-of-classes")
    linked = checked.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = components(checked.select(F.col("cid").alias("a"), F.col("head").alias("b")))
    named = (classes.select("d1", "d2", "cid", "class_id", "copies").join(linked, "cid", "left")
             .join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    group_ids = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = named.join(group_ids, "root").drop("cid")
    return (signed.select("doc_id", "k_text", "uid", "n_grams", "d1", "d2")
            .join(named, ["d1", "d2"], "left")
            .select("doc_id", "k_text", "uid", F.when(F.col("n_grams") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                    F.when(F.col("n_grams") > 0, F.col("copies")).otherwise(F.lit(1)).alias("class_size"),
                    F.when(F.col("n_grams") > 0, F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"),
                    F.when(F.col("n_grams") > 0, F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"),
                    F.when(F.col("n_grams") > 0, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).alias("n_near_classes"),
                    (F.col("n_grams") > 0).alias("has_words"), F.coalesce("root", "uid").alias("component")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group - the one with the smallest identifier, if any has one - with its columns unchanged.

    Groups are connected texts, whatever their identifiers: unrelated texts
    without an identifier, or under one repeated identifier, all stay.
    """
    found = similar_documents(docs, id_col, text_col)
    smallest = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "uid", "k_text"))
    first = found.where("has_words").groupBy("component").agg(smallest.alias("s")).select("s.*")
    kept = stage(first.select("doc_id", "k_text").unionByName(found.where("NOT has_words").select("doc_id", "k_text").distinct())
                 .select(F.col("doc_id").alias("w_id"), F.col("k_text").alias("w_text")), "kept-of-groups")
    right = F.broadcast(kept) if small_enough(kept, BROADCAST_ROWS) else kept
    cols = [f"`{c}`" for c in docs.columns]
    rows = docs.select(*cols, F.xxhash64(F.col(f"`{text_col}`")).alias("__k_text"))
    out = rows.join(right, rows[f"`{id_col}`"].eqNullSafe(right["w_id"]) & (rows["__k_text"] == right["w_text"]), "left_semi")
    twice = found.where("has_words").groupBy("doc_id", "k_text").count().where("count > 1").limit(1).count()
    if twice:  # a row that is repeated with its identifier: the key above matches each of them
        worded = F.col(f"`{text_col}`").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
        out = out.where(worded).dropDuplicates([id_col, "__k_text"]).unionByName(out.where(~F.coalesce(worded, F.lit(False))))
    return out.select(*cols)
