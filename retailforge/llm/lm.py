"""Language-model scoring by deleted interpolation.

Tokens are lower-cased words and one end mark per text.  The probability of a
word w after its predecessor v (the end mark before the first word) mixes three
maximum-likelihood estimates

    l2 * c(v, w) / c(v)  +  l1 * c(w) / N  +  l0 / (V + 1)

with weights per bucket of the context's frequency.  Expectation-maximisation
learns them on deleted counts: each training occurrence is held out of the
counts that predict it.  Every word and every pair of words that training has
keeps its own count, whatever its frequency and the size of the corpus.

Texts are counted in chunks.  A chunk is written once, as its different words
(64-bit hashes) and the number of the word at each position.  It lists its
different words and pairs (64-bit hashes of both words' hashes) with their
training counts once, so a frequent pair reaches its counting task as one
number per chunk; the totals return to the chunk in the order of its list.
Both the deleted estimates for the weights and the scores are taken there.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailforge.llm import wordnum as W
from retailforge.llm.common import column, sorted_groups
from retailforge.llm.langid import is_held_out
from retailforge.session import checkpoint_dir, discard, stage

MOD, HELD = 7, 2
#: bytes of text and number of texts of a chunk
CHUNK, CHUNK_TEXTS = 6 << 20, 60_000
#: words and pairs that chunks list, per counting partition on average
ENTRIES = 2_000_000
#: rounds of expectation-maximisation, and the step of its probability bins in decades
ROUNDS, BIN = 30, 0.1
#: buckets of context frequency, and cells that a task holds before it adds them up
BUCKETS, CELLS = 64, 1 << 20
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0, lowest bytes of all first, without the bytes that are zero in all; a first byte tells how many are left."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(blob) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and differences."""
    return keys[:1].astype("<u8").tobytes() + _narrow(np.diff(keys)) if len(keys) else b""


def _unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(blob, "<u8", count=1).astype(np.uint64)
    return np.cumsum(np.concatenate([first, _wide(blob[8:]).view(np.uint64)]), dtype=np.uint64)


class Chunk:
    """Some texts: ``words`` (different hashes, ascending), ``at`` (word of each token, ends included), tokens per text."""

    def __init__(self, words: np.ndarray, at: np.ndarray, tokens: np.ndarray, held: np.ndarray):
        self.words, self.at, self.tokens = words, at, tokens
        self.text = np.repeat(np.arange(len(tokens)), tokens)
        self.train = ~held[self.text]
        end = int(np.searchsorted(words, END))
        before = np.append(end, at[:-1])
        before[np.cumsum(tokens) - tokens] = end
        #: word before each token
        self.before = before

    @classmethod
    def of(cls, hashes: np.ndarray, n_words: np.ndarray, held: np.ndarray) -> Chunk:
        flat = np.insert(hashes, np.cumsum(n_words), END)  # one end mark behind each text
        words, at = np.unique(flat, return_inverse=True)
        return cls(words, at.astype(np.int64), n_words + 1, held)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the different pairs (ascending) and the pair of each token."""
        local, pair = np.unique(self.before * len(self.words) + self.at, return_inverse=True)
        v, w = local // len(self.words), local % len(self.words)
        keys = W.mix(self.words[v] * np.uint64(3) + W.mix(self.words[w]))
        # two pairs of one key are one entry; the order of the list is that of the keys
        keys, to = np.unique(keys, return_inverse=True)
        return keys, to[pair]


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the counting partitions, equal ranges of the 64-bit hashes, start in ascending keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


_CHUNK = "chunk long, doc_id array<long>, held array<boolean>, n_tokens array<long>, words binary, at binary, entries long"


def _chunks(batches):
    """``doc_id, held, text`` -> one row per chunk."""
    pid, number = TaskContext.get().partitionId(), 0
    docs, held, sizes, words = [], [], [], []
    size = 0

    def flush():
        c = Chunk.of(np.concatenate(words), np.array(sizes, np.int64), np.array(held, bool))
        values = (pid << 32 | number, docs, held, c.tokens.tolist(), c.words.astype("<u8").tobytes(), _narrow(c.at), len(c.words) + len(c.at))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)],
                                          names=["chunk", "doc_id", "held", "n_tokens", "words", "at", "entries"])

    for batch in batches:
        ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for b in W.blocks(batch.column(2), W.NONSPACE):
            docs += ids[b.row:b.row + len(b)]
            held += out[b.row:b.row + len(b)]
            sizes += np.diff(b.first).tolist()
            words.append(b.hashes)
            size += len(b.data)
            if size >= CHUNK or len(docs) >= CHUNK_TEXTS:
                yield flush()
                number += 1
                docs, held, sizes, words, size = [], [], [], [], 0
    if docs:
        yield flush()


def _read_chunk(batch, names, k) -> Chunk:
    get = lambda c: batch.column(names[c])[k].as_py()
    return Chunk(np.frombuffer(get("words"), "<u8").astype(np.uint64), _wide(get("at")), np.array(get("n_tokens"), np.int64),
                 np.array(get("held"), bool))


_LISTED = "p long, chunk long, words binary, word_n binary, pairs binary, pair_n binary"


def _listed(parts: int):
    """Chunks -> per counting partition that it has entries in: its words and pairs and their training counts."""
    def run(batches):
        for batch in batches:
            names = {n: i for i, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                c = _read_chunk(batch, names, k)
                chunk = batch.column(names["chunk"])[k].as_py()
                keys, pair = c.pairs()
                sides = []
                for key, at in ((c.words, c.at), (keys, pair)):
                    n = np.bincount(at[c.train], minlength=len(key))
                    sides.append((key, n, _cuts(key, parts)))
                used = np.flatnonzero(np.diff(sides[0][2]) + np.diff(sides[1][2]))
                for some in np.array_split(used, max(1, len(used) // 256)):
                    if not len(some):
                        continue
                    cols = [[], [], [], []]
                    for j, (key, n, cut) in enumerate(sides):
                        for p in some.tolist():
                            a, b = cut[p], cut[p + 1]
                            cols[2 * j].append(_packed(key[a:b]))
                            cols[2 * j + 1].append(_narrow(n[a:b]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), *[pa.array(x, pa.binary()) for x in cols]],
                        names=["p", "chunk", "words", "word_n", "pairs", "pair_n"])
    return run


#: chunk number of the row that carries a partition's number of different training words
STATISTICS = -1
_COUNTED = "chunk long, p long, words binary, pairs binary"


def _counted(batches):
    """Sorted ``_LISTED`` rows -> totals for each chunk in the order of its keys, and one row of statistics a partition."""
    def row(*x):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds)], names=["chunk", "p", "words", "pairs"])

    for group in sorted_groups(batches, 1):
        p = int(group[0].column(0)[0].as_py())
        chunk, sides, types = column(group, 1).to_pylist(), [], 0
        for k in (2, 4):
            keys = [_unpacked(x) for x in column(group, k).to_pylist()]
            counts = np.concatenate([_wide(x) for x in column(group, k + 1).to_pylist()])
            u, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, counts, len(u)).astype(np.int64)
            if k == 2:
                types = int((total > 0).sum())
            stop = np.cumsum([len(x) for x in keys])
            sides.append([total[back[b - len(x):b]] for x, b in zip(keys, stop.tolist())])
        for c, words, pairs in zip(chunk, *sides):
            yield row(c, p, _narrow(words), _narrow(pairs))
        yield row(STATISTICS, p, _narrow(np.array([types])), b"")


class Counts:
    """Training totals of a chunk's tokens: ``n`` of the pair, ``v`` of the word before, ``w`` of the word."""

    def __init__(self, c: Chunk, totals: list, parts: int):
        totals = {t["p"]: t for t in totals}
        keys, pair = c.pairs()
        got = []
        for key, name in ((c.words, "words"), (keys, "pairs")):
            used = np.flatnonzero(np.diff(_cuts(key, parts))).tolist()
            got.append(np.concatenate([_wide(totals[p][name]) for p in used]))
        self.w, self.v, self.n = got[0][c.at], got[0][c.before], got[1][pair]


def bucket(counts: np.ndarray) -> np.ndarray:
    """Context bucket: the binary logarithm of its frequency, 0 for contexts that never occurred."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def deleted_cells(v, w, n, total: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """Deleted estimates of training occurrences, gathered in cells: keys, then (occurrences, bigram mass, unigram mass).

    ``v, w, n`` are the totals of the context, the word and the pair at each occurrence, itself included.
    """
    p2 = (n - 1) / np.maximum(v - 1, 1)
    p1 = (w - 1) / max(total - 1, 1)
    floor = 1.0 / (types + 1)
    q = [np.where(p > 0, np.clip(np.round(np.log10(np.maximum(p, 1e-300) / floor) / BIN), -500, 500) + 501, 0).astype(np.int64) for p in (p2, p1)]
    u, back = np.unique((bucket(v) * 1024 + q[0]) * 1024 + q[1], return_inverse=True)
    return u, np.stack([np.bincount(back, x, len(u)) for x in (np.ones(len(back)), p2, p1)], 1)


_CELLS = "cell long, n double, bigram double, unigram double"


def _cells(parts: int, total: int, types: int):
    """Chunks with their totals -> cells, added up inside the task."""
    def run(batches):
        keys, sums, held = [], [], 0

        def flush():
            u, back = np.unique(np.concatenate(keys), return_inverse=True)
            x = np.concatenate(sums)
            return u, np.stack([np.bincount(back, x[:, j], len(u)) for j in range(3)], 1)

        for batch in batches:
            names = {n: i for i, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                c = _read_chunk(batch, names, k)
                if not c.train.any():
                    continue
                t = Counts(c, batch.column(names["totals"])[k].as_py(), parts)
                u, s = deleted_cells(t.v[c.train], t.w[c.train], t.n[c.train], total, types)
                keys.append(u)
                sums.append(s)
                held += len(u)
                if held > CELLS:
                    u, s = flush()
                    keys, sums, held = [u], [s], len(u)
        if keys:
            u, s = flush()
            for a in range(0, len(u), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(u[b]), *[pa.array(s[b, j]) for j in range(3)]], names=["cell", "n", "bigram", "unigram"])
    return run


def learn_weights(cells: dict[int, np.ndarray], v: int, buckets: int = BUCKETS) -> np.ndarray:
    """Mixture weights (buckets, [uniform, unigram, bigram]) by expectation-maximisation over the cells."""
    out = np.tile(np.array([0.01, 0.98, 0.01]), (buckets, 1))
    by: dict[int, list] = {}
    for key, x in cells.items():
        by.setdefault(key >> 20, []).append(x)
    everything = [x for rows in by.values() for x in rows]

    def fit(rows):
        x = np.array(rows)
        p = np.stack([np.full(len(x), 1.0 / (v + 1)), x[:, 2] / x[:, 0], x[:, 1] / x[:, 0]], 1)
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            post = w * p
            post *= (x[:, 0] / post.sum(1))[:, None]
            w = post.sum(0) + 0.5  # no weight dies out
            w /= w.sum()
        return w

    if everything:
        out[:] = fit(everything)
        # contexts that training never saw have no bigram estimate
        out[0] = [*(out[0][:2] / out[0][:2].sum()), 0.0]
        for b, rows in by.items():
            out[b] = fit(rows)
    return out


def token_logs(weights: np.ndarray, v, w, n, total: int, types: int) -> np.ndarray:
    """log10 probability of words of count ``w`` after contexts of count ``v`` that were seen together ``n`` times."""
    m = weights[bucket(v)]
    return np.log10(m[:, 2] * n / np.maximum(v, 1) + m[:, 1] * w / max(total, 1) + m[:, 0] / (types + 1))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(parts: int, weights: np.ndarray, total: int, types: int):
    """Chunks with their totals -> one row per text."""
    def run(batches):
        for batch in batches:
            names = {n: i for i, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                c = _read_chunk(batch, names, k)
                t = Counts(c, batch.column(names["totals"])[k].as_py(), parts)
                d = len(c.tokens)
                known = np.bincount(c.text, t.w > 0, d).round().astype(np.int64)
                base = np.bincount(c.text, np.log10(t.w + 1.0), d) - c.tokens * np.log10(total + types + 1)
                score = np.bincount(c.text, token_logs(weights, t.v, t.w, t.n, total, types), d)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names["doc_id"])[k].values, batch.column(names["held"])[k].values, pa.array(c.tokens), pa.array(known),
                     pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def _bucketed(df: DataFrame, name: str, buckets: int) -> tuple[str, str]:
    """Write ``df`` as a table in buckets of chunks, so that chunks and their totals meet where they lie."""
    spark: SparkSession = df.sparkSession
    name = f"lm_{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/retailforge-stages/{name}"
    df.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", path).saveAsTable(name)
    return name, path


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries: int = ENTRIES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per document.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that
    of the interpolated model.  NULL texts are empty and have the end mark
    only; repeated rows count and are scored each; a row without an
    identifier is a training row.  Without training rows all probability is
    uniform over one unknown word.  An empty table gives no rows.
    ``entries`` sizes the counting partitions: one holds about so many
    (chunk, word or pair) entries.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), is_held_out(id_col, MOD, HELD).alias("held"),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = [_bucketed(src.mapInArrow(_chunks, _CHUNK), "chunks", buckets)]
    chunks = spark.table(made[0][0])
    of_train = F.aggregate(F.arrays_zip("held", "n_tokens"), F.lit(0).cast("long"),
                           lambda a, x: a + F.when(x["held"], F.lit(0)).otherwise(x["n_tokens"]))
    size = chunks.agg(F.coalesce(F.sum(of_train), F.lit(0)).alias("n"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries")).first()
    total, parts = int(size.n), max(buckets, -(-int(size.entries) // entries))
    listed = chunks.select("chunk", "held", "n_tokens", "words", "at").mapInArrow(_listed(parts), _LISTED)
    counted = listed.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_counted, _COUNTED)
    made.append(_bucketed(counted.repartition(buckets, "chunk"), "totals", buckets))
    totals = spark.table(made[1][0])
    types = sum(int(_wide(bytes(r.words))[0]) for r in totals.where(F.col("chunk") == STATISTICS).select("words").toLocalIterator())
    per_chunk = totals.where(F.col("chunk") != STATISTICS).groupBy("chunk").agg(F.collect_list(F.struct("p", "words", "pairs")).alias("totals"))
    joined = chunks.join(per_chunk.hint("merge"), "chunk")
    cells = joined.select("held", "n_tokens", "words", "at", "totals").mapInArrow(_cells(parts, total, types), _CELLS)
    cells = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "bigram", "unigram")])
    # bounded by context buckets and probability bins, whatever the input
    weights = learn_weights({r.cell: np.array([r.n, r.bigram, r.unigram]) for r in cells.orderBy("cell").toLocalIterator()}, types)
    scored = stage(joined.select("doc_id", "held", "n_tokens", "words", "at", "totals").mapInArrow(_score(parts, weights, total, types), _SCORED),
                   "scores")
    for name, path in made:
        spark.sql(f"DROP TABLE {name}")
        discard(spark, path)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
