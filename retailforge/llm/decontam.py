"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and non-ASCII characters.  A
window is ``WINDOW`` consecutive words of a benchmark item, or the whole item
if it has fewer.  Both sides hash their ``K``-word grams and keep, of every
``WINDOW - K + 1`` consecutive grams, the rightmost smallest; whatever run of
``WINDOW`` words two texts share holds such a stretch, so both keep the same
gram of it and the join of the fingerprints cannot miss it.  Hits are then
extended word by word in both directions; runs shorter than a window are
discarded, so a result never rests on a hash alone.

A benchmark of at most ``index_bytes`` text (checked) is one index that travels
to the tasks: the documents are scanned once, without a shuffle.  A larger one
is joined by Spark: fingerprints of both sides meet by shuffle, each meeting
(document, item, offset) cuts from the document the stretch that the item would
cover, and stretch and item are compared word by word.  Neither side's texts or
fingerprints pass through the driver then.  Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailforge.llm import wordnum as W
from retailforge.llm.common import small_enough, tidy, with_row
from retailforge.session import stage

WINDOW = 13
K = 8
#: Most text and items of a benchmark whose index is sent to the tasks whole.
INDEX_BYTES, INDEX_ITEMS = 32 << 20, 1 << 20


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest gram of each ``w`` consecutive ones."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = grams[w - 1:].copy()
    off = np.full(n, w - 1)
    for j in range(w - 2, -1, -1):
        g = grams[j:j + n]
        less = g < low
        low[less] = g[less]
        off[less] = j
    return np.unique(np.arange(n) + off)


class BenchmarkIndex:
    """Words and sorted fingerprints of some benchmark items."""

    def __init__(self, items: list[tuple[int | str | None, str]], window: int = WINDOW, k: int = K, long_ids: bool = True):
        self.window, self.k, self.long_ids = window, k, long_ids
        self.ids, self.words, self.hashes = [], [], []
        prints, short = [], {}
        for item, text in items:
            if not text:
                continue
            b = W.Block(0, raw := np.frombuffer(text.encode(), np.uint8), np.array([0, len(raw)]), W.ALNUM, True)
            n = len(b.hashes)
            if not n:
                continue
            i = len(self.ids)
            self.ids.append(item)
            low = bytes(W._FOLD[raw])
            self.words.append([low[s:e] for s, e in zip(b.starts, b.ends)])
            self.hashes.append(b.hashes)
            if n < window:
                short.setdefault(n, []).append((W.gram_hashes(b.hashes, n)[0], i))
            else:
                g = W.gram_hashes(b.hashes, k)
                prints += [(g[p], i, p) for p in winnow(g, window - k + 1)]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.prints = self._sorted([x[0] for x in prints], [x[1] for x in prints], [x[2] for x in prints])
        self.short = {n: self._sorted([x[0] for x in v], [x[1] for x in v], [0] * len(v)) for n, v in short.items()}

    @staticmethod
    def _sorted(keys, items, at):
        keys = np.array(keys, np.uint64)
        o = np.argsort(keys, kind="stable")
        return keys[o], np.array(items, np.int64)[o], np.array(at, np.int64)[o]

    def seeds(self, b: W.Block):
        """(word position, item, position in item) of every shared fingerprint, as three arrays."""
        found = []
        text = b.text_of_word()

        def probe(pos, grams, entry):
            keys, items, at = entry
            lo = np.searchsorted(keys, grams, "left")
            hit = (lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == grams)
            pos, grams, lo = pos[hit], grams[hit], lo[hit]
            n = np.searchsorted(keys, grams, "right") - lo
            row = np.repeat(np.arange(len(pos)), n)
            j = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            found.append((pos[row], items[j], at[j]))

        if len(self.prints[0]) and len(b.hashes) >= self.window:
            g = W.gram_hashes(b.hashes, self.k)
            # winnowing over the whole block also keeps all that per-text winnowing keeps; grams that
            # cross a text border can only shadow others in windows that cross it too
            p = winnow(g, self.window - self.k + 1)
            p = p[text[p] == text[p + self.k - 1]]
            probe(p, g[p], self.prints)
        for n, entry in self.short.items():
            g = W.gram_hashes(b.hashes, n)
            if len(g):
                p = np.flatnonzero(text[:len(g)] == text[n - 1:])
                probe(p, g[p], entry)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def hits(self, b: W.Block) -> dict[int, tuple[list, set]]:
        """text -> (runs of hit words as (first, past last), items)."""
        pos, item, at = self.seeds(b)
        out: dict[int, tuple[list, set]] = {}
        if not len(pos):
            return out
        text = np.searchsorted(b.first, pos, "right") - 1
        diag = pos - at
        o = np.lexsort((pos, diag, item, text))
        done = (-1, -1, -1)
        end = -1
        low = W._FOLD[b.data]
        for p, i, a, t, d in zip(pos[o].tolist(), item[o].tolist(), at[o].tolist(), text[o].tolist(), diag[o].tolist()):
            if (t, i, d) == done and p < end:
                continue
            first, last = int(b.first[t]), int(b.first[t + 1])
            mine, theirs = b.hashes, self.hashes[i]
            s, x = p, a
            while s > first and x > 0 and mine[s - 1] == theirs[x - 1]:
                s, x = s - 1, x - 1
            e, y = p, a
            while e < last and y < len(theirs) and mine[e] == theirs[y]:
                e, y = e + 1, y + 1
            done, end = (t, i, d), max(e, p + 1)
            need = min(self.window, len(theirs))
            # hashes agree; now the words themselves
            same = [bytes(low[b.starts[q]:b.ends[q]]) == w for q, w in zip(range(s, e), self.words[i][x:y])]
            r = 0
            for q in range(len(same) + 1):
                if q == len(same) or not same[q]:
                    if q - r >= need:
                        spans, items = out.setdefault(t, ([], set()))
                        spans.append((s + r - first, s + q - first))
                        items.add(self.ids[i])
                    r = q + 1
        return out


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _scan(index):
    """Map step over ``row, text``: number of words, and what the items of the index hit."""
    def run(batches):
        ix = index.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans, items = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for b in W.blocks(batch.column(1)):
                n_words[b.row:b.row + len(b)] = np.diff(b.first)
                for t, (s, i) in ix.hits(b).items():
                    spans[b.row + t] = [{"start": x, "stop": y} for x, y in merge_spans(s)]
                    items[b.row + t] = sorted(i, key=lambda x: (x is not None, x))
            kind = pa.int64() if ix.long_ids else pa.string()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(spans, _SPANS), pa.array(items, pa.list_(kind))],
                names=["row", "n_words", "hit_spans", "hit_items"])
    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def item_kind(benchmark: DataFrame, id_col: str) -> str:
    """Whole numbers are carried as longs, identifiers of any other type as text."""
    return "long" if isinstance(benchmark.select(f"`{id_col}`").schema[0].dataType, T.IntegralType) else "string"


def _doc_prints(window: int, k: int, sizes: list[int]):
    """Map step over ``uid, text``: ``uid, size, print, pos`` of the winnowed grams (size 0) and of all grams of the short items' sizes."""
    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for b in W.blocks(batch.column(1)):
                text = b.text_of_word()
                found = []
                if len(b.hashes) >= window:
                    g = W.gram_hashes(b.hashes, k)
                    p = winnow(g, window - k + 1)
                    found.append((0, p[text[p] == text[p + k - 1]], g))
                for n in sizes:
                    g = W.gram_hashes(b.hashes, n)
                    found.append((n, np.flatnonzero(text[:len(g)] == text[n - 1:][:len(g)]), g))
                for n, p, g in found:
                    t = text[p]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uid[b.row + t]), pa.array(np.full(len(p), n, np.int64)), pa.array(g[p].view(np.int64)), pa.array(p - b.first[t])],
                        names=["uid", "size", "print", "pos"])
    return run


def _words_of(b: W.Block):
    low = W._FOLD[b.data]
    return lambda first, last: b" ".join(bytes(low[b.starts[q]:b.ends[q]]) for q in range(first, last)).decode()


def _item_prints(window: int, k: int):
    """Map step over ``iid, text``: ``iid, words, n, prints`` (size, print, position) of items that have words."""
    def run(batches):
        for batch in batches:
            iid = batch.column(0).to_numpy()
            rows = []
            for b in W.blocks(batch.column(1)):
                words = _words_of(b)
                for t in range(len(b)):
                    first, last = int(b.first[t]), int(b.first[t + 1])
                    n, h = last - first, b.hashes[first:last]
                    if not n:
                        continue
                    if n < window:
                        prints = [(n, int(W.gram_hashes(h, n).view(np.int64)[0]), 0)]
                    else:
                        g = W.gram_hashes(h, k)
                        prints = [(0, int(g[p:p + 1].view(np.int64)[0]), int(p)) for p in winnow(g, window - k + 1)]
                    rows.append((int(iid[b.row + t]), words(first, last), n, [dict(zip(("size", "print", "at"), x)) for x in prints]))
            if rows:
                kind = pa.list_(pa.struct([("size", pa.int64()), ("print", pa.int64()), ("at", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), kind))],
                                                 names=["iid", "words", "n", "prints"])
    return run


def _stretches(batches):
    """Map step over ``uid, text, seeds``: the words of the document that an item at an offset would cover."""
    for batch in batches:
        uid, seeds = batch.column(0).to_numpy(), batch.column(2)
        for b in W.blocks(batch.column(1)):
            words = _words_of(b)
            for t in range(len(b)):
                first, size = int(b.first[t]), int(b.first[t + 1] - b.first[t])
                rows = []
                for s in seeds[b.row + t].as_py():
                    start, stop = max(s["diag"], 0), min(s["diag"] + s["n"], size)
                    rows.append((int(uid[b.row + t]), s["iid"], start, start - s["diag"], words(first + start, first + stop)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, y) for c, y in zip(zip(*rows), (pa.int64(),) * 4 + (pa.string(),))],
                    names=["uid", "iid", "start", "skip", "stretch"])


def _compare(window: int):
    """Map step over ``uid, start, skip, stretch, item, words, n``: runs of equal words of a window or a whole short item."""
    def run(batches):
        for batch in batches:
            rows = []
            for uid, start, skip, stretch, item, words, n in zip(*[c.to_pylist() for c in batch.columns]):
                mine = stretch.split(" ")
                same = [x == y for x, y in zip(mine, words.split(" ")[skip:skip + len(mine)])]
                r = 0
                for q in range(len(same) + 1):
                    if q == len(same) or not same[q]:
                        if q - r >= min(window, n):
                            rows.append((uid, start + r, start + q, item))
                        r = q + 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), batch.schema.field("item").type)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), kinds)], names=["uid", "start", "stop", "item"])
    return run


def _finish(batches):
    """Map step over ``row, text, hit_spans, hit_items``: number of words, runs merged."""
    for batch in batches:
        n_words = np.zeros(batch.num_rows, np.int64)
        for b in W.blocks(batch.column(1)):
            n_words[b.row:b.row + len(b)] = np.diff(b.first)
        spans = [[{"start": a, "stop": z} for a, z in merge_spans([(x["start"], x["stop"]) for x in s or []])] for s in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(spans, _SPANS), batch.column(3)],
                                         names=["row", "n_words", "hit_spans", "hit_items"])


def _joined(docs: DataFrame, text_col: str, items: DataFrame, window: int, k: int, schema: T.StructType) -> DataFrame:
    """The join by shuffle: ``docs`` (row) against ``items`` (item, text).

    Meetings and hits are written before the documents are joined with them,
    so Spark knows their size: few of them are broadcast and the texts stay
    where they are, many are joined by shuffle.
    """
    base = stage(docs.select(F.monotonically_increasing_id().alias("uid"), "row"), "decontam-docs")
    text = F.col(f"row.`{text_col}`").alias("text")
    given = stage(items.where("text IS NOT NULL").withColumn("iid", F.monotonically_increasing_id()), "decontam-items")
    prints = "array<struct<size:long,print:long,at:long>>"
    known = stage(given.select("iid", "text").mapInArrow(_item_prints(window, k), f"iid long, words string, n long, prints {prints}")
                  .join(given.select("iid", "item"), "iid"), "decontam-prints")
    theirs = known.select("iid", "n", F.inline("prints"))
    sizes = [r.size for r in theirs.where("size > 0").select(F.col("size").alias("size")).distinct().collect()]  # below window
    mine = base.select("uid", text).mapInArrow(_doc_prints(window, k, sizes), "uid long, size long, print long, pos long")
    met = mine.join(theirs, ["size", "print"]).select("uid", "iid", (F.col("pos") - F.col("at")).alias("diag"), "n").distinct()
    seeds = stage(met.groupBy("uid").agg(F.collect_list(F.struct("iid", "diag", "n")).alias("seeds")), "decontam-seeds")
    cut = base.select("uid", text).join(seeds, "uid").mapInArrow(_stretches, "uid long, iid long, start long, skip long, stretch string")
    runs = cut.join(known, "iid").select("uid", "start", "skip", "stretch", "item", "words", "n")
    kind = given.schema["item"].dataType.simpleString()
    hits = runs.mapInArrow(_compare(window), f"uid long, start long, stop long, item {kind}").groupBy("uid").agg(
        F.collect_set(F.struct("start", "stop")).alias("hit_spans"),
        F.transform(F.sort_array(F.collect_set(F.struct("item"))), lambda x: x["item"]).alias("hit_items"))
    hits = stage(hits, "decontam-hits")
    none = F.array().cast(f"array<{kind}>")
    full = base.join(hits, "uid", "left").select("row", text, "hit_spans", F.coalesce("hit_items", none).alias("hit_items"))
    return full.mapInArrow(_finish, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, k: int = K, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``row, n_words, hit_spans, hit_items``: per document the merged runs of hit words and the items they occur in.

    ``row`` holds all columns of the document, so extra columns never clash.
    NULL or empty text has no words and no hits; items whose text is NULL or
    empty hit nothing; items without an identifier hit like others and stand
    as one NULL in ``hit_items``; items that repeat count once.  An
    empty benchmark hits nothing; an empty table gives no rows.
    """
    if not 1 <= k <= window:
        raise ValueError("a gram has 1 to window words")
    spark = docs.sparkSession
    df = with_row(docs, text_col)
    kind = item_kind(benchmark, item_col)
    items = benchmark.select(F.col(f"`{item_col}`").cast(kind).alias("item"), F.col(f"`{item_text}`").alias("text"))
    result = df.select("row", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,stop:long>>").alias("hit_spans"),
                       F.array().cast(f"array<{kind}>").alias("hit_items"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in result.schema])
    if not small_enough(items, INDEX_ITEMS, F.coalesce(F.octet_length("text"), F.lit(0)), index_bytes):
        return _joined(df, text_col, items, window, k, schema)
    index = BenchmarkIndex([tuple(r) for r in items.where("text IS NOT NULL").collect()], window, k, kind == "long")
    return df.mapInArrow(tidy(_scan(spark.sparkContext.broadcast(index))), schema)


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The contract's rule: some hit words, and at least one word in twenty."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def hit_words():
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their columns unchanged."""
    found = contamination(docs, benchmark).withColumn("n_hit", hit_words())
    return found.where(~contaminated()).select("row.*")
