"""Token counts by prefix dynamic programming.

The encoder stores the exact token count of every prefix of every different
piece (see ``bpe``); a text's counts are those of its pieces added up.  How
many tokens a prefix has, and which prefix fits a budget, are then look-ups
and need no further encoding.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailforge.llm import bpe
from retailforge.llm.common import tidy, with_row


def vocabulary_path(name: str) -> str:
    """An absolute path as it is, anything else as a file of the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def piece_sizes(p: bpe.Pieces, e: bpe.Encoder):
    """Encoder rows and token counts of the pieces of a block; a special string is one token."""
    plain = p.special < 0
    rows = np.full(len(p.starts), -1, np.int64)
    rows[plain] = e.lookup(p, p.starts[plain], p.ends[plain])
    sizes = np.ones(len(rows), np.int64)
    sizes[plain] = e.tokens.size[rows[plain]]
    return rows, sizes


def prefix_counts(p: bpe.Pieces, e: bpe.Encoder):
    """``(counts, totals)``: tokens of every code point prefix of every text, one after another, and of whole texts."""
    rows, sizes = piece_sizes(p, e)
    before = np.concatenate([[0], np.cumsum(sizes)])
    totals = before[p.first[1:]] - before[p.first[:-1]]
    text = np.repeat(np.arange(len(p.edges) - 1), np.diff(p.first))
    base = before[:-1] - before[p.first[text]]
    out = np.zeros(len(p.chars), np.int64)
    plain = p.special < 0
    width = (p.ends - p.starts)[plain]
    at = np.repeat(p.starts[plain] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    out[at] = e.counts.gather(rows[plain]) + np.repeat(base[plain], width)
    # of the endings that consist of three characters, the first two do not belong together yet
    for c in p.ending.tolist():
        out[c + 1] = base[np.searchsorted(p.starts, c)] + 2
    # a prefix that ends in white space has that white space as one piece
    a, b = p.space_runs
    wide = b - a > 1
    a, b = a[wide], b[wide]
    if len(a):
        # the look-up may clear what earlier rows point to, so it comes last
        start = base[np.searchsorted(p.starts, a)]
        runs = e.lookup(p, a, b)
        width = b - a
        at = np.repeat(a - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        out[at] = e.counts.gather(runs) + np.repeat(start, width)
    # inside a special string the prefix is ordinary text that goes on from the last cut
    for k in np.flatnonzero(~plain).tolist():
        s, t = int(p.starts[k]), int(p.ends[k])
        first = int(p.first[text[k]])
        cut = max([first, *[j + 1 for j in range(first, k) if p.special[j] >= 0]])
        lo = int(p.starts[cut]) if cut < k else s
        part = p.data[p.at[lo]:p.at[t]]
        q = bpe.Pieces(0, part, np.array([0, len(part)]), e.classes, {})
        out[s:t - 1] = prefix_counts(q, e)[0][s - lo:t - 1 - lo] + base[cut]
        out[t - 1] = base[k] + 1
    return out, totals


def _count(path: str, limit: int, store: bool):
    def run(batches):
        e = bpe.encoder(vocabulary_path(path))
        for batch in batches:
            row, text = batch.column(0), batch.column(1)
            n_tokens, fit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            stored, sizes = [], []
            for p in e.blocks(text):
                counts, totals = prefix_counts(p, e)
                n_tokens[p.row:p.row + len(totals)] = totals
                chars = np.diff(p.edges)
                fit[p.row:p.row + len(totals)] = chars
                for i in np.flatnonzero(totals > limit).tolist():
                    own = np.flatnonzero(counts[p.edges[i]:p.edges[i + 1]] <= limit)
                    fit[p.row + i] = own[-1] + 1 if len(own) else 0
                if store:
                    stored.append(counts.astype(np.int32))
                    sizes.append(chars)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            cols = [row, n_bytes, pa.array(n_tokens), pa.array(fit)]
            names = ["row", "n_bytes", "n_tokens", "fit_chars"]
            if store:
                off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
                flat = np.concatenate(stored) if stored else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat)))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 1024, store: bool = False) -> DataFrame:
    """``row, n_bytes, n_tokens, fit_chars`` and, with ``store``, ``prefix_tokens``.

    ``fit_chars`` is the length of the longest prefix of at most ``limit``
    tokens; ``prefix_tokens[i]`` is the token count of the first ``i + 1``
    code points.  NULL counts as empty (0 tokens); every row keeps its own
    result, however often it is repeated; an empty table gives no rows.
    """
    df = with_row(docs, text_col)
    out = T.StructType([T.StructField("row", df.schema["row"].dataType), T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())])
    if store:
        out.add("prefix_tokens", T.ArrayType(T.IntegerType()))
    return df.mapInArrow(tidy(_count(vocabulary, limit, store)), out)


def tokens_of_prefix(prefix_tokens: str, n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` code points, read from the stored counts."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(prefix_tokens))
    return F.when(n <= 0, F.lit(0)).otherwise(F.get(prefix_tokens, n - 1))


def longest_prefix(prefix_tokens: str, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, read from the stored counts."""
    last = F.array_position(F.reverse(F.transform(prefix_tokens, lambda c: c <= budget)), True)
    return F.when(last > 0, F.size(prefix_tokens) + 1 - last).otherwise(F.lit(0)).cast("long")
