"""Language identification by segmentation-marginalised unigrams.

A language gives every piece of a fixed public vocabulary a probability; a
word (with its leading word mark) may be cut into pieces in many ways, and
its probability is the sum over all of them, which the forward recursion
computes position by position.  Single bytes back up pieces that are
missing, so no word is impossible.  The probabilities are learned by
expectation-maximisation over counted words: expected piece counts are
gathered by Spark, the tables on the driver hold one number per piece and
language.  A text is scored word by word under every language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailforge.llm import wordnum as W
from retailforge.llm.common import held, tidy, with_row
from retailforge.llm.tokencount import vocabulary_path
from retailforge.llm.trie import Trie
from retailforge.session import stage

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: labelled rows per language that the classifier is fitted on, and rounds of the fit
FIT_ROWS, ROUNDS = 4_000, 3
#: words of more bytes are rescaled at every position; different words that a worker remembers
LONG, MEMO = 48, 150_000
#: short words whose prefixes are handled beside each other
TOGETHER = 2048
#: factor per byte that keeps products of small probabilities in range
SCALE = 16.0
MARK = "▁"
#: prefixes x languages of the long words that are handled beside each other
LONG_CELLS = 4 << 20


class Pieces:
    """The pieces of the vocabulary and the 256 single bytes behind them."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        text = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                text.setdefault(sp.id_to_piece(i).encode(), len(text))
        self.n = len(text) + 256
        self.first_byte = len(text)
        self.size = np.ones(self.n, np.int64)
        for t, i in text.items():
            self.size[i] = len(t)
        self.trie = Trie(text)

    def uniform(self) -> np.ndarray:
        return np.full(self.n, 1.0 / self.n)

    def words(self, words: list[bytes]):
        """Words, marked and ordered by length, as one byte array."""
        mark = MARK.encode()
        data = np.frombuffer(b"".join(mark + w for w in words), np.uint8)
        sizes = np.array([len(w) + len(mark) for w in words], np.int64)
        return data, np.cumsum(sizes) - sizes, sizes

    def steps(self, data, starts, sizes, s):
        """All pieces that begin at position ``s``: the bytes themselves, then vocabulary pieces."""
        who = np.flatnonzero(sizes > s)
        yield who, self.first_byte + data[starts[who] + s].astype(np.int64), s + 1
        yield from self.trie.matches(data, starts, sizes, s)

    def forward(self, data, starts, sizes, scaled: np.ndarray) -> np.ndarray:
        """Scaled probability of every prefix under every language: (words, positions, languages)."""
        alpha = np.zeros((len(starts), int(sizes.max(initial=0)) + 1, scaled.shape[1]))
        alpha[:, 0] = 1.0
        for s in range(alpha.shape[1] - 1):
            for w, t, e in self.steps(data, starts, sizes, s):
                alpha[w, e] += alpha[w, s] * scaled[t]
        return alpha

    def long_word(self, data, scaled) -> np.ndarray:
        """Log probability of one long word under every language, rescaled at every position."""
        n, deepest = len(data), int(self.size.max())
        window = np.zeros((n + deepest + 1, scaled.shape[1]))
        window[0] = 1.0
        log = np.zeros(scaled.shape[1])
        start = np.zeros(1, np.int64)
        for s in range(n):
            top = np.maximum(window[s], 1e-300)
            window[s:s + deepest + 1] /= top  # only positions ahead can still change
            log += np.log(top)
            for _, t, e in self.steps(data, start, np.array([min(n, s + deepest)]), s):
                window[e] += window[s] * scaled[t[0]]
        return log + np.log(np.maximum(window[n], 1e-300))

    def log_probs(self, words: list[bytes], scaled: np.ndarray) -> np.ndarray:
        """Log probability of each word under every language."""
        out = np.empty((len(words), scaled.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if len(words[i]) <= LONG]
        for u in range(0, len(short), TOGETHER):
            part = short[u:u + TOGETHER]
            data, starts, sizes = self.words([words[i] for i in part])
            alpha = self.forward(data, starts, sizes, scaled)
            out[part] = np.log(np.maximum(alpha[np.arange(len(part)), sizes], 1e-300))
            out[part] -= (sizes * np.log(SCALE))[:, None]
        for i in order[len(short):]:
            data, _, sizes = self.words([words[i]])
            out[i] = self.long_word(data, scaled) - sizes[0] * np.log(SCALE)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces, languages) of counted words over all segmentations."""
        total = np.zeros((self.n, scaled.shape[1]))
        for u in range(0, len(words), TOGETHER):
            data, starts, sizes = self.words(words[u:u + TOGETHER])
            alpha = self.forward(data, starts, sizes, scaled)
            rows = np.arange(len(starts))
            weight = counts[u:u + TOGETHER] / np.maximum(alpha[rows, sizes], 1e-300)
            beta = np.zeros_like(alpha)
            beta[rows, sizes] = 1.0
            met, mass = [], []
            for s in range(alpha.shape[1] - 2, -1, -1):
                for w, t, e in self.steps(data, starts, sizes, s):
                    x = scaled[t] * beta[w, e]
                    beta[w, s] += x
                    met.append(t)
                    mass.append(x * alpha[w, s] * weight[w])
            t, x = np.concatenate(met), np.concatenate(mass)
            for g in range(x.shape[1]):
                total[:, g] += np.bincount(t, x[:, g], self.n)
        return total

    def expected_long(self, words: list[bytes], counts: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        """The same for words of any length, ordered by length: prefixes rescaled at every position.

        The backward pass carries the expected number of cuts at each
        position; a piece takes its share of those at its end.
        """
        langs, depth = scaled.shape[1], int(self.size.max())
        total = np.zeros((self.n, langs))
        v = len(words)
        while v:  # the longest first, as many as fit beside each other
            u = max(0, v - max(1, LONG_CELLS // (langs * (len(words[v - 1]) + depth))))
            data, starts, sizes = self.words(words[u:v])
            n, rows = int(sizes[-1]), v - u
            ahead, level = np.zeros((rows, depth + 1, langs)), np.zeros((rows, langs))
            ahead[:, 0] = 1.0
            log = np.empty((rows, n + 1, langs))  # of the probability of each prefix
            for s in range(n + 1):
                top = np.maximum(ahead[:, 0], 1e-300)
                ahead /= top[:, None]
                level += np.log(top)
                log[:, s] = level
                for w, t, e in self.steps(data, starts, sizes, s):
                    ahead[w, e - s] += ahead[w, 0] * scaled[t]
                ahead[:, :-1] = ahead[:, 1:]
                ahead[:, -1] = 0.0
            cuts = np.zeros_like(ahead)
            met, mass, held = [], [], 0
            for s in range(n, -1, -1):
                cuts[:, 1:] = cuts[:, :-1]
                cuts[:, 0] = np.where((sizes == s)[:, None], counts[u:v], 0.0)
                for w, t, e in self.steps(data, starts, sizes, s) if s < n else ():
                    x = cuts[w, e - s] * np.exp(log[w, s] - log[w, e]) * scaled[t]
                    cuts[w, 0] += x
                    met.append(t)
                    mass.append(x)
                    held += len(t)
                if held > 500_000 or not s:
                    t, x = np.concatenate(met), np.concatenate(mass)
                    for g in range(langs):
                        total[:, g] += np.bincount(t, x[:, g], self.n)
                    met, mass, held = [], [], 0
            v = u
        return total


def pieces(name: str) -> Pieces:
    path = vocabulary_path(name)
    return held((Pieces, path), lambda: Pieces(path))


class Model:
    """Languages, their priors, and piece probabilities (pieces, languages)."""

    def __init__(self, vocabulary: str, langs: list[str], prior: np.ndarray, probs: np.ndarray):
        self.vocabulary, self.langs, self.prior = vocabulary, langs, prior
        self.scaled = probs * SCALE ** pieces(vocabulary).size[:, None]
        self._clear()

    def _clear(self):
        self.known: dict[int, int] = {}
        self.table = np.empty((1 << 14, len(self.langs)))

    def word_scores(self, b: W.Block) -> np.ndarray:
        """Log probability of every word of a block under every language."""
        h, at, back = np.unique(b.hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMO:
            self._clear()
        rows = np.array([self.known.get(x, -1) for x in h.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            first = len(self.known)
            rows[new] = np.arange(first, first + len(new))
            low = W._FOLD[b.data].tobytes()
            words = [low[s:e] for s, e in zip(b.starts[at[new]].tolist(), b.ends[at[new]].tolist())]
            self.known.update(zip(h[new].tolist(), rows[new].tolist()))
            while len(self.table) < first + len(new):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[rows[new]] = pieces(self.vocabulary).log_probs(words, self.scaled)
        return self.table[rows[back]]


def _count_words(batches):
    """``lang, text`` rows -> words and their counts, summed over each batch."""
    for batch in batches:
        text, lang = batch.column(1), batch.column(0).to_pylist()
        counts: dict[tuple[str, bytes], int] = {}
        for b in W.blocks(text, W.NONSPACE):
            low = W._FOLD[b.data].tobytes()
            for i in range(len(b)):
                g = lang[b.row + i]
                u, v = b.first[i], b.first[i + 1]
                h, at, n = np.unique(b.hashes[u:v], return_index=True, return_counts=True)
                for k, c in zip((u + at).tolist(), n.tolist()):
                    key = (g, low[b.starts[k]:b.ends[k]])
                    counts[key] = counts.get(key, 0) + c
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()),
             pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def _expect(vocabulary: str, scaled):
    """Counted words -> expected piece counts, one row per partition, piece and language with any."""
    def run(batches):
        p, s = pieces(vocabulary), scaled.value
        total = np.zeros((p.n, s.shape[1]))
        for batch in batches:
            words = batch.column(0).to_pylist()
            counts = np.array(batch.column(1).to_pylist(), float).reshape(len(words), s.shape[1])
            order = sorted(range(len(words)), key=lambda i: len(words[i]))
            short = sum(len(w) <= LONG for w in words)
            for some, add in ((order[:short], p.expected), (order[short:], p.expected_long)):
                total += add([words[i] for i in some], counts[some], s)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "n"])
    return run


def is_held_out(id_col: str, mod: int = 4, rest: int = 2) -> Column:
    """Rows that no training looks at; a row without an identifier is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY,
        fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model | None:
    """Learn piece probabilities from the labelled rows that are not held out; None without any.

    Of a language with more than ``fit_rows`` labelled rows a share of about
    that many is used, chosen by a hash of the identifier; everything else
    about the classifier's data (languages, priors) counts all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"),
                       is_held_out(id_col).alias("out")).where("NOT out AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, fit_rows / sizes[g])))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counted = sample.select("lang", "text").mapInArrow(tidy(_count_words), "lang string, word binary, n long")
    by_lang = [F.sum(F.when(F.col("lang") == g, F.col("n")).otherwise(0)).cast("double") for g in langs]
    words = stage(counted.groupBy("word").agg(F.array(*by_lang).alias("n")), "language-words")
    p = pieces(vocabulary)
    probs = np.repeat(p.uniform()[:, None], len(langs), 1)
    for _ in range(rounds):
        scaled = spark.sparkContext.broadcast(probs * SCALE ** p.size[:, None])
        table = words.mapInArrow(tidy(_expect(vocabulary, scaled)), "piece int, lang int, n double")
        total = np.zeros_like(probs)
        for r in table.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():  # pieces x languages at most
            total[r.piece, r.lang] = r.n
        total += 0.02
        probs = total / total.sum(0)
        scaled.unpersist()
    prior = np.log(np.array([sizes[g] for g in langs], float))
    return Model(vocabulary, langs, prior - np.log(sum(sizes.values())), probs)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _predict(shared):
    def run(batches):
        m = shared.value if shared is not None else None
        for batch in batches:
            text, n = batch.column(1), batch.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            for b in W.blocks(text, W.NONSPACE) if m is not None else ():
                words = m.word_scores(b)
                sums = np.concatenate([np.zeros((1, words.shape[1])), np.cumsum(words, 0)])
                own = sums[b.first[1:]] - sums[b.first[:-1]] + m.prior
                top = own.max(1)
                post = np.exp(own - top[:, None])
                post /= post.sum(1)[:, None]
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[b.data])])[b.bounds]
                for i in range(len(b)):
                    if letters[i] == letters[i + 1]:
                        s = b.data[b.bounds[i]:b.bounds[i + 1]].tobytes().decode()
                        if not any(c.isalpha() for c in s):
                            continue
                    k = int(post[i].argmax())
                    pred[b.row + i], score[b.row + i] = m.langs[k], post[i, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)],
                                             names=["row", "lang_pred", "score"])
        if m is not None:
            m._clear()  # the worker lives on and so does the broadcast model; its remembered words need not
    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``row, lang_pred, score``: the likeliest language and its posterior probability.

    NULL texts and texts without a letter are ``und`` with score 0, and so is
    everything without a model; equal probabilities go to the language that
    sorts first.  The prediction sees the text only.
    """
    df = with_row(docs, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model) if model is not None else None
    out = T.StructType([T.StructField("row", df.schema["row"].dataType), T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    return df.mapInArrow(tidy(_predict(shared)), out)


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents whose language is recognised, columns unchanged."""
    found = identify(docs, fit(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
