"""Byte-pair encoding of numpy text blocks by dynamic programming over prefixes.

A text is first cut into pieces (words with their leading space, digits,
other marks, white space) as the vocabulary's own pattern cuts it; merges
never cross pieces.  Inside a piece, the encoding of a prefix is the encoding
of a shorter prefix plus one last token, and that token is the only one
whose pair with the token before it survives the merge order.  One pass over
the positions therefore stores the last token and the exact token count of
every prefix; nothing is encoded twice.  All different pieces of a block are
handled together, position by position.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa

from retailforge.llm import wordnum as W
from retailforge.llm.common import held
from retailforge.llm.trie import Trie

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0
#: pieces of more bytes are handled one at a time
LONG = 48
#: bytes of text handled at once: dozens of arrays have a number per byte
BLOCK = 1 << 18
#: different pieces that a worker remembers between blocks
MEMO = 250_000
# Fixed values of the vocabulary's pattern: short endings split off a word.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def code_point_classes() -> np.ndarray:
    """Letter, digit, white space or other, of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = LETTER
        elif k == "N":
            table[c] = DIGIT
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the rest from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token trie, merge pairs and split table of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {bytes(letters[c] for c in s): i for s, i in ids.items() if s not in self.special}
        n = max(ids.values()) + 1
        self.size = np.zeros(n, np.int64)
        for t, i in tokens.items():
            self.size[i] = len(t)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs, last = {}, -1
        for a, b in merges:
            i = ids[a + b]
            if i <= last or ids[a] >= i or ids[b] >= i:
                raise ValueError("identifiers must follow the merge order")
            last = i
            pairs[(ids[a] << 20) | ids[b]] = i
            self.left[i], self.right[i] = ids[a], ids[b]
        base = self.left < 0
        self.left[base] = self.right[base] = np.flatnonzero(base)
        self._hash_pairs(pairs)
        self.trie = Trie(tokens)

    def _hash_pairs(self, pairs: dict[int, int]):
        """Open addressing, so that a look-up is a few gathers."""
        bits = 18
        self._mult, self._shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
        self._keys = np.full((1 << bits) + 64, -1, np.int64)
        self._vals = np.full((1 << bits) + 64, 1 << 30, np.int64)
        self._met, self._met_good = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)
        self._probes = 1
        for k, v in pairs.items():
            h = int((k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits))
            p = 1
            while self._keys[h] >= 0:
                h, p = h + 1, p + 1
            self._keys[h], self._vals[h] = k, v
            self._probes = max(self._probes, p)
        assert self._probes < 64

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token that a and b merge to, or a number beyond all tokens."""
        key = (a << 20) | b
        h = ((key.astype(np.uint64) * self._mult) >> self._shift).astype(np.int64)
        out = np.full(len(key), 1 << 30, np.int64)
        todo = np.arange(len(key))
        for _ in range(self._probes):
            k = self._keys[h]
            hit = k == key
            out[todo[hit]] = self._vals[h[hit]]
            more = ~hit & (k >= 0)
            if not more.any():
                break
            todo, h, key = todo[more], h[more] + 1, key[more]
        return out

    def pairs_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stays`` with a table of the pairs met lately: one slot per hash, overwritten on collision."""
        key = (a.astype(np.int64) << 20) | b
        at = ((key.astype(np.uint64) * self._mult) >> self._shift).astype(np.int64)
        good = self._met_good[at]
        new = np.flatnonzero(self._met[at] != key)
        if len(new):
            key, at = key[new], at[new]
            good[new] = found = self.stays(a[new], b[new])
            # of two new pairs with one slot, the last is written to both tables
            self._met[at] = key
            last = self._met[at] == key
            self._met_good[at[last]] = found[last]
        return good

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of a and b together gives just a, b.

        Undo merges of the two tokens from the latest on; if the two parts
        that touch at the border could have merged before one that was undone,
        the border would not have survived.
        """
        ok = np.ones(len(a), bool)
        todo = np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 29, np.int64)
        while len(todo):
            bad = self.merged(a, b) < limit
            ok[todo[bad]] = False
            go = ~bad
            todo, a, b = todo[go], a[go], b[go]
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            undo_a = ~whole_a & (whole_b | (a > b))
            undo_b = ~whole_b & ~undo_a
            # a merge of the border may tie with the undone merge of the right token only from the left side
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = undo_a | undo_b
            todo, a, b, limit = todo[go], a[go], b[go], limit[go]
        return ok

    def prefixes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Token count and last token of every byte prefix: two arrays (pieces, 1 + longest piece)."""
        n, longest = len(starts), int(sizes.max(initial=0))
        count = np.zeros((n, longest + 1), np.int32)
        last = np.full((n, longest + 1), -1, np.int32)
        for s in range(longest):
            for w, t, e in self.trie.matches(data, starts, sizes, s):
                open_ = last[w, e] < 0
                w, t = w[open_], t[open_]
                if s:
                    good = self.pairs_stay(last[w, s], t)
                    w, t = w[good], t[good]
                last[w, e] = t
                count[w, e] = count[w, s] + 1
        return count, last


class Pieces:
    """The pieces of a block of texts: byte ranges, text number, hash; special strings are pieces with ``special`` >= 0."""

    def __init__(self, block_row: int, data: np.ndarray, bounds: np.ndarray, classes: np.ndarray, special: dict[str, int]):
        self.row, self.data, self.bounds = block_row, data, bounds
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (data & 0xC0) != 0x80
        self.at = np.append(np.flatnonzero(lead), len(data))  # byte offset of each code point
        n = len(cp)
        edges = np.searchsorted(self.at, bounds)
        marks = []
        if special and any(s.encode() in raw for s in special):
            pat = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True)))
            for t in range(len(bounds) - 1):
                for m in pat.finditer(raw, bounds[t], bounds[t + 1]):
                    a, b = np.searchsorted(self.at, m.span())
                    marks.append((a, b, special[m.group().decode()]))
        cuts = np.unique(np.concatenate([edges, [x for a, b, _ in marks for x in (a, b)]]).astype(np.int64)) if marks else np.unique(edges)
        c = classes[cp]
        self.chars, self.edges, self.classes = cp, edges, c
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.ending = np.zeros(0, bool)
            self.space_runs = (np.zeros(0, np.int64),) * 2
            self._finish(marks)
            return
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(c[1:], c[:-1], out=first[1:])
        inner = cuts[(cuts > 0) & (cuts < n)]
        first[inner] = True
        rs = np.flatnonzero(first)
        re_ = np.append(rs[1:], n)
        cls = c[rs]
        cut_after = np.zeros(n + 1, bool)
        cut_after[cuts] = True
        # white space before other characters of the text gives its last blank away, or leaves it as a piece
        space = cls == SPACE
        followed = space & ~cut_after[re_]
        self.space_runs = (rs[space], re_[space])
        blank = followed & (cp[re_ - 1] == 32)
        start = first.copy()
        start[re_[followed] - 1] = True  # the last white space character starts a piece ...
        start[re_[blank]] = False        # ... which goes on into the next run where it is a blank
        self.ending = np.zeros(0, bool)
        # short endings
        q = np.flatnonzero((cls == OTHER) & (re_ - rs == 1) & (cp[rs] == 39) & start[rs] & ~cut_after[re_])
        q = rs[q]
        q = q[c[np.minimum(q + 1, n - 1)] == LETTER] if len(q) else q
        ending = []
        for p in q.tolist():
            e = int(re_[np.searchsorted(rs, p + 1)])
            tail = "".join(map(chr, cp[p:min(e, p + 3)]))
            m = next((x for x in ENDINGS if tail.startswith(x)), None)
            if m:
                start[p + 1] = False
                if p + len(m) < e:
                    start[p + len(m)] = True
                if len(m) == 3:
                    ending.append(p)
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n)
        self.ending = np.array(ending, np.int64)
        self._finish(marks)

    def _finish(self, marks):
        keep = np.ones(len(self.starts), bool)
        self.special = np.full(len(self.starts), -1, np.int64)
        for a, b, token in marks:
            i, j = np.searchsorted(self.starts, (a, b))
            keep[i + 1:j] = False
            self.ends[i], self.special[i] = b, token
        self.starts, self.ends, self.special = self.starts[keep], self.ends[keep], self.special[keep]
        self.first = np.searchsorted(self.starts, self.edges)
        p, q = W._power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(W._BYTE[self.data] * p[:len(self.data)], out=sums[1:])
        self._sums, self._inverse = sums, q

    def hashes(self, starts, ends) -> np.ndarray:
        a, b = self.at[starts], self.at[ends]
        return W.mix((self._sums[b] - self._sums[a]) * self._inverse[a])


class Flat:
    """Growing flat array of rows of different lengths."""

    def __init__(self, dtype):
        self.data, self.used = np.empty(1 << 16, dtype), 0
        self.start, self.size, self.rows = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.used + len(values), self.rows + len(sizes)
        if n > len(self.data):
            self.data = np.resize(self.data, max(n, 2 * len(self.data)))
        if m > len(self.start):
            self.start, self.size = (np.resize(x, max(m, 2 * len(x))) for x in (self.start, self.size))
        self.data[self.used:n] = values
        self.size[self.rows:m] = sizes
        self.start[self.rows:m] = self.used + np.cumsum(sizes) - sizes
        self.used, self.rows = n, m

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The rows one after another."""
        n = self.size[rows].astype(np.int64)
        return self.data[np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Encoder:
    """Remembers the prefix tables of the pieces it has met.

    ``lookup`` maps pieces to rows of ``counts`` (token count of every code
    point prefix) and ``tokens`` (encoding of the whole piece).
    """

    def __init__(self, path: str, counts: bool = True):
        self.vocab, self.keep_counts = Vocabulary(path), counts
        self.classes = code_point_classes()
        self._clear()

    def _clear(self):
        self.known: dict[int, int] = {}
        self.tokens, self.counts = Flat(np.uint32), Flat(np.int32)

    def blocks(self, col: pa.Array, size: int = BLOCK):
        data, bounds = W.as_bytes(col)
        a, n = 0, len(bounds) - 1
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1))
            yield Pieces(a, data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], self.classes, self.vocab.special)
            a = b

    def lookup(self, p: Pieces, starts, ends) -> np.ndarray:
        """Row in ``tokens`` and ``counts`` of each piece, valid until the next call."""
        if not len(starts):
            return np.zeros(0, np.int64)
        h, at, back = np.unique(p.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > MEMO:
            self._clear()
        known = self.known
        rows = np.array([known.get(x, -1) for x in h.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            a, b = p.at[starts[at[new]]], p.at[ends[at[new]]]
            new = new[np.argsort(b - a, kind="stable")]  # pieces of one length step together
            rows[new] = np.arange(self.tokens.rows, self.tokens.rows + len(new))
            known.update(zip(h[new].tolist(), rows[new].tolist()))
            self._encode(p, starts[at[new]], ends[at[new]])
        return rows[back]

    def _encode(self, p: Pieces, starts, ends):
        a, b = p.at[starts], p.at[ends]
        size = b - a
        n_short = int(np.searchsorted(size, LONG, "right"))
        lead = np.zeros(len(p.data) + 1, bool)
        lead[p.at] = True
        for u in range(0, n_short, 8192):
            g = slice(u, min(u + 8192, n_short))
            sizes = size[g]
            count, last = self.vocab.prefixes(p.data, a[g], sizes)
            # walk the last tokens back from the end of each piece
            total = count[np.arange(len(sizes)), sizes]
            stop = np.cumsum(total)
            ids = np.empty(int(stop[-1]), np.uint32)
            pos, fill, who = sizes.copy(), stop - 1, np.arange(len(sizes))
            while len(who):
                t = last[who, pos]
                ids[fill] = t
                pos = pos - self.vocab.size[t]
                go = pos > 0
                who, pos, fill = who[go], pos[go], fill[go] - 1
            self.tokens.append(ids, total)
            if not self.keep_counts:
                continue
            step = np.arange(1, count.shape[1])
            ends_char = (step <= sizes[:, None]) & lead[np.minimum(a[g][:, None] + step, len(p.data))]
            self.counts.append(count[:, 1:][ends_char], ends_char.sum(1))
        for i in range(n_short, len(size)):
            count, chain = self._long(p.data[a[i]:b[i]])
            self.tokens.append(chain, np.array([len(chain)]))
            if self.keep_counts:
                c = count[lead[a[i] + 1:b[i] + 1]]
                self.counts.append(c, np.array([len(c)]))

    def _long(self, data: np.ndarray):
        """A piece of many bytes: the same recursion, position by position."""
        v, n = self.vocab, len(data)
        last, count = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        raw = data.tolist()
        memo: dict[tuple[int, int], bool] = {}
        for s in range(n):
            state, before = 0, int(last[s])
            for d in range(s, n):
                r = v.trie.row[state]
                if r < 0:
                    break
                state = int(v.trie.next[r, raw[d]])
                if state < 0:
                    break
                t = int(v.trie.token_at[state])
                if t < 0 or last[d + 1] >= 0:
                    continue
                if s:
                    good = memo.get((before, t))
                    if good is None:
                        good = memo[before, t] = bool(v.stays(np.array([before]), np.array([t]))[0])
                    if not good:
                        continue
                last[d + 1], count[d + 1] = t, count[s] + 1
        chain, e = [], n
        while e:
            chain.append(last[e])
            e -= int(v.size[last[e]])
        return count[1:].astype(np.int64), np.array(chain[::-1], np.uint32)


def encoder(path: str, counts: bool = True) -> Encoder:
    """The worker process's encoder for a vocabulary, with or without the counts of prefixes."""
    return held((Encoder, path, counts), lambda: Encoder(path, counts))
