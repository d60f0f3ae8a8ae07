"""A byte trie as numpy tables, walked by many words at once."""

from __future__ import annotations

import numpy as np


class Trie:
    def __init__(self, tokens: dict[bytes, int]):
        nodes, children, token_at = {b"": 0}, [], [-1]
        for t in sorted(tokens, key=len):
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(nodes)
                    token_at.append(-1)
                    children.append((nodes[t[:k - 1]], t[k - 1], nodes[t[:k]]))
            token_at[nodes[t]] = tokens[t]
        self.token_at = np.array(token_at, np.int32)
        inner = sorted({p for p, _, _ in children})
        self.row = np.full(len(nodes), -1, np.int32)
        self.row[inner] = np.arange(len(inner), dtype=np.int32)
        self.next = np.full((max(1, len(inner)), 256), -1, np.int32)
        for p, c, q in children:
            self.next[self.row[p], c] = q

    def matches(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, s: int):
        """Tokens that begin at position ``s`` of the words: yields (words, tokens, end position)."""
        who = np.flatnonzero(sizes > s)
        state = np.zeros(len(who), np.int64)
        for d in range(s, int(sizes.max(initial=0))):
            live = sizes[who] > d
            if not live.all():
                who, state = who[live], state[live]
            row = self.row[state]
            live = row >= 0
            if not live.all():
                who, row = who[live], row[live]
            if not len(who):
                return
            state = self.next[row, data[starts[who] + d]]
            live = state >= 0
            if not live.all():
                who, state = who[live], state[live]
            token = self.token_at[state]
            at = np.flatnonzero(token >= 0)
            if len(at):
                yield who[at], token[at], d + 1
