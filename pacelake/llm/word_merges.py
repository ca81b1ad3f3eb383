"""Byte-pair merges of many words at once, for a byte-level vocabulary.

Words lie side by side in a matrix, a column for each word and a row for each byte. A round does one merge in
every word that still has one: the lowest rank, the leftmost among equals, as the tokenizers library does
one after the other. So a round costs a few array operations, and no word becomes an object of Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of the longest word that is taken.
LONGEST = 128
#: Places of a matrix, some 20 bytes each.
PLACES = 1 << 18
#: No merge: above every rank with its row.
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordMerges:
    """The merges of a model (the dictionary of a tokenizer's file); ValueError if it is of another kind."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        letters = byte_letters().items()
        if model.get("type") != "BPE" or odd or max(vocab.values()) >= 65_000 or any(x not in vocab or x + end not in vocab for _, x in letters):
            raise ValueError("not a byte-level vocabulary of plain merges")
        self.inner, self.last = np.empty(256, np.uint32), np.empty(256, np.uint32)
        for b, x in letters:
            self.inner[b], self.last[b] = vocab[x], vocab[x + end]
        #: Stands where no token is.
        self.gap = np.uint32(max(vocab.values()) + 1)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        left, right = np.array(list(merges), dtype=np.uint32).reshape(-1, 2).T
        rank, new = np.array(list(merges.values()), dtype=np.int32).reshape(-1, 2).T
        self.new = np.zeros(len(model["merges"]), np.uint32)
        self.new[rank] = new
        # a hash table with free places: a pair stands at its hash or at the next free place
        bits = max(8, int(5 * len(merges)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.empty = np.uint32(2**32 - 1)
        self.keys, self.ranks = np.full(1 << bits, self.empty), np.full(1 << bits, NONE)
        key = self._key(left, right)
        at = self._hash(key)
        todo = np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] == self.empty
            self.keys[at[todo[free]]] = key[todo[free]]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + np.uint32(1)) & self.mask
        self.ranks[at] = rank

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * (self.gap + np.uint32(1)) + right

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> self.shift

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or NONE."""
        key = self._key(left, right)
        at = self._hash(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        todo = np.flatnonzero((found != key) & (found != self.empty))
        at, key = at[todo], key[todo]
        while len(todo):
            at = (at + np.uint32(1)) & self.mask
            found = self.keys[at]
            hit = found == key
            out[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (found != self.empty)
            todo, at, key = todo[more], at[more], key[more]
        return out

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (uint32), and where those of each word start and how many they are. Words (large strings) have 1 to LONGEST bytes."""
        n = len(words)
        starts, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n:
            return np.empty(0, np.uint32), starts, counts
        at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        size = np.diff(at)
        order = np.argsort(size, kind="stable")  # words of like lengths lie together
        out, done, begin = [], 0, 0
        while begin < n:
            # up to double the length of the first word, and as many as fit
            rows = min(2 * int(size[order[begin]]), int(size[order[-1]]))
            end = min(int(np.searchsorted(size[order], rows, side="right")), begin + max(1, PLACES // rows))
            own = order[begin:end]
            ids, counts[own] = self._merged(data, at[own], size[own])
            starts[own] = done + np.cumsum(counts[own]) - counts[own]
            out.append(ids)
            done, begin = done + len(ids), end
        return np.concatenate(out), starts, counts

    def _merged(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(at), int(size.max())
        row = np.arange(rows)[:, None]
        raw = data[np.minimum(at + row, len(data) - 1)]
        # a row without tokens above and below; a token that has gone into the one before it leaves a gap
        ids = np.full((rows + 2, n), self.gap)
        ids[1:-1] = np.where(row < size - 1, self.inner[raw], np.where(row < size, self.last[raw], self.gap))
        row = np.arange(rows + 2, dtype=np.int32)[:, None]
        rank = np.full((rows + 2, n), NONE)
        pair = self.rank(ids[1:-2].reshape(-1), ids[2:-1].reshape(-1)).reshape(-1, n)
        rank[1:-2] = np.where(pair == NONE, NONE, pair << 8 | row[1:-2])
        after, before = np.repeat(row.astype(np.uint8) + 1, n, 1).reshape(-1), np.repeat(np.maximum(row, 1).astype(np.uint8) - 1, n, 1).reshape(-1)
        token, ranks = ids.reshape(-1), rank.reshape(-1)
        while True:
            best = rank.min(axis=0)
            col = np.flatnonzero(best != NONE)
            if not len(col):
                break
            best = best[col]
            p, new = best & 255, self.new[best >> 8]
            here = p.astype(np.int64) * n + col
            gone = after[here].astype(np.int64) * n + col
            token[here], token[gone], ranks[gone] = new, self.gap, NONE
            r, h = after[gone], before[here]
            right, left = r.astype(np.int64) * n + col, h.astype(np.int64) * n + col
            after[here], before[right] = r, p
            pair = self.rank(new, token[right])
            ranks[here] = np.where(pair == NONE, NONE, pair << 8 | p)
            pair = self.rank(token[left], new)
            ranks[left] = np.where(pair == NONE, NONE, pair << 8 | h)
        kept = ids != self.gap
        return ids.T[kept.T], kept.sum(axis=0)
