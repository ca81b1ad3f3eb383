"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace) resolves a pre-token that is
itself a vocabulary entry, with one probe and one comparison. Tier two: a heap of candidate merges over
linked bytes encodes the rest, lowest rank first and leftmost among equals. The hash is built once on
the driver and broadcast; its size is bounded by the vocabulary. Words seen before are remembered in
each Python worker, up to a fixed number, so a text costs about one dictionary lookup a word.

Defined results: a null text counts as empty (no ids, empty bytes); texts of any length are encoded
whole, in blocks; other columns are ignored; repeated rows are encoded each; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Characters of a text that are encoded at once.
BLOCK = 1_000_000
#: Finds a space next to other white space, or at either end.
UNEVEN = re.compile(r" \s|\s |^ | $").search


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in rank order, from a file of base64 entry and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash: buckets by one half of a 64-bit hash, each with the first displacement under which its keys find free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = n = max(1, len(keys))
        self.m = max(1, n // per_bucket)
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        self.shift = np.zeros(self.m, dtype=np.int64)
        self.slot = np.full(n, -1, dtype=np.int64)
        free = bytearray(b"\x01") * n
        by_size = sorted((b for b in range(self.m) if buckets[b]), key=lambda b: -len(buckets[b]))
        many = [b for b in by_size if len(buckets[b]) > 1]
        for b in many:
            d = 0
            while True:
                at = [self._at(hashes[i], d) for i in buckets[b]]
                if all(free[x] for x in at) and len(set(at)) == len(at):
                    break
                d += 1
            self.shift[b] = d
            for i, x in zip(buckets[b], at):
                free[x] = 0
                self.slot[x] = i
        # a bucket of one key names its slot outright, as -1 - slot
        for b, x in zip(by_size[len(many) :], (x for x in range(n) if free[x])):
            self.shift[b] = -1 - x
            self.slot[x] = buckets[b][0]
        self.shift, self.slot = self.shift.tolist(), self.slot.tolist()

    def _at(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def get(self, key: bytes) -> int:
        """Index of the key if it is one of the keys; else that of another key, so compare."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        return self.slot[self._at(h, d) if d >= 0 else -1 - d]


class Encoder(dict):
    """Maps what follows a space up to the next one to the ids of space and word; unseen ones are encoded and remembered.

    The pattern's matches end before a single space that stands between two characters that are no white
    space, and none looks further, so the text may be cut there and each cut encoded by itself."""

    def __init__(self, vocabulary: list[bytes], perfect: PerfectHash, pattern: str):
        super().__init__()
        self.vocabulary, self.perfect = vocabulary, perfect
        self.findall, self.finditer = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.byte_id = [0] * 256
        self.merges: list[dict[int, int]] = [{} for _ in vocabulary]  # rank of left and right, if they merge
        for i, v in enumerate(vocabulary):
            if len(v) == 1:
                self.byte_id[v[0]] = i
            for k in range(1, len(v)):
                left, right = self.lookup(v[:k]), self.lookup(v[k:])
                if left >= 0 and right >= 0:
                    self.merges[left][right] = i
        self.ints = list(range(len(vocabulary)))
        self.decimal = [str(i) for i in self.ints]
        self.known: dict[str, Sequence[int]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def lookup(self, token: bytes) -> int:
        i = self.perfect.get(token)
        return i if self.vocabulary[i] == token else -1

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.pieces(" " + word))
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def pieces(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for pre in self.findall(text):
            ids = known.get(pre)
            if ids is None:
                data = pre.encode("utf-8")
                whole = self.lookup(data)
                ids = (self.ints[whole],) if whole >= 0 else self.merge(data)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[pre] = ids
            out.extend(ids)
        return out

    def merge(self, data: bytes) -> list[int]:
        n = len(data)
        byte_id, merges = self.byte_id, self.merges
        ids = [byte_id[x] for x in data]
        heap = []
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            rank = merges[left].get(right)
            if rank is not None:
                heap.append((rank, i - 1, right))
            left = right
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i, right = heappop(heap)
            left = ids[i]
            if left < 0:
                continue  # merged into what is before it
            j = after[i]
            if j >= n or ids[j] != right or merges[left].get(right) != rank:
                continue  # one of both has merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = merges[rank].get(ids[k])
                if r is not None:
                    heappush(heap, (r, i, ids[k]))
            h = before[i]
            if h >= 0:
                r = merges[ids[h]].get(rank)
                if r is not None:
                    heappush(heap, (r, h, rank))
        return [x for x in ids if x >= 0]

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a block of it at a time."""
        at = 0
        while at < len(text):
            cut = len(text) if len(text) - at <= BLOCK else text.rfind(" ", at, at + BLOCK)
            # a block may end before a single space only
            while at < cut < len(text) and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
                cut = text.rfind(" ", at, cut)
            if cut <= at:  # no such space: the rest, by the pattern's own steps
                for m in batched(self.finditer(text, at), BLOCK):
                    yield list(chain.from_iterable(self.pieces(x.group()) for x in m))
                return
            part = text[at:cut]
            if UNEVEN(part, 1 if at else 0):
                yield self.pieces(part)
            else:
                words = part.split(" ")
                first = [] if at else self.pieces(words[0])  # a later block begins with its space
                first.extend(chain.from_iterable(map(self.__getitem__, words[1:])))
                yield first
            at = cut

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


class Shared:
    """What tasks need to encode; the worker's encoder is made once and kept."""

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str):
        vocabulary = read_ranks(rank_path)
        self.key = f"{rank_path} {pattern}"
        self.sent = spark.sparkContext.broadcast((vocabulary, PerfectHash(vocabulary), pattern))

    def encoder(self) -> Encoder:
        if self.key not in _encoders:
            _encoders.clear()
            _encoders[self.key] = Encoder(*self.sent.value)
        return _encoders[self.key]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row."""
    shared = Shared(docs.sparkSession, rank_path, pattern)

    def run(batches):
        enc = shared.encoder()
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                ids = list(chain.from_iterable(enc.blocks(text.as_py() or "")))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, text bytes of every row of doc_id, ids."""
    shared = Shared(rows.sparkSession, rank_path, pattern)

    def run(batches):
        enc = shared.encoder()
        for b in batches:
            out = [enc.decode(ids.as_py() or []) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def bpe_report(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes are hashed block by block, in the task that made them."""
    shared = Shared(docs.sparkSession, rank_path, pattern)

    def run(batches):
        enc = shared.encoder()
        decimal = enc.decimal.__getitem__
        for b in batches:
            n, ids_hex, bytes_hex = [], [], []
            for text in b.column(1):
                count, a, d = 0, hashlib.sha256(), hashlib.sha256()
                for ids in enc.blocks(text.as_py() or ""):
                    a.update(((" " if count else "") + " ".join(map(decimal, ids))).encode())
                    d.update(enc.decode(ids))
                    count += len(ids)
                n.append(count)
                ids_hex.append(a.hexdigest())
                bytes_hex.append(d.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(bytes_hex)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
