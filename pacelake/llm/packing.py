"""Lexical retrieval packing: documents fill windows together with their nearest neighbours by BM25.

Every document becomes token ids and one closing id. Whole windows of a long document stand alone. What
is left of each document (less than a window) goes to a shard: pieces are ordered by a two-fold min-hash
of their ids, so like meets like, and cut into runs of SHARD_PIECES. A shard has an inverted index from
ids to pieces with BM25 weights; document frequencies come from all documents. The first unused piece is
the seed; the index returns the unused pieces by falling score, and they fill the window greedily. A
piece that does not fit is cut, and its rest stays unused. A last window that is not full goes on to the
next shard, so each partition has at most one padded window.

Terms are token ids, so the document frequencies that are sent to the tasks have a proven bound: the
vocabulary. A shard is bounded by SHARD_PIECES, whatever the copies; the order's last key is the
document, so a group of copies is cut like any other run.

Defined results: a null or empty text has the closing id alone; a null doc_id is kept as null; repeated
rows are packed each; ties in score go to the piece that comes first in the shard; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, slices, small_batches
from .word_merges import LONGEST, WordMerges
from .words import split_words

WINDOW = 2048
CLOSING_ID = 1
SHARD_PIECES = 512
#: A shard of very short pieces grows until it fills so many windows.
SHARD_WINDOWS = 8
#: Words that a worker remembers, some 150 bytes each, and the letters of the longest of them.
REMEMBERED, REMEMBERED_LETTERS = 60_000, 100
#: Words that are encoded in one call, with a bar between them; a word with a bar in it is encoded alone.
TOGETHER, BAR = 1_000, "|"
#: Calls that are made at once; their results take some 100 bytes a token.
CALLS = 8
#: Bytes of text that are encoded at once: the more text, the rarer a new word, and the more memory for what is made of them.
SLICE = 1 << 20
K1, B = 1.2, 0.75

_tokenizers: dict[str, WordTokenizer] = {}


def plain_letters(limit: int = 0x530) -> str:
    """Small letters (Latin, Greek, Cyrillic) that stay as they are in NFC and lower case, alone or side by side."""
    letters = (chr(c) for c in range(limit))
    return "".join(x for x in letters if unicodedata.category(x) == "Ll" and unicodedata.is_normalized("NFC", x) and x.lower() == x)


def suffixes(words: pa.Array, cut: np.ndarray) -> pa.Array:
    """What follows the first cut bytes of each large string."""
    at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(at) - cut
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(size) else 0
    place = np.repeat(at[:-1] + cut - ends + size, size) + np.arange(total)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[place] if total else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordTokenizer:
    """Ids of texts under a tokenizer that never joins across white space: each distinct word of a slice is encoded once.

    A word of plain small letters is one pre-token that no normaliser changes, so it only needs the model's merges, which
    are done for all such words together; every other word goes through the whole tokenizer and is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}
        bar = self.tokenizer.encode(BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        # the tokenizer finds added tokens in the raw text; whatever could be one in some case is left as it is
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added), re.I) if added else None
        letters = plain_letters()
        self.plain = rf"\A[{letters}]+\z"
        # the short way is taken only if it gives what the whole tokenizer gives for words of every plain letter
        probe = [letters[i : i + 3] for i in range(len(letters))] + ["the", "and", "tion"]
        try:
            self.merges = WordMerges(json.loads(self.tokenizer.to_str())["model"])
            ids, at, n = self.merges.encode(pa.array(probe, pa.large_string()))
            if [ids[a : a + k].tolist() for a, k in zip(at, n)] != [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]:
                self.merges = None
        except ValueError:
            self.merges = None

    def merged(self, words: pa.Array) -> np.ndarray:
        """Whether the merges alone give the ids of a word."""
        if self.merges is None:
            return np.zeros(len(words), dtype=bool)
        fits = pc.less_equal(pc.binary_length(words), LONGEST)
        return pc.and_(pc.match_substring_regex(words, self.plain), fits).to_numpy(zero_copy_only=False)

    def holds_added(self, words: pa.Array) -> pa.Array:
        """Whether a word holds the content of an added token, in any case."""
        if self.added is None:
            return pa.array([False] * len(words), pa.bool_())
        return pc.match_substring_regex(words, self.added.pattern, ignore_case=True)

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        out: dict[str, bytes] = {}
        special = self.added.search if self.added else lambda w: None
        alone = [w for w in words if BAR in w or special(w)] if self.bar is not None else words
        out |= {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False))}
        many = [w for w in words if w not in out]
        runs = [many[i : i + TOGETHER] for i in range(0, len(many), TOGETHER)]
        encoded = (e for k in range(0, len(runs), CALLS) for e in self.tokenizer.encode_batch_fast([f" {BAR} ".join(r) for r in runs[k : k + CALLS]], add_special_tokens=False))
        for run, e in zip(runs, encoded):
            ids = np.array(e.ids, dtype="<u4")
            bars = np.flatnonzero(ids == self.bar)
            data, begin = ids.tobytes(), 0
            for w, end in zip(run, [*bars.tolist(), len(ids)], strict=True):
                out[w] = data[4 * begin : 4 * end]
                begin = end + 1
        return out

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def remembered(self, words: list[str]) -> list[bytes]:
        """Ids of words, from memory where they are known; long words are not kept."""
        out = list(map(self.known.get, words))
        new = self.words(list(dict.fromkeys(w for w, ids in zip(words, out) if ids is None)))
        if new:
            out = [new[w] if ids is None else ids for w, ids in zip(words, out)]
            if len(self.known) + len(new) > REMEMBERED:  # the older half goes
                self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
            long = [w for w in new if len(w) > REMEMBERED_LETTERS]
            for w in long:
                del new[w]
            self.known.update(islice(new.items(), max(0, REMEMBERED - len(self.known))))
        return out

    def forget(self) -> None:
        """Give the memory of known words back; the worker may go on to other work."""
        self.known = {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and where each text's ids start, with one more at the end; every text has the closing id."""
        words = split_words(texts)
        # the tokenizer lowers all letters and cuts between a letter or digit and marks; doing so here
        # for ASCII makes fewer words: each is a bare word and the marks at its end
        lower = pc.ascii_lower(words.distinct)
        bare = pc.ascii_rtrim(lower, characters=string.punctuation)
        # a word with an added token in it is encoded whole, as it stands; so is one that does not end like a word before its marks
        whole = self.holds_added(words.distinct)
        lower = pc.if_else(whole, words.distinct, lower)
        bare = pc.if_else(pc.and_not(pc.match_substring_regex(bare, r"[a-z0-9]\z"), whole), bare, lower)
        marks = suffixes(lower, pc.binary_length(bare).to_numpy(zero_copy_only=False)).dictionary_encode()
        bare = bare.dictionary_encode()
        parts = pa.concat_arrays([bare.dictionary, marks.dictionary])
        short = self.merged(parts)
        other = self.remembered(strings(parts.filter(pa.array(~short))))
        starts, sizes = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        sizes[~short] = np.fromiter(map(len, other), dtype=np.int64, count=len(other)) // 4
        starts[~short] = np.cumsum(sizes[~short]) - sizes[~short]
        blob = np.frombuffer(b"".join(other), dtype="<u4")
        if short.any():
            ids, at, sizes[short] = self.merges.encode(parts.filter(pa.array(short)))
            starts[short] = at + len(blob)
            blob = np.r_[blob, ids]
        # the ids of each distinct word: of its two parts; one more word is the end of a text
        of_word = np.c_[bare.indices.to_numpy(zero_copy_only=False), marks.indices.to_numpy(zero_copy_only=False) + len(bare.dictionary)]
        blob, ends = _spread(blob, sizes, starts, of_word.reshape(-1))
        blob, size = np.r_[blob, np.uint32(CLOSING_ID)], np.r_[np.diff(np.r_[0, ends[1::2]]), 1]
        docs = len(words.bounds) - 1
        code = np.insert(words.code, words.bounds[1:], len(of_word))
        ids, ends = _spread(blob, size, np.cumsum(size) - size, code)
        return ids, np.r_[0, ends][words.bounds + np.arange(docs + 1)]


def _spread(values: np.ndarray, sizes: np.ndarray, starts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each coded run, one after the other, and where each run ends."""
    each = sizes[code]
    ends = np.cumsum(each)
    at = np.repeat(starts[code] - ends + each, each)
    at += np.arange(len(at))
    return values[at], ends


def distinct_ids(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each id once; last (a place for every id) is overwritten."""
    at = np.arange(len(ids))
    last[ids] = at
    return ids[last[ids] == at]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENS = f"kind int, {PIECE}, sketch long, ids binary"


def _tokenize(rows: DataFrame, tokenizer_path: str, window: int, with_ids: bool) -> DataFrame:
    """kind 0: rests; kind 1: whole windows; kind 2: one row a partition with document frequencies (ids) and counts (start, length)."""

    def run(batches):
        tok = WordTokenizer.of(tokenizer_path)
        part, windows = TaskContext.get().partitionId(), 0
        df, last = np.zeros(tok.size, dtype=np.int64), np.zeros(tok.size, dtype=np.int64)
        order = [mix64(np.arange(tok.size, dtype=np.uint64) + np.uint64(s << 32)) >> np.uint64(40) for s in (1, 2)]
        docs = rest_tokens = 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                ids, at = tok.encode(piece.column(1))
                sizes = np.diff(at)
                rest = sizes % window
                lists = {k: [] for k in ("kind", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sketch", "ids")}

                def put(*values):
                    for k, v in zip(lists, values):
                        lists[k].append(v)

                low = [np.minimum.reduceat(o[ids], at[:-1]) for o in order] if len(sizes) else []
                for i, key in enumerate(piece.column(0).to_pylist()):
                    own = ids[at[i] : at[i + 1]]
                    df[distinct_ids(own, last)] += 1
                    for s in range(0, len(own) - window + 1, window):
                        data = own[s : s + window].tobytes()
                        put(1, key, s, window, zlib.crc32(data), len(own), (part << 40 | windows) * 2 + 1, 0, 0, data if with_ids else None)
                        windows += 1
                    if rest[i]:
                        tail = own[len(own) - rest[i] :]
                        put(0, key, len(own) - int(rest[i]), int(rest[i]), None, len(own), None, None, int(low[0][i]) << 24 | int(low[1][i]), tail.astype("<u2" if tok.size <= 65536 else "<u4").tobytes())
                        rest_tokens += int(rest[i])
                docs += len(sizes)
                yield _batch(lists)
        tok.forget()
        yield _batch({"kind": [2], "doc_id": [None], "start": [docs], "length": [rest_tokens], "ids_crc32": [None], "doc_tokens": [None], "sequence_id": [None], "offset": [None], "sketch": [None], "ids": [df.astype("<i8").tobytes()]})

    return rows.mapInArrow(run, _TOKENS)


_TYPES = {"kind": pa.int32(), "ids": pa.binary()}


def _batch(lists: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _TYPES.get(k, pa.int64())) for k, v in lists.items()], list(lists))


def _frequencies(tokens: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, mean length of a rest, and the document frequency of each id (as long as the vocabulary)."""

    def counts(batches):
        for b in batches:
            for data in b.column(0):
                df = np.frombuffer(data.as_py(), dtype="<i8")
                at = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], ["term", "n"])

    stats = tokens.where("kind = 2")
    total = stats.agg(F.sum("start"), F.sum("length")).first()
    docs, length = int(total[0] or 0), int(total[1] or 0)
    rests = tokens.where("kind = 0").count()
    found = stats.select("ids").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(int(found["term"].max()) + 1 if len(found) else 1, dtype=np.int64)
    df[found["term"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return docs, length / max(1, rests), df


class Shard:
    """Inverted index of some pieces: postings by term, with BM25 weights."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        term = np.concatenate(pieces).astype(np.int64) if n else np.empty(0, np.int64)
        pair, tf = np.unique(term * n + np.repeat(np.arange(n), sizes), return_counts=True)
        term, self.doc = pair // max(1, n), pair % max(1, n)
        norm = K1 * (1 - B + B * sizes / max(1.0, mean_length))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        self.begin, self.size = first, np.diff(np.r_[first, len(term)])
        place = np.full(int(term[-1]) + 1 if len(term) else 1, -1, dtype=np.int64)
        place[term[first]] = np.arange(len(first))
        by_doc = np.argsort(self.doc, kind="stable")
        self.lists = place[term[by_doc]]
        self.of_doc = np.searchsorted(self.doc[by_doc], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for the terms of the seed."""
        lists = self.lists[self.of_doc[seed] : self.of_doc[seed + 1]]
        size = self.size[lists]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[lists] - ends + size, size) + np.arange(int(ends[-1]))
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill_windows(shard: Shard, lengths: list[int], window: int):
    """Windows as lists of (piece, from, to) within the piece, each full but perhaps the last."""
    begin, left = [0] * len(lengths), list(lengths)
    unused = np.ones(len(lengths), dtype=bool)
    total = sum(lengths)
    seed = 0
    while total:
        while not unused[seed]:
            seed += 1
        space, out, follow = window, [], None
        at = seed
        while True:
            take = min(space, left[at])
            out.append((at, begin[at], begin[at] + take))
            begin[at] += take
            left[at] -= take
            space -= take
            total -= take
            unused[at] = left[at] > 0
            if not space or not total:
                break
            if follow is None:
                score = shard.scores(seed)
                open_ = np.flatnonzero(unused)
                follow = iter(open_[np.argsort(-score[open_], kind="stable")].tolist())
            at = next(follow)
        yield out, space


def _pack(rests: DataFrame, idf, mean_length: float, window: int, wide: bool, with_ids: bool) -> DataFrame:
    def run(batches):
        part, made, tokens_held = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []  # doc_id, start, doc_tokens, ids

        def flush(last: bool):
            nonlocal held, made
            lists = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            kept = []
            for members, space in fill_windows(Shard([h[3] for h in held], idf.value, mean_length), [len(h[3]) for h in held], window):
                if space and not last:
                    kept = [(held[i][0], held[i][1] + a, held[i][2], held[i][3][a:b]) for i, a, b in members]
                    break
                offset = 0
                for i, a, b in members:
                    data = held[i][3][a:b].astype("<u4").tobytes()
                    for k, v in zip(lists, (held[i][0], held[i][1] + a, b - a, zlib.crc32(data), held[i][2], (part << 40 | made) * 2, offset, data if with_ids else None)):
                        lists[k].append(v)
                    offset += b - a
                made += 1
            held = kept
            return _batch(lists)

        for b in batches:
            for key, start, tokens, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                held.append((key, start, tokens, np.frombuffer(ids, dtype="<u4" if wide else "<u2")))
                tokens_held += len(held[-1][3])
                if len(held) >= SHARD_PIECES and tokens_held >= SHARD_WINDOWS * window:
                    yield flush(False)
                    tokens_held = sum(len(h[3]) for h in held)
        if held:
            yield flush(True)

    ordered = rests.repartitionByRange("sketch", "doc_id", "start").sortWithinPartitions("sketch", "doc_id", "start")
    return ordered.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, f"{PIECE}, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (little-endian 32-bit) if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = scratch.save(_tokenize(rows, tokenizer_path, window, with_ids), "tokens")
    n, mean_length, df = _frequencies(tokens)
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))  # as long as the vocabulary
    wide = WordTokenizer.of(tokenizer_path).size > 65536
    packed = _pack(tokens.where("kind = 0"), idf, mean_length, window, wide, with_ids)
    columns = [c.split()[0] for c in PIECE.split(", ")] + (["ids"] if with_ids else [])
    return packed.select(*columns).unionByName(tokens.where("kind = 1").select(*columns))
