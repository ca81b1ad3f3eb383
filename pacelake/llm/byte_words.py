"""Ids of texts under a byte-level tokenizer, a distinct word at a time.

The tokenizer's pattern takes a white-space character with what follows it or, where that is no space, ends a
match behind it; it never looks back. So a text may be cut before the last white-space character of each run
that something follows (in a run of two, before both), and between a letter or digit and the marks after it, and each cut gives its own
ids. Arrow cuts and numbers the words of a slice of texts; each distinct one is encoded once and remembered.
"""

from __future__ import annotations

import os
import re
import string
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .word_merges import byte_letters

#: Words that a worker remembers, some 150 bytes each, and the letters of the longest of them.
REMEMBERED, REMEMBERED_LETTERS = 400_000, 100
#: Words that are encoded as one text, with the tokenizer's own special token between them, and such texts that are encoded at once.
TOGETHER, CALLS = 1_000, 8
#: White space of the pattern, as the inside of a class.
WHITE = "\t-\r \x85\xa0  -     　"
#: A mark that is no character of any text; texts that hold it all the same are cut in Python.
CUT = "﷐"
_before_word = re.compile(f"(?=[{WHITE}][^{WHITE}])")
#: Letters and digits after which marks are cut off: ASCII, and Latin letters up to U+024F.
ENDS_WORD = "[A-Za-z0-9À-ÖØ-öø-ɏ]$"
#: A word that the pattern takes whole.
PLAIN = re.compile("[ A-Za-zÀ-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ]+")


class ByteWords:
    """The tokenizer of a file; ids of many texts at once."""

    _made: dict[str, ByteWords] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content and not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
        if len(added) != len(self.tokenizer.get_added_tokens_decoder()) or not added:
            raise ValueError(f"{path}: a byte-level tokenizer with plain added tokens is needed")
        self.added = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")
        self.special = list(added)
        self.bar, self.bar_id = next(iter(added.items()))
        self.known: dict[str, bytes] = {}
        letters = byte_letters()
        self.shown = {ord(x): "".join(letters[b] for b in x.encode()) for x in map(chr, [0x20, *range(0x41, 0x250)])}

    @classmethod
    def of(cls, path: str) -> ByteWords:
        if path not in cls._made:
            cls._made.clear()
            cls._made[path] = cls(path)
        return cls._made[path]

    def cut(self, text: str) -> list[str]:
        """Words of one text; added tokens are words of their own, and what is around them is cut by itself."""
        return [w for part in self.added.split(text) for w in ([part] if self.added.fullmatch(part) else _before_word.split(part)) if w]

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words in order, and where each text's begin, with one more at the end."""
        odd = pc.match_substring(texts, CUT)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        # where no white space but spaces and line ends two at most stand together, each of them may begin a word
        long = pc.match_substring_regex(texts, f"[{WHITE}]{{3}}|[{WHITE}]{{2}}\\z")
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(pc.or_(odd, long), "", texts), " ", f"{CUT} "), "\n", f"{CUT}\n")
        if pc.any(long).as_py():
            general = pc.replace_substring_regex(pc.if_else(pc.and_not(long, odd), texts, ""), f"([{WHITE}][^{WHITE}])", f"{CUT}\\1")
            marked = pc.if_else(long, general, marked)
        lists = pc.split_pattern(marked, CUT)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, at = lists.values.slice(int(at[0]), int(at[-1] - at[0])), at - at[0]
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(places):  # each of these has one empty word so far
            parts, sizes, last = [], np.diff(at), 0
            for k in places.tolist():
                own = self.cut(texts[k].as_py())
                parts += [flat.slice(last, int(at[k]) - last), pa.array(own, flat.type)]
                last, sizes[k] = int(at[k + 1]), len(own)
            flat, at = pa.concat_arrays([*parts, flat.slice(last)]), np.r_[0, np.cumsum(sizes)]
        return flat, at

    def encode_new(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        out: dict[str, bytes] = {}
        plain, special, tokenize, shown = PLAIN.fullmatch, self.added.fullmatch, self.tokenizer.model.tokenize, self.shown
        space = shown[0x20]
        rest: list[str] = []
        for w in words:
            if plain(w):
                ids = [t.id for t in tokenize((space + w[1:] if w[0] == " " else w) if w.isascii() else w.translate(shown))]
                out[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(w)
        alone = [w for w in rest if special(w)]
        out |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False))}
        many = [w for w in rest if w not in out]
        runs = [many[i : i + TOGETHER] for i in range(0, len(many), TOGETHER)]
        for k in range(0, len(runs), CALLS):
            for run, e in zip(runs[k : k + CALLS], self.tokenizer.encode_batch_fast([self.bar.join(r) for r in runs[k : k + CALLS]], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                data, begin = ids.tobytes(), 0
                for w, end in zip(run, [*np.flatnonzero(ids == self.bar_id).tolist(), len(ids)], strict=True):
                    out[w] = data[4 * begin : 4 * end]
                    begin = end + 1
        return out

    def remembered(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        new = self.encode_new(list(dict.fromkeys(w for w, ids in zip(words, out) if ids is None)))
        if new:
            out = [new[w] if ids is None else ids for w, ids in zip(words, out)]
            if len(self.known) + len(new) > REMEMBERED:  # the older half goes
                self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
            short = ((w, ids) for w, ids in new.items() if len(w) <= REMEMBERED_LETTERS)
            self.known.update(islice(short, max(0, REMEMBERED - len(self.known))))
        return out

    def encode(self, texts: pa.Array, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), each text's with closing at their end, and where each text's begin, with one more at the end. A null text has closing alone."""
        flat, at = self.words(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        bare = pc.utf8_rtrim(distinct, characters=string.punctuation)
        whole = pc.is_in(distinct, value_set=pa.array(self.special, distinct.type))
        bare = pc.if_else(pc.and_not(pc.match_substring_regex(bare, ENDS_WORD), whole), bare, distinct)
        first, rest = bare.dictionary_encode(), _behind(distinct, bare).dictionary_encode()
        both = self.remembered(_strings(first.dictionary) + _strings(rest.dictionary))
        size = np.fromiter(map(len, both), np.int64, len(both)) // 4
        blob = np.frombuffer(b"".join([*both, np.uint32(closing).tobytes()]), "<u4")
        start = np.cumsum(size) - size
        # ids of each distinct word: of its two parts; one word more is the end of a text
        parts = np.c_[first.indices.to_numpy(zero_copy_only=False), rest.indices.to_numpy(zero_copy_only=False) + len(first.dictionary)].reshape(-1)
        ids, ends = spread(blob, start[parts], size[parts])
        ends = np.r_[0, ends[1::2]] if len(parts) else np.zeros(1, np.int64)
        ids = np.r_[ids, np.uint32(closing)]
        begin, length = ends, np.r_[np.diff(ends), 1]
        code = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at[1:], len(distinct))
        out, ends = spread(ids, begin[code], length[code])
        return out, np.r_[0, ends][at + np.arange(len(at))]

    def forget(self) -> None:
        """Give the memory of known words back; the worker may go on to other work."""
        self.known = {}
        pa.default_memory_pool().release_unused()


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _behind(words: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows each head in its word."""
    cut = pc.binary_length(heads).to_numpy(zero_copy_only=False)
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.empty(0, np.uint8)
    tail, ends = spread(data, at[:-1] + cut, np.diff(at) - cut)
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(tail))])


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that begin at starts and have sizes, one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64  # half the memory
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at], ends
