"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; where its upper bits are all zero a chunk ends, at the next
start of a character. The hash of a place depends on the 16 bytes before it, so an insertion moves only
the cuts around it. Chunks of every document are counted by digest over the whole corpus; neighbouring
chunks that occur again form a passage, and a passage of at least MIN_WORDS words that another document
has too is reported for every document that has it; WORD_CHARS code points count as a word as well, for
text without spaces. Each chunk belongs to its first occurrence (smallest document, then place), and a
passage is reported in parts, cut where the owning document or the first occurrence changes. First
occurrences stay when texts are cut, so one occurrence of every chunk does.

A chunk has 32 bytes on average, so a passage of 50 words holds several whole chunks wherever it stands.
Only digests and places are shuffled. Counts are summed before the shuffle and written; rows meet
them in a join between two plain shuffles, whose skewed keys Spark can split.

Defined results: a null or empty text has no chunks; whole texts are read, whatever their length;
rows that repeat an id, and rows without one, are documents of their own (they come after the rows whose id
is theirs alone); ties go to the smallest doc_id; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_row, dealt, mix64, slices, with_row_key

#: Bits 11 to 15 of the hash: a cut every 32 places, on 16 bytes.
CUT = np.uint32(0b11111 << 11)
SHORTEST, LONGEST = 8, 256
MIN_WORDS = 14
WORD_CHARS = 10

_GEAR = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, of the 16 bytes up to it, by doubling the window four times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    return h


def cuts(data: np.ndarray, h: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; at least SHORTEST bytes apart, at most about LONGEST."""
    n, last, out = len(data), 0, []
    for p in [*(np.flatnonzero((h & CUT) == 0) + 1).tolist(), n]:
        while p - last > LONGEST:
            q = last + LONGEST
            while q < n and data[q] & 0xC0 == 0x80:
                q += 1
            if q >= p:
                break
            out.append(q)
            last = q
        while p < n and data[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= SHORTEST or (p == n and p > last):
            out.append(p)
            last = p
    return out


_CHUNKS = "doc_id long, digests array<long>, chars array<int>, words array<int>, again array<int>"


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, and for its chunks in order: digest, code points, words that start there; again: places of chunks that stand before in the document."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                lists: list[list] = [[], [], [], []]
                for text in piece.column(1):
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    data = np.frombuffer(raw, dtype=np.uint8)
                    ends = cuts(data, gear(data)) if len(data) else []
                    starts = [0, *ends[:-1]] if ends else []
                    space = (data == 32) | ((data >= 9) & (data <= 13))
                    first = ~space
                    first[1:] &= space[:-1]
                    digests = [xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(starts, ends)]
                    seen: set[int] = set()
                    lists[0].append(digests)
                    lists[3].append([i for i, d in enumerate(digests) if d in seen or seen.add(d)])
                    lists[1].append(np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int32) if ends else [])
                    lists[2].append(np.add.reduceat(first, starts, dtype=np.int32) if ends else [])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int32())), pa.array(lists[2], pa.list_(pa.int32())), pa.array(lists[3], pa.list_(pa.int32()))], ["doc_id", "digests", "chars", "words", "again"])

    return docs.mapInArrow(run, _CHUNKS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each part of a repeated passage of each document: doc_id, start, stop (code points), n_words, n_rows, first_doc_id, first.

    n_rows: how often its most common chunk is in the corpus; first_doc_id: the smallest document that has its chunks, each of them;
    first: whether these are the chunks' first occurrences. A part may be shorter than min_words, the passage is not."""
    scratch = Scratch(docs.sparkSession, "substrings")
    return by_row(docs, id_col, text_col, lambda rows: _repeats(rows, min_words, scratch), ("doc_id", "first_doc_id"), scratch)


def _repeats(texts: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """As repeats, of a table whose doc_id is a key."""
    table = scratch.save(chunks(texts), "chunks")
    each = table.select("doc_id", F.posexplode("digests").alias("at", "digest"))
    # smallest and largest document say whether two have it; both are summed up before the shuffle
    common = each.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("n_rows")).where("first_doc_id < last").drop("last")
    common = dealt(scratch.save(common, "common"))
    found = each.join(common, "digest").select("doc_id", "at", "first_doc_id", "n_rows")

    # back to their documents: repeated places in order, then runs of neighbours
    marked = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "first_doc_id", "n_rows"))).alias("hits"))

    schema = "doc_id long, start long, stop long, n_words long, n_rows long, first_doc_id long, first boolean"

    def runs(frames):
        for pdf in frames:
            out = []
            for key, hits, chars, words, again in zip(pdf["doc_id"], pdf["hits"], pdf["chars"], pdf["words"], pdf["again"]):
                at = np.array([h["at"] for h in hits])
                stop = np.cumsum(chars)
                owner = np.array([h["first_doc_id"] for h in hits])
                first = (owner == key) & ~np.isin(at, again)
                new = (np.diff(owner) != 0) | np.diff(first)
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    a, b = at[run[0]], at[run[-1]]
                    if b >= len(words) or max(int(np.sum(words[a : b + 1])), int(stop[b] - stop[a] + chars[a]) // WORD_CHARS) < min_words:
                        continue
                    for part in np.split(run, np.flatnonzero(new[run[:-1]]) + 1):
                        a, b = at[part[0]], at[part[-1]]
                        out.append((key, int(stop[a] - chars[a]), int(stop[b]), int(np.sum(words[a : b + 1])), max(hits[i]["n_rows"] for i in part), int(owner[part[0]]), bool(first[part[0]])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return marked.join(table.select("doc_id", "chars", "words", "again"), "doc_id").mapInPandas(runs, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The table with repeated passages cut out wherever they are not the first occurrence. No row goes."""
    scratch = Scratch(docs.sparkSession, "substrings")
    keyed, key = with_row_key(docs, scratch, id_col)
    found = _repeats(keyed.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")), min_words, scratch)
    gone = found.where(~F.col("first")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gone_"))
    rows = keyed.select(F.struct(*docs.columns).alias("original"), F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(gone, "doc_id", "left")
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, g: F.struct(g["stop"].alias("at"), F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (g["start"] - s["at"]).cast("int"))).alias("out"))
    left = F.aggregate("gone_", start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    cut = F.when(F.col("gone_").isNotNull(), left).otherwise(text)
    return joined.select(F.col("original").withField(f"`{text_col}`", cut).alias("original")).select("original.*")
