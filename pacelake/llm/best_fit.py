"""Best-fit packing: whole documents go into sequences of a fixed number of tokens, each where it leaves the least space.

Rounds go from long documents to short ones, a band of lengths at a time. In a round, the band's documents and the gaps of
the sequences begun so far are range-sorted together, longest first (a gap before a document of its size), and each task sweeps its
range: the successor of a document is the last gap before it, which is the smallest that takes it. Where several documents
have the same successor, their rank decides: the first in order gets it, the next one the gap before. What a task's range leaves
over, documents without a gap and gaps without a document, is ranked; from the counts of each task the driver
finds which ranks of one task meet which ranks of another, and a join on these gives the pairs. Then the gaps are
updated, and the round repeats with the documents left until no gap takes any of them. These begin new sequences: as many
side by side as always fit, or, where they are short, by the running sum of their lengths.

A gap that holds several documents of the band offers a slot for each, so that rounds do not grow in number with the documents of a
sequence. One length may be that of any share of all documents: the sort's last key is a hash, and a range is a run of rows.

Defined results: a null or empty text has the closing id alone; a null id is kept as null; repeated rows are packed
each; a text longer than a sequence is cut into whole sequences but for its first piece; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import ByteWords
from .common import Scratch, dealt, slices, small_batches

WINDOW = 2048
CLOSING_ID = 0
#: Documents above a window's EVEN-th part begin sequences by number, shorter ones by the sum of their lengths.
EVEN = 8
#: Bytes of text that are encoded at once: the more, the rarer a new word.
SLICE = 8 << 20
#: Another round follows one that has placed at least one in WORTH of its documents; else the rest begin new sequences, and the gaps wait for shorter ones.
WORTH = 32
#: Rows of a file of what a round leaves (some 40 bytes each): rounds are many, and their tables often small.
FILE_ROWS = 250_000
#: Least number of tasks of a round's sweep; each goes through several ranges where these are small.
TASKS = 8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, key long, ids binary"
_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
_OWN = ["doc_id", "piece", "start", "length", "ids_crc32", "key"]


def _pieces(rows: DataFrame, tokenizer_path: str, window: int, with_ids: bool) -> DataFrame:
    """A row for each piece. Whole windows have a sequence of their own (odd numbers); the others have none yet."""
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches):
        words = ByteWords.of(tokenizer_path)
        base, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = words.encode(part.column(1), CLOSING_ID)
                out = []
                for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    cuts = [a, *range(b - (b - a - 1) // window * window, b + 1, window)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        data = ids[x:y].tobytes()
                        out.append((doc, k, x - a, y - x, zlib.crc32(data), (base | n) * 2 + 1 if y - x == window else None, base | n, data if with_ids else None))
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), _KINDS)], names)

    return rows.mapInArrow(run, _PIECES)


def bands(window: int) -> list[tuple[int, int]]:
    """Ranges of lengths (above the first, up to the second), longest first: one, two and three of them in a window, then down by factors."""
    tops = [window, window // 2, window // 3, window // 4, window // EVEN, window // (3 * EVEN), 0]
    return [(low, top) for top, low in zip(tops, tops[1:]) if low < top]


def pair_up(size: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents and of the gaps they get, among rows in falling order of size (a gap first): a document gets the last gap before it that no other document between them gets."""
    depth = np.cumsum(np.where(is_gap, 1, -1))
    floor = np.minimum.accumulate(np.minimum(depth, 0))
    alone = ~is_gap & (floor < np.r_[0, floor[:-1]])  # no gap is left before these
    level = depth - floor + np.where(is_gap, 0, 1)
    rest = np.flatnonzero(~alone)
    rest = rest[np.argsort(level[rest], kind="stable")]
    # of one level, gaps and documents take turns
    meets = is_gap[rest[:-1]] & ~is_gap[rest[1:]] & (level[rest[:-1]] == level[rest[1:]]) if len(rest) else np.empty(0, bool)
    return rest[1:][meets], rest[:-1][meets]


_SWEPT = "kind int, doc_id long, piece int, start long, length long, ids_crc32 long, key long, seq long, part int, rank long, before long"
PAIR, DOCUMENT, GAP = 0, 1, 2


def _sweep(rows: DataFrame) -> DataFrame:
    """Pairs within each range (part, sorted), and what is left there: documents and gaps with their rank, documents with the lengths before them."""
    names = [x.split()[0] for x in _SWEPT.split(", ")]

    def run(batches):
        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        size, is_gap = table.column("size").to_numpy(), table.column("gap").to_numpy(zero_copy_only=False)
        docs, gaps = pair_up(size, is_gap)
        kind = np.where(is_gap, GAP, DOCUMENT)
        kind[docs], kind[gaps] = PAIR, -1
        seq = table.column("seq").fill_null(-1).to_numpy().copy()
        seq[docs] = seq[gaps]
        rank = np.where(kind == GAP, np.cumsum(kind == GAP), np.cumsum(kind == DOCUMENT)) - 1
        left = np.where(kind == DOCUMENT, size, 0)
        kept = pa.array(np.flatnonzero(kind >= 0))
        made = {"kind": kind.astype(np.int32), "seq": seq, "rank": rank, "before": np.cumsum(left) - left}
        out = pa.table([made[c] if c in made else table.column(c) for c in names], names).take(kept)
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return rows.mapInArrow(run, _SWEPT)


def _meet(parts: list) -> tuple[list[tuple], dict[int, int]]:
    """Which left documents of a task meet which left gaps of an earlier one: (part, first rank, ranks, part of the gaps, rank of the first's gap), the gaps' ranks falling. And for each task how many of its documents got one."""
    free: list[list[int]] = []
    found, got = [], {}
    for p in parts:
        rank = 0
        while free and rank < p["docs"]:
            part, n = free[-1]
            take = min(n, p["docs"] - rank)
            found.append((p["part"], rank, take, part, n - 1))
            rank += take
            free[-1][1] -= take
            if not free[-1][1]:
                free.pop()
        got[p["part"]] = rank
        if p["gaps"]:
            free.append([p["part"], p["gaps"]])
    return found, got


class Packing:
    """The state of the rounds: gaps of the sequences begun (seq, free), and pieces placed so far, by round."""

    def __init__(self, spark, window: int, scratch: Scratch):
        self.spark, self.window, self.scratch = spark, window, scratch
        self.gaps: DataFrame | None = None
        self.largest = 0
        self.begun = 0
        self.placed: list[DataFrame] = []
        self.rounds = 0

    def place(self, pieces: DataFrame, rows: int) -> None:
        """Note where pieces (with seq, so many rows) went, and update the gaps."""
        pieces = pieces.select(*_OWN, "seq", F.lit(len(self.placed)).alias("round"))
        pieces = self.scratch.save(pieces.coalesce(-(-rows // FILE_ROWS) or 1), "placed")
        self.placed.append(pieces)
        used = pieces.groupBy("seq").agg(F.sum("length").alias("used"))
        if self.gaps is None:
            gaps = used.select("seq", (self.window - F.col("used")).alias("free"))
        else:
            gaps = self.gaps.join(used, "seq", "full_outer").select("seq", (F.coalesce("free", F.lit(self.window)) - F.coalesce("used", F.lit(0))).alias("free"))
        self.gaps = self.scratch.save(gaps.where("free > 0").coalesce(-(-self.begun // FILE_ROWS) or 1), "gaps")
        self.scratch.drop("gaps", last=1)
        self.largest = self.gaps.agg(F.max("free").alias("m")).first()["m"] or 0

    def slots(self, low: int, top: int) -> DataFrame:
        """The gaps that take a document of a band, each with a slot for every top tokens; the last one has the rest."""
        n = F.greatest(F.lit(1), F.expr(f"free div {top}"))
        slot = self.gaps.where(F.col("free") > low).select("seq", "free", n.alias("n"), F.posexplode(F.sequence(F.lit(1), n.cast("int"))).alias("i", "_"))
        size = F.when(F.col("i") == F.col("n") - 1, F.col("free") - (F.col("n") - 1) * top).otherwise(F.lit(top))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("piece", "int"), ("start", "long"), ("ids_crc32", "long"), ("key", "long"))]
        return slot.select(size.cast("long").alias("size"), F.lit(True).alias("gap"), "seq", F.xxhash64("seq", "i").alias("tie"), *none, F.lit(None).cast("long").alias("length"))

    def match(self, docs: DataFrame, n: int, low: int, top: int) -> tuple[DataFrame | None, DataFrame, dict]:
        """One round of some n documents: the pieces that got a gap (with seq; None if none did), those that did not (with the columns of _SWEPT), and the counts of the latter."""
        self.rounds += 1
        rows = docs.select(F.col("length").alias("size"), F.lit(False).alias("gap"), F.lit(None).cast("long").alias("seq"), F.xxhash64("key").alias("tie"), *_OWN)
        if self.gaps is not None and self.largest > low:
            rows = rows.unionByName(self.slots(low, top))
        order = [F.col("size").desc(), F.col("gap").desc(), "tie"]
        # part is the number of the range, also where a task has several
        ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        swept = self.scratch.save(_sweep(ranges).coalesce(max(TASKS, -(-(n + self.begun) // FILE_ROWS))), "swept")
        self.scratch.drop("swept", last=2)  # the round before may still be read
        of = lambda k: F.count_if(F.col("kind") == k)
        parts = swept.groupBy("part").agg(of(PAIR).alias("pairs"), of(DOCUMENT).alias("docs"), of(GAP).alias("gaps"), F.sum(F.when(F.col("kind") == DOCUMENT, F.col("length"))).alias("tokens"), F.min(F.when(F.col("kind") == DOCUMENT, F.col("length"))).alias("least")).collect()
        parts.sort(key=lambda p: p["part"])
        met, got = _meet(parts)
        pairs = swept.where(F.col("kind") == PAIR).select(*_OWN, "seq") if any(p["pairs"] for p in parts) else None
        left = swept.where(F.col("kind") == DOCUMENT)
        if met:
            # at most two rows a task
            table = F.broadcast(self.spark.createDataFrame(met, "part int, first long, n long, gap_part int, gap_rank long"))
            ranked = left.join(table, (left["part"] == table["part"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
            ranked = ranked.select(*_OWN, "gap_part", (F.col("gap_rank") - F.col("rank") + F.col("first")).alias("gap_rank"))
            own = swept.where(F.col("kind") == GAP).select(F.col("seq"), F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"))
            across = dealt(ranked).join(own, ["gap_part", "gap_rank"]).select(*_OWN, "seq")
            pairs = across if pairs is None else pairs.unionByName(across)
        least = min((p["least"] for p in parts if got[p["part"]] < p["docs"]), default=0)  # a task's last one is its shortest
        counts = {"docs": sum(p["docs"] - got[p["part"]] for p in parts), "paired": sum(p["pairs"] for p in parts) + sum(got.values()), "least": least, "parts": parts, "got": got}
        if met:
            table = F.broadcast(self.spark.createDataFrame(list(got.items()), "part int, got long"))
            left = left.join(table, "part").where("rank >= got").drop("got")
        return pairs, left, counts

    def begin(self, left: DataFrame, counts: dict, even: bool) -> DataFrame | None:
        """New sequences for the pieces of a round that got no gap: all of them, or those that no sequence's end cuts. Gives the others."""
        got = counts["got"]
        # what each task's ranks and lengths begin with, all tasks before it summed up
        starts = {(r["part"], r["rank"]): r["before"] for r in left.join(F.broadcast(self.spark.createDataFrame([(p, n) for p, n in got.items() if n], "part int, rank long")), ["part", "rank"]).select("part", "rank", "before").collect()} if any(got.values()) else {}
        table, rank, tokens = [], 0, 0
        for p in counts["parts"]:
            n = got[p["part"]]
            if n < p["docs"]:
                skipped = starts[p["part"], n] if n else 0
                table.append((p["part"], rank - n, tokens - skipped))
                rank, tokens = rank + p["docs"] - n, tokens + p["tokens"] - skipped
        base = F.broadcast(self.spark.createDataFrame(table, "part int, rank_0 long, before_0 long"))
        rows = left.drop("seq").join(base, "part").withColumns({"at": F.col("rank") + F.col("rank_0"), "sum": F.col("before") + F.col("before_0")})
        window = self.window
        if even:
            # so many of a length fit, whatever they are; longer ones come first, so each number's are a run of ranks
            fit = F.expr(f"{window} div length")
            numbers = sorted(((r["fit"], r["n"]) for r in rows.groupBy(fit.alias("fit")).agg(F.count("*").alias("n")).collect()))
            seq: Column = F.lit(None).cast("long")
            first, begun = 0, self.begun
            for k, n in numbers:
                seq = F.when(fit == k, F.expr(f"{begun} + (at - {first}) div {k}")).otherwise(seq)
                first, begun = first + n, begun + -(-n // k)
            self.begun = begun
            self.place(rows.withColumn("seq", seq * 2), rank)
            return None
        first, last = F.expr(f"sum div {window}"), F.expr(f"(sum + length - 1) div {window}")
        whole, begun = first == last, self.begun
        self.begun += -(-tokens // window)
        self.place(rows.where(whole).withColumn("seq", (F.lit(begun) + first) * 2), rank)
        return rows.where(~whole).select(*_OWN)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids (little-endian 32-bit)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "best-fit")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.save(_pieces(rows, tokenizer_path, window, with_ids), "pieces")
    placed = place_pieces(pieces.where("sequence_id is null").select(*_OWN), window, scratch)
    whole = pieces.where("sequence_id is not null").select(*_OWN, F.col("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = whole.unionByName(placed)
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.join(pieces.select("key", "ids"), "key").select(*shown, "ids") if with_ids else out.select(*shown)


def place_pieces(pieces: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """The pieces (columns of _OWN, each shorter than a window) with sequence_id and offset. Read twice a band, so it should be a table."""
    state = Packing(pieces.sparkSession, window, scratch)
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # no more than the window has
    for low, top in bands(window):
        n = sum(k for length, k in lengths.items() if low < length <= top)
        if not n:
            continue
        docs = pieces.where((F.col("length") > low) & (F.col("length") <= top))
        while docs is not None:
            pairs, left, counts = state.match(docs, n, low, top)
            n = counts["docs"]
            if pairs is not None:
                state.place(pairs, counts["paired"])
            if not counts["docs"]:
                break
            if state.largest >= counts["least"] and counts["paired"] * WORTH >= counts["docs"]:
                docs = left.select(*_OWN)
                continue
            docs = state.begin(left, counts, low * EVEN >= window)
            if docs is not None:
                docs = scratch.save(docs, "cut")
                if docs.isEmpty():
                    break
    if not state.placed:
        return pieces.select(*_OWN, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where("false")
    placed = state.placed[0]
    for more in state.placed[1:]:
        placed = placed.unionByName(more)
    by = Window.partitionBy("seq").orderBy("round", "key")
    return placed.select(*_OWN, F.col("seq").alias("sequence_id"), (F.sum("length").over(by) - F.col("length")).alias("offset"))
