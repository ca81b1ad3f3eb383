"""Exact deduplication with a cuckoo-filter index of live digests.

A text's digest is the SHA-256 of the text without white space. Digests are dealt to shards by hash;
each shard holds a cuckoo filter in front of a store of its keys, bucketed as the filter is. A miss of
the filter proves a digest new. A hit is checked against the stored keys of its bucket. When an
insertion finds no free slot the filter is built anew, twice as large, from the stored keys. Deletion
takes a key from store and filter alike; a stored index deletes documents, and a digest dies with the
last document that has it.

Defined results: a null text counts as empty; empty tables give empty results; columns other than the
id and the text are ignored; rows that repeat a doc_id count towards group_size and all carry the
decision of that doc_id; ties go to the smallest doc_id (null ids last).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Partial-key cuckoo filter over 256-bit hex digests: four slots a bucket, 16-bit fingerprints."""

    def __init__(self, buckets: int = 16):
        self.mask = buckets - 1
        self.rows: list[list[int]] = [[] for _ in range(buckets)]

    def place(self, digest: str) -> tuple[int, int]:
        return int(digest[16:28], 16) & self.mask, int(digest[28:32], 16) or 1

    def other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 & self.mask)

    def contains(self, digest: str) -> bool:
        b, f = self.place(digest)
        return f in self.rows[b] or f in self.rows[self.other(b, f)]

    def insert(self, digest: str) -> bool:
        """False when no slot was found; the filter must then be rebuilt."""
        b, f = self.place(digest)
        for at in (b, self.other(b, f)):
            if len(self.rows[at]) < SLOTS:
                self.rows[at].append(f)
                return True
        for kick in range(MAX_KICKS):
            row = self.rows[b]
            row[kick % SLOTS], f = f, row[kick % SLOTS]
            b = self.other(b, f)
            if len(self.rows[b]) < SLOTS:
                self.rows[b].append(f)
                return True
        return False

    def delete(self, digest: str) -> bool:
        b, f = self.place(digest)
        for at in (b, self.other(b, f)):
            if f in self.rows[at]:
                self.rows[at].remove(f)
                return True
        return False


class DigestIndex:
    """Live digests of one shard: the filter, and entries in the bucket their digest belongs to."""

    def __init__(self, buckets: int = 16):
        self.filter = CuckooFilter(buckets)
        self.store: dict[int, dict[str, list]] = {}
        self.size = self.resizes = self.false_hits = 0

    def _bucket(self, digest: str) -> dict[str, list]:
        return self.store.setdefault(self.filter.place(digest)[0], {})

    def entries(self) -> Iterator[tuple[str, list]]:
        for bucket in self.store.values():
            yield from bucket.items()

    def get(self, digest: str) -> list | None:
        if not self.filter.contains(digest):
            return None
        found = self.store.get(self.filter.place(digest)[0], {}).get(digest)
        self.false_hits += found is None
        return found

    def insert(self, digest: str, entry: list) -> None:
        self._bucket(digest)[digest] = entry
        self.size += 1
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: str) -> bool:
        if self.get(digest) is None:
            return False
        del self._bucket(digest)[digest]
        self.filter.delete(digest)
        self.size -= 1
        return True

    def _resize(self) -> None:
        kept, buckets = list(self.entries()), len(self.filter.rows)
        while True:
            buckets *= 2
            self.filter, self.store = CuckooFilter(buckets), {}
            self.resizes += 1
            if all(self.filter.insert(d) for d, _ in kept):
                break
        for d, e in kept:
            self._bucket(d)[d] = e


ENTRY = "digest string, best_chars long, keep_id long, group_size long"


def _merge(into: list, chars: int, doc_id: int | None, n: int) -> None:
    """Most code points, then the smallest doc_id; counts add up."""
    if doc_id is not None and (into[1] is None or (-chars, doc_id) < (-into[0], into[1])):
        into[0], into[1] = chars, doc_id
    into[2] += n


def _from_frame(index: DigestIndex, pdf: pd.DataFrame) -> None:
    for d, c, k, n in zip(pdf["digest"], pdf["best_chars"], pdf["keep_id"], pdf["group_size"]):
        k = None if pd.isna(k) else int(k)
        found = index.get(d)
        if found is None:
            index.insert(d, [int(c), k, int(n)])
        else:
            _merge(found, int(c), k, int(n))


def _to_frames(index: DigestIndex, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    batch: list[tuple] = []
    for d, e in index.entries():
        batch.append((d, *e))
        if len(batch) == rows:
            yield _frame(batch)
            batch = []
    if batch:
        yield _frame(batch)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["digest", "best_chars", "keep_id", "group_size"])
    pdf["keep_id"] = pdf["keep_id"].astype("Int64")
    return pdf


def _index_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Insert every row of the partition into an index; what it holds at the end."""
    index = DigestIndex()
    for pdf in frames:
        _from_frame(index, pdf)
    yield from _to_frames(index)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, best_chars, digest of every row, in JVM expressions; the text goes no further."""
    text = text_or_empty(text_col)
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("best_chars"),
        F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256).alias("digest"),
    )


def keepers(rows: DataFrame) -> DataFrame:
    """One entry per digest. rows: doc_id, best_chars, digest.

    Each input partition indexes its own rows first, so a digest that a third of all rows share reaches
    its shard as one row per partition."""
    local = rows.select("digest", "best_chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return local.mapInPandas(_index_partition, ENTRY).repartition("digest").mapInPandas(_index_partition, ENTRY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.save(digests(docs, id_col, text_col), "digests")
    best = keepers(rows).select("digest", "keep_id", "group_size")
    return rows.join(best, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


class StoredIndex:
    """A digest index kept as tables of entries and of their documents, changed by tables of insertions and deletions.

    Every change writes a new version under root and reads the one before, shard by shard; a shard holds
    about shard_rows keys, and the number of shards is set anew with each version. Deleting a document takes
    all rows with its id and digest; where other documents still have the digest, the entry is made anew from
    them. A null doc_id is a document like any other."""

    def __init__(self, spark: SparkSession, root: str, shard_rows: int = 200_000):
        self.spark, self.root, self.shard_rows, self.version = spark, root.rstrip("/"), shard_rows, -1
        self.parts: list[str] = []

    def entries(self) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/v{self.version}")

    def members(self) -> DataFrame:
        """digest, best_chars, doc_id of every document in the index."""
        kind = "doc_id long, best_chars long, digest string"
        return self.spark.read.schema(kind).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], kind)

    def _write_members(self, rows: DataFrame) -> str:
        path = f"{self.root}/members-v{self.version + 1}"
        rows.select("doc_id", "best_chars", "digest").write.parquet(path)
        return path

    def apply(self, changes: DataFrame) -> DataFrame:
        """changes: digest, best_chars, keep_id, group_size, deleted. Deletions of digests are applied before insertions."""
        shards = max(1, -(-(self.entries().count() + changes.count()) // self.shard_rows))
        shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
        # a digest repeated within the changes is first reduced to one row of each kind
        less = changes.groupBy("digest", "deleted").agg(
            F.max("best_chars").alias("best_chars"),
            F.max_by("keep_id", F.struct("best_chars", -F.col("keep_id"))).alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        )

        def change(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            index = DigestIndex()
            _from_frame(index, old)
            for d in new.loc[new["deleted"], "digest"]:
                index.delete(d)
            _from_frame(index, new[~new["deleted"]])
            return pd.concat(list(_to_frames(index)) or [_frame([])])

        out = self.entries().groupBy(shard).cogroup(less.groupBy(shard)).applyInPandas(change, ENTRY)
        out.write.parquet(f"{self.root}/v{self.version + 1}")
        self.version += 1
        return self.entries()

    def insert(self, docs: DataFrame) -> DataFrame:
        path = self._write_members(digests(docs))
        rows = self.spark.read.parquet(path)
        self.parts.append(path)
        return self.apply(keepers(rows).withColumn("deleted", F.lit(False)))

    def delete(self, docs: DataFrame) -> DataFrame:
        """Take the documents of docs (by id and text) out of the index."""
        members = self.members()
        gone = digests(docs).select(F.col("digest").alias("gone_digest"), F.col("doc_id").alias("gone_id")).distinct()
        same = (F.col("digest") == F.col("gone_digest")) & F.col("doc_id").eqNullSafe(F.col("gone_id"))
        touched = members.join(gone, same, "left_semi").select("digest").distinct()
        path = self._write_members(members.join(gone, same, "left_anti"))
        left = self.spark.read.parquet(path).join(touched, "digest", "left_semi")
        dead = touched.select("digest", F.lit(0).cast("long").alias("best_chars"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("deleted"))
        out = self.apply(dead.unionByName(keepers(left).withColumn("deleted", F.lit(False))))
        self.parts = [path]
        return out

    def contains(self, docs: DataFrame) -> DataFrame:
        rows = digests(docs)
        live = self.entries().select("digest").withColumn("live", F.lit(True))
        return rows.join(live, "digest", "left").select("doc_id", F.coalesce("live", F.lit(False)).alias("live"))
