"""Helpers the operators of this subpackage share: shared scratch tables and bounded text slices."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


_own_dirs: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session (tests) gets a new one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="pacelake-checkpoint-")
    return _own_dirs[app]


class Scratch:
    """Tables written to the shared checkpoint folder, so that a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[str, list[str]] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        self._paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, last: int = 0) -> None:
        """Remove saved tables that no later step reads, but the last ones of each name."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            kept = self._paths.get(name, [])
            self._paths[name] = kept[len(kept) - last :]
            for gone in kept[: len(kept) - last]:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids up to this number are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def if_few(ids: DataFrame) -> DataFrame:
    """A saved table of ids, with a broadcast hint only if its counted size allows it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def dealt(table: DataFrame) -> DataFrame:
    """A saved table that grows with the corpus, to be joined by shuffles on both sides at every size, so that Spark can split skewed keys."""
    return table.hint("merge")


def without_ids(docs: DataFrame, ids: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ids; rows without an id stay."""
    gone = scratch.save(ids.where(F.col(id_col).isNotNull()).select(id_col).distinct(), "gone")
    return docs.join(if_few(gone), id_col, "left_anti").select(*docs.columns)


def with_row_key(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """The table with a key (long) of its own for every row, and the key's name.

    A row's id is its key where no other row has it. Rows without an id, or whose id comes again, are
    written with keys beyond the largest id, as keys made while reading could change when a task runs again."""
    key = "row_key_"
    while key in docs.columns:
        key += "_"
    own = F.col(id_col).cast("long")
    ids = docs.select(own.alias("id_"))
    again = scratch.save(ids.where("id_ is not null").groupBy("id_").count().where("count > 1").select("id_"), "again")
    known = ids.agg(F.max("id_").alias("top"), F.coalesce(F.bool_or(F.col("id_").isNull()), F.lit(False)).alias("lacks")).first()
    if not known["lacks"] and again.isEmpty():
        return docs.withColumn(key, own), key
    top = -1 if known["top"] is None else max(-1, known["top"])
    if top >= 1 << 62:  # no room beyond it: every row is written
        return scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key
    again = if_few(again)
    odd = docs.where(own.isNull()).unionByName(docs.join(again, own == F.col("id_"), "left_semi"))
    odd = scratch.save(odd.withColumn(key, F.lit(top + 1) + F.monotonically_increasing_id()), "keyed")
    return docs.where(own.isNotNull()).join(again, own == F.col("id_"), "left_anti").withColumn(key, own).unionByName(odd), key


def by_row(docs: DataFrame, id_col: str, text_col: str, work, ids: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """work(table of doc_id and text) on a table whose doc_id is a key of each row; in its columns named by ids, keys become the rows' ids again."""
    keyed, key = with_row_key(docs.select(F.col(id_col), F.col(text_col)), scratch, id_col)
    own = F.col(id_col).cast("long")
    out = work(keyed.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")))
    other = keyed.where(~F.col(key).eqNullSafe(own)).select(F.col(key).alias("key_"), own.alias("id_"), F.lit(True).alias("known_"))
    if other.isEmpty():
        return out
    other = if_few(scratch.save(other, "other"))
    for c in ids:
        out = out.join(other, F.col(c) == F.col("key_"), "left").withColumn(c, F.when(F.col("known_"), F.col("id_")).otherwise(F.col(c))).drop("key_", "id_", "known_")
    return out


def without_rows(docs: DataFrame, decide, scratch: Scratch) -> DataFrame:
    """The rows that decide(table, key column) keeps: it gives doc_id (the key) and kept for every row."""
    keyed, key = with_row_key(docs, scratch)
    gone = decide(keyed, key).where("not kept").select(F.col("doc_id").alias(key))
    return without_ids(keyed, gone, scratch, key).select(*docs.columns)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


#: Rows of an Arrow batch between the JVM and Python; texts of some KB make that a few MB.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS where more are set: both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """Cut an Arrow batch so that the text of each piece stays near max_bytes; one row is never split."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // max_bytes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), for hashing integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
