"""Merkle manifest of a dataset: a root for every group of rows, one over all, and a proof for every row.

A row's leaf is the hash of its columns; every FANOUT consecutive nodes of a group, in the order of the id, become
the hash of their digests as hex text, until one is left: the group's subroot. Subroots, in the order of the
groups, become the root in the same way.

Rows are numbered within their group by one range sort (a group spans as many tasks as it needs; only the count of
each partition's first and last run meets on the driver) and cut into aligned blocks of FANOUT ** LEVELS. A block
is a contiguous numpy matrix of 64-byte hex digests: its rows are reshaped by the fanout and hashed level by level,
and the siblings of a node are found by index arithmetic alone. What is left of each block is a node of the tier
above, which is cut into blocks again, so a table of n rows has log(n) / log(FANOUT ** LEVELS) tiers. Proofs go down
the same tiers: each block gets the siblings above it once, not once a row.

Defined results: a null column has a mark of its own; a null group is a group, and comes first; rows without an id
come first in their group and are never tampered with; rows that repeat an id are ordered by their leaves, and equal rows
have proofs of their own; texts of any length are hashed whole; other columns are ignored, whatever their names; an
empty table gives an empty result and no root.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Consecutive nodes that become one.
FANOUT = 16
#: Levels within a block of leaves, and the leaves of a block.
LEVELS = 2
BLOCK = FANOUT**LEVELS
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*columns: Column) -> Column:
    """Lowercase hex hash of columns: each is `-` if null, else its length in UTF-8 bytes, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def h(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def levels(digests: bytes, block: int) -> list[bytes]:
    """All levels of a block, its own nodes first and what is left of it last, each as the hex digests side by side.

    A group's only block ends at one node. Every other one is hashed LEVELS times, the last one too, however few its nodes."""
    nodes = np.frombuffer(digests, dtype=np.uint8).reshape(-1, HEX)
    out, alone = [digests], block == 0 and len(nodes) < BLOCK
    while (len(nodes) > 1) if alone else (len(out) <= LEVELS):
        whole = len(nodes) // FANOUT * FANOUT
        rows = nodes[:whole].reshape(-1, FANOUT * HEX)
        made = [sha256(row).hexdigest().encode() for row in rows]
        if whole < len(nodes):
            made.append(h(nodes[whole:].tobytes()))
        out.append(b"".join(made))
        nodes = np.frombuffer(out[-1], dtype=np.uint8).reshape(-1, HEX)
    return out


def siblings(tower: list[bytes], i: int) -> list[bytes]:
    """What stands left and right of node i in its run, level by level."""
    out = []
    for level in tower[:-1]:
        a = i // FANOUT * FANOUT * HEX
        out += [level[a : i * HEX], level[(i + 1) * HEX : a + FANOUT * HEX]]
        i //= FANOUT
    return out


def fold(digest: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2]):
        digest = h(left, digest, right)
    return digest


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The table with rank (long from 0): the place of each row among those of its key, in the order of the columns of order.

    The rows of a key may lie in any number of tasks. A saved table; key must come first in its order."""
    own = rows.columns
    schema = rows.withColumns({"part": F.lit(0), "run": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}).schema

    def run(batches):
        part, key, runs, at = TaskContext.get().partitionId(), None, -1, 0
        for b in batches:
            if not len(b):
                continue
            keys = b.column("key")
            new = np.r_[key is None or keys[0].as_py() != key, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            number = runs + np.cumsum(new)
            place = np.arange(len(b))
            since = np.maximum.accumulate(np.where(new, place, -1))
            within = np.where(since < 0, place + at, place - since)
            key, runs, at = keys[-1].as_py(), int(number[-1]), int(within[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(number), pa.array(within)], [*own, "part", "run", "at"])

    placed = scratch.save(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).mapInArrow(run, schema), name)
    # a row for each partition: what its first and its last run have
    ends = placed.groupBy("part").agg(F.min_by("key", "run").alias("first"), F.max(F.struct("run", "at", "key")).alias("last"))
    carried, before = [], ("", 0)
    for p in sorted(ends.collect(), key=lambda p: p["part"]):
        offset = before[1] if p["first"] == before[0] else 0
        if offset:
            carried.append((p["part"], offset))
        before = (p["last"]["key"], p["last"]["at"] + 1 + (offset if p["last"]["run"] == 0 else 0))
    # at most one row a partition
    offsets = F.broadcast(rows.sparkSession.createDataFrame(carried, "part int, offset long"))
    rank = F.col("at") + F.when(F.col("run") == 0, F.coalesce("offset", F.lit(0))).otherwise(F.lit(0))
    return placed.join(offsets, "part", "left").select(*own, rank.cast("long").alias("rank"))


def _each_block(batches, keys: tuple[str, str]):
    """Tables of the rows of one block each, from batches sorted by block."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not len(b):
            continue
        a, c = b.column(keys[0]), b.column(keys[1])
        new = pc.or_(pc.not_equal(a[1:], a[:-1]), pc.not_equal(c[1:], c[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(b)]
        for x, y in zip(cuts, cuts[1:]):
            key = (a[x].as_py(), c[x].as_py())
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held)


def blocks(nodes: DataFrame, payload: tuple[tuple[str, str], ...], scratch: Scratch, name: str) -> DataFrame:
    """A row for each aligned block of nodes (key, rank, digest): key, block, digests (side by side), root, and the payload's columns as arrays. A saved table."""
    schema = "key string, block long, digests binary, root string" + "".join(f", {c} array<{t}>" for c, t in payload)
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches):
        for (key, block), rows in _each_block(batches, ("key", "block")):
            digests = "".join(rows.column("digest").to_pylist()).encode()
            made = [[key], [block], [digests], [levels(digests, block)[-1].decode()], *([rows.column(c).to_pylist()] for c, _ in payload)]
            types = [pa.string(), pa.int64(), pa.binary(), pa.string(), *(pa.list_(kinds[t]) for _, t in payload)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types)], ["key", "block", "digests", "root", *(c for c, _ in payload)])

    rows = nodes.select("key", F.expr(f"rank div {BLOCK}").alias("block"), "rank", "digest", *(c for c, _ in payload))
    return scratch.save(rows.repartition("key", "block").sortWithinPartitions("key", "block", "rank").mapInArrow(run, schema), name)


def climb(nodes: DataFrame, payload: tuple[tuple[str, str], ...], scratch: Scratch, name: str) -> list[DataFrame]:
    """Tiers of blocks of every key, the nodes' own first; the last has one block a key, whose root is the key's."""
    tiers = [blocks(nodes, payload, scratch, f"{name}-0")]
    while (tiers[-1].agg(F.max("block").alias("top")).first()["top"] or 0) > 0:
        above = tiers[-1].select("key", F.col("block").alias("rank"), F.col("root").alias("digest"))
        tiers.append(blocks(above, (), scratch, f"{name}-{len(tiers)}"))
    return tiers


def _down(tier: DataFrame, extra: str) -> DataFrame:
    """For every node of a tier (whose blocks have path, the siblings above them): key, rank, path, and the column extra, which has a value for the block or one for each node."""
    schema = f"key string, rank long, path array<binary>, {extra} string"

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                tower = levels(row["digests"], row["block"])
                n, value = len(row["digests"]) // HEX, row[extra]
                first = row["block"] * BLOCK
                paths = pa.array([siblings(tower, i) + row["path"] for i in range(n)], pa.list_(pa.binary()))
                each = pa.array(value if isinstance(value, list) else [value] * n, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), paths, each], ["key", "rank", "path", extra])

    return tier.select("key", "block", "digests", "path", extra).mapInArrow(run, schema)


class Manifest:
    """The tiers of a table's digests, written; root (None for an empty table), subroots, proofs and the check of other leaves.

    leaves: id (long), group (string), leaf (hex), other (hex of a leaf to be checked in its place, or null)."""

    def __init__(self, leaves: DataFrame):
        spark = leaves.sparkSession
        small_batches(spark)
        self.scratch = scratch = Scratch(spark, "manifest")
        key = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # a null group comes first
        rows = scratch.save(leaves.select(key.alias("key"), "id", F.col("leaf").alias("digest"), "other"), "leaves")
        rows = numbered(rows, ["id", "digest"], scratch, "rows")
        self.groups = climb(rows, (("id", "long"), ("other", "string")), scratch, "group")
        scratch.drop("leaves", "rows")
        roots = self.groups[-1].select(F.lit("all").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest"))
        self.tops = climb(numbered(roots, ["name"], scratch, "subroots"), (("name", "string"),), scratch, "top")
        found = self.tops[-1].select("root").first()
        self.root: str | None = found["root"] if found else None

    def subroots(self) -> DataFrame:
        """group, subroot of every group."""
        group = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
        return self.groups[-1].select(group.alias("group"), F.col("root").alias("subroot"))

    def _paths(self) -> DataFrame:
        """The blocks of leaves, each with the siblings above it (path), subroot and root."""
        top, *rest = reversed(self.tops)
        tier = top.withColumn("path", F.array().cast("array<binary>"))
        for below in rest:
            tier = below.join(_down(tier.withColumn("none", F.lit("")), "none").select("key", F.col("rank").alias("block"), "path"), ["key", "block"])
        path = _down(tier, "name").select(F.col("name").alias("key"), "path")
        top, *rest = reversed(self.groups)
        tier = top.withColumn("subroot", F.col("root")).join(path, "key")
        for below in rest:
            tier = below.join(_down(tier, "subroot").withColumnRenamed("rank", "block"), ["key", "block"])
        return tier

    def _each(self, schema: str, make) -> DataFrame:
        """Rows that make(id, leaf, other, siblings to the root, subroot) gives for every leaf."""
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def run(batches):
            for b in batches:
                for k in range(len(b)):
                    row = b.slice(k, 1).to_pylist()[0]
                    tower = levels(row["digests"], row["block"])
                    leaves = tower[0]
                    rows = [make(key, leaves[i * HEX : (i + 1) * HEX], other, siblings(tower, i) + row["path"], row["subroot"]) for i, (key, other) in enumerate(zip(row["id"], row["other"]))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

        return self._paths().select("block", "digests", "id", "other", "path", "subroot").mapInArrow(run, schema)

    def proofs(self) -> DataFrame:
        """id, leaf, subroot, siblings of every leaf: the digests (hex, side by side) left and right of it in its run, then of the run's, up to the root."""
        return self._each("id long, leaf string, subroot string, siblings array<string>", lambda key, own, other, path, subroot: (key, own.decode(), subroot, [x.decode() for x in path]))

    def checked(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root, verified: the root that the leaf under check (other, else the leaf itself) gives with the leaf's own siblings."""
        root = self.root

        def make(key, own, other, path, subroot):
            folded = fold(other.encode() if other else own, path).decode()
            return key, own.decode(), subroot, root, h(*path).decode(), folded, folded == root

        return self._each("id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", make)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", tampered: tuple[Column, dict[str, Column]] | None = None) -> Manifest:
    """The manifest of a table. tampered: which rows have a leaf under check, and what their columns hold there."""
    other = F.lit(None).cast("string")
    if tampered is not None:
        at, changed = tampered
        other = F.when(at, leaf(*(changed.get(c, F.col(c)) for c in columns)))
    return Manifest(docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("group"), leaf(*map(F.col, columns)).alias("leaf"), other.alias("other")))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the text of every fifth document by the hash of its id is lowered before the check."""
    at = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(docs, tampered=(at, {"text": lowered(F.col("text"))})).checked().withColumnRenamed("id", "doc_id")


def crc32_sql(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text, byte by byte and bit by bit."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {bits}), 4294967295)"


def oracle(group_levels: int = 6, top_levels: int = 3) -> str:
    """SQL of manifest_report for groups of at most FANOUT ** group_levels rows, FANOUT ** top_levels of them."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    own = " || ".join(field(c) for c in COLUMNS)
    low = " || ".join(field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in COLUMNS)
    crc = crc32_sql("doc_id::VARCHAR")
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({own}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({low}) END AS other FROM documents)",
        "d0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce(other, leaf) AS f, '' AS p FROM leaves)",
        "g0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM d0)",
    ]

    def tower(node: str, rows: str, level: int, top: bool) -> None:
        k, f = f"{node}{level}", f"{rows}{level}"
        beside = lambda frame: f"coalesce(string_agg(d, '') OVER (PARTITION BY g, i // {FANOUT} ORDER BY i ROWS BETWEEN {frame}), '')"
        at = f"{'j' if top else 'i'} // {FANOUT**level}"
        parts.append(f"{k}s AS (SELECT g, i, n, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {k})")
        parts.append(f"{node}{level + 1} AS (SELECT g, i // {FANOUT} AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {k} GROUP BY ALL)")
        joined = f"s.i = {f}.{at}" + ("" if top else f" AND s.g = {f}.g")
        parts.append(f"{rows}{level + 1} AS (SELECT {f}.* REPLACE (CASE WHEN s.n = 1 THEN f ELSE sha256(s.l || f || s.r) END AS f, CASE WHEN s.n = 1 THEN p ELSE p || s.l || s.r END AS p) FROM {f} JOIN {k}s s ON {joined})")

    for level in range(group_levels):
        tower("g", "d", level, False)
    parts.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS n, g AS name FROM g{group_levels})")
    parts.append(f"e0 AS (SELECT x.*, t0.i AS j, t0.d AS subroot FROM d{group_levels} x JOIN t0 ON t0.name = x.g)")
    for level in range(top_levels):
        tower("t", "e", level, True)
    return "WITH " + ", ".join(parts) + f" SELECT e.doc_id, e.leaf, e.subroot, t.d AS root, sha256(e.p) AS proof_sha256, e.f AS folded_root, e.f = t.d AS verified FROM e{top_levels} e CROSS JOIN t{top_levels} t"


ORACLE = oracle()
