"""Near-duplicate vectors by counting collisions at the ends of many one-dimensional projections.

Unit vectors are projected on many random lines. On a line, a query's window is the end of the line it
lies in: what is at least `place` from the middle on its side. A vector lies in some ENDS such ends, out of
thousands; two vectors collide on a line if they are in the same end of it. All vectors are sorted by the ends they lie
in, so a window is one run of rows; inside a run, the collisions of each pair on all lines are counted,
and pairs that pass the count are verified by cosine in double precision.

The passing count is calibrated by proof, whatever the vectors: over random lines the places of two unit
vectors are normal with a correlation equal to their cosine, and lines are independent, so the number of
collisions of a pair is binomial. Lines, ends and count are chosen so that a pair at exactly the wanted
cosine is missed once in 1 / (1 - RECALL) times; nearer pairs (copies) far more rarely. Windows narrow as the
table grows (a share of 1 / sqrt(2 n) of the vectors each) while lines are added, so work grows as n^1.5 and
the rows that are shuffled as n. Tables whose unlike vectors are alike too (a high cosine throughout) have
fuller windows and more candidates; the result does not change.

A pair is handled in the first window that it shares and in no other, so no list of pairs is made, and each
window emits for its vectors the number of links found and, of the links, a spanning forest. Equal vectors
are one class, worked on once and weighted by its size. A window with more than BLOCK vectors is dealt by hash into
blocks, and each pair of blocks is a task of its own.

Defined results: a null or zero vector, or one with null or non-finite components, has no links and is
its own component; vectors are compared with those of their own length only; ties go to the smallest id;
repeated rows count as linked with each other; a row without an id links like any other but names no
component, and is kept only where its component has no id at all; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from math import ceil, comb, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, if_few, small_batches
from .components import components

#: Ends that a vector lies in on average, before lines are added for the recall.
ENDS = 24
#: Share of the pairs at exactly the wanted cosine that must pass the count.
RECALL = 0.9995
#: The widest window, as a share of all vectors.
WIDEST = 0.05
BLOCK = 2_048
TILE = 256
#: Lines that are drawn and multiplied at once.
LINES = 4_096
#: Windows with so many vectors of a run are counted by a matrix product (as many as MATRIX of them), others pair by pair.
MANY, MATRIX = 64, 512


def _both(place: float, cosine: float) -> float:
    """Probability that both of two standard normal places with this correlation are beyond place."""
    x = np.linspace(place, place + 9, 4_001)
    normal = NormalDist()
    rest = sqrt(1 - min(cosine, 0.9999) ** 2)
    beyond = np.array([1 - normal.cdf((place - cosine * v) / rest) for v in x])
    return float(np.trapezoid(np.exp(-x * x / 2) / sqrt(2 * np.pi) * beyond, x))


def _fewer(lines: int, chance: float, count: int) -> float:
    """Probability of fewer than count collisions on so many lines."""
    return sum(comb(lines, k) * chance**k * (1 - chance) ** (lines - k) for k in range(count))


class Windows:
    """Number of lines, place where ends begin, and passing count for a number of vectors."""

    def __init__(self, n: int, cosine: float):
        if not 0 < cosine <= 1:
            raise ValueError(f"the cosine must be above 0 and at most 1: {cosine}")
        share = min(WIDEST, 1 / sqrt(2 * max(1, n)))
        self.place = NormalDist().inv_cdf(1 - share)
        chance = 2 * _both(self.place, cosine)
        lines = ceil(ENDS / (2 * share))
        while _fewer(lines, chance, 2) > 1 - RECALL:
            lines += max(1, lines // 20)
        self.lines, self.passing = lines, 2
        while _fewer(lines, chance, self.passing + 1) <= 1 - RECALL:
            self.passing += 1
        self.recall = 1 - _fewer(lines, chance, self.passing)

    def ends(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of unit vectors and the ends they lie in (twice the line, one more for the far side), by row and end."""
        dim = unit.shape[1]
        flat = unit.astype(np.float32)
        rows, ends = [], []
        for first in range(0, self.lines, LINES):
            count = min(LINES, self.lines - first)
            # drawn anew from the number of the first line: no task keeps them, and each task draws the same
            lines = np.random.default_rng([7, dim, first]).standard_normal((count, dim), dtype=np.float32)
            for a in range(0, len(flat), TILE):
                at = flat[a : a + TILE] @ lines.T
                r, k = np.nonzero(np.abs(at) >= self.place)
                rows.append(r + a)
                ends.append(2 * (k + first) + (at[r, k] < 0))
        row, end = np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(ends or [np.empty(0, np.int64)])
        order = np.argsort(row, kind="stable")
        return row[order], end[order].astype(np.int32)


def _merge(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x and y, pair by pair; the smaller index leads. Parents are roots before and after."""
    while True:
        a, b = parent[x], parent[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]


class Run:
    """The vectors of one window (or of a pair of its blocks): candidates by count, links by cosine."""

    def __init__(self, end: int, ends: np.ndarray, bounds: np.ndarray, block: np.ndarray, passing: int):
        """ends: all ends of each vector, with bounds; block: of each vector. Of two blocks only pairs across are meant."""
        self.m, self.passing, self.block = len(block), passing, block
        self.two = bool(len(block)) and bool((block != block[0]).any())
        owner = np.repeat(np.arange(self.m), np.diff(bounds))
        other = ends != end
        owner, ends = owner[other], ends[other]
        order = np.argsort(ends, kind="stable")
        self.owner, ends = owner[order], ends[order]
        first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(ends)])
        many = np.flatnonzero(size >= MANY)
        many = many[np.argsort(-size[many], kind="stable")][:MATRIX]
        self.matrix = np.zeros((self.m, len(many)), dtype=np.float32)
        for c, k in enumerate(many.tolist()):
            self.matrix[self.owner[first[k] : first[k] + size[k]], c] = 1
        self.before = ends[first[many]] < end
        alone = np.ones(len(first), dtype=bool)
        alone[many] = False
        # pairs of all other shared ends: each member with the later ones of its end
        at = np.repeat(first + size, size) - np.arange(len(ends)) - 1
        at[~np.repeat(alone, size)] = 0
        x = np.repeat(np.arange(len(ends)), at)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(at) - at, at)
        pair, place = np.unique(self.owner[x] * self.m + self.owner[y], return_inverse=True)
        self.pair = pair
        self.count = np.bincount(place, minlength=len(pair))
        self.earlier = np.bincount(place[ends[x] < end], minlength=len(pair)) > 0

    def candidates(self):
        """Arrays x, y (x before y) of the pairs that pass the count and share no earlier window."""
        if not self.matrix.shape[1]:
            good = (self.count + 1 >= self.passing) & ~self.earlier
            yield self._meant(self.pair[good] // self.m, self.pair[good] % self.m)
            return
        early, late = self.matrix[:, self.before], self.matrix
        bounds = np.searchsorted(self.pair, np.arange(0, self.m + TILE, TILE) * self.m)
        for t, a in enumerate(range(0, self.m, TILE)):
            b = min(self.m, a + TILE)
            seen = early[a:b] @ early.T > 0
            own = slice(bounds[t], bounds[t + 1])
            at = self.pair[own] - a * self.m
            seen.reshape(-1)[at[self.earlier[own]]] = True
            if seen.all():
                continue
            count = late[a:b] @ late.T
            count.reshape(-1)[at] += self.count[own]
            x, y = np.nonzero(~seen & (count + 1 >= self.passing))
            later = x + a < y
            yield self._meant(x[later] + a, y[later])

    def _meant(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.two:
            across = self.block[x] != self.block[y]
            x, y = x[across], y[across]
        return x, y

    def links(self, vectors, weights: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Weighted number of links of each vector, and a forest (parent of each). vectors() gives unit rows; it is called only if there are candidates."""
        found, parent, unit = np.zeros(self.m, dtype=np.int64), np.arange(self.m), None
        for x, y in self.candidates():
            unit = vectors() if unit is None and len(x) else unit
            for c in range(0, len(x), 65_536):
                p, q = x[c : c + 65_536], y[c : c + 65_536]
                linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[linked], q[linked]
                np.add.at(found, p, weights[q])
                np.add.at(found, q, weights[p])
                _merge(parent, p, q)
        return found, parent


def _rows(flat: np.ndarray, n: int) -> np.ndarray:
    """n unit rows of one length."""
    return _unit(flat.astype(np.float64).reshape(n, -1))


def _bytes(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The numbers between bounds as binaries."""
    data = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _numbers(column: pa.Array, number: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each binary's numbers start in all of them, with one more at the end, and the numbers."""
    _, offsets, data = column.buffers()
    kind = np.dtype(number)
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return (at - at[0]) // kind.itemsize, flat.view(kind) if not at[0] % kind.itemsize else np.frombuffer(flat.tobytes(), dtype=kind)


FOUND = "rep long, found long, root long"
KEY = ["dim", "end", "i", "j"]


def near_vectors(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "vectors")
    kind = rows.select(vector_col).schema[0].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vector = F.col(vector_col).cast(kind)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(vector, lambda x: x != 0)
    all_ = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(~bad, vector).alias("v"))
    classes = all_.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # a class of rows without ids gets a number of its own
    classes = scratch.save(classes.select("v", "least", "weight", F.coalesce("least", F.lit(-(1 << 62)) - F.monotonically_increasing_id()).alias("rep"), F.size("v").alias("dim")), "classes")

    found = _links(classes, classes.count(), kind, cosine, scratch)
    counts = found.groupBy("rep").agg(F.sum("found").alias("found"))
    merged = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    named = classes.join(counts, "rep", "left").join(merged, F.col("rep") == F.col("node"), "left").select(
        "v", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    # classes without ids lead no component: the smallest id among its classes does
    if not classes.where("least is null").isEmpty():
        real = classes.join(merged, F.col("rep") == F.col("node"), "left").groupBy(F.coalesce("component", "rep").alias("component")).agg(F.min("least").alias("least"))
        named = named.join(real, "component", "left").select("v", "n_links", F.col("least").alias("component"))
    out = all_.join(named, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def _links(classes: DataFrame, n: int, kind: str, cosine: float, scratch: Scratch) -> DataFrame:
    """rep, found, root: links of each class in one window, and what it is connected with there."""
    windows = Windows(n, cosine)
    number = "<f4" if kind == "array<float>" else "<f8"

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(number)
                row, end = windows.ends(_rows(flat, len(part)))
                bounds = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rep", "weight", "dim")), _bytes(flat, np.arange(len(part) + 1) * dim), _bytes(end, bounds), pa.ListArray.from_arrays(bounds, end)],
                    ["rep", "weight", "dim", "v", "own", "ends"],
                )

    # vectors and ends travel as bytes; the ends once more as an array, to be dealt by
    placed = classes.select("rep", "weight", "dim", "v").mapInArrow(place, "rep long, weight long, dim int, v binary, own binary, ends array<int>")
    placed = scratch.save(placed, "placed")
    # windows with more vectors than a block holds: how many blocks they need
    full = placed.select("dim", F.explode("ends").alias("end")).groupBy("dim", "end").count().where(F.col("count") > BLOCK)
    full = scratch.save(full.select("dim", "end", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "full")
    dealt = placed.select("*", F.explode("ends").alias("end")).join(if_few(full), ["dim", "end"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "end", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "rep", "weight", "v", "own")

    def count(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            keys = np.stack([batch.column(k).to_numpy() for k in KEY])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            cut = np.r_[0, cut]
            yield from _found(batch, cut, number, windows.passing, cosine)
            held = batch.slice(int(cut[-1]))
        if held is not None and len(held):
            yield from _found(held, np.array([0, len(held)]), number, windows.passing, cosine)

    found = dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(count, FOUND)
    found = scratch.save(found, "found")
    scratch.drop("placed", "full")
    return found


def _found(batch: pa.RecordBatch, cuts: np.ndarray, number: str, passing: int, cosine: float):
    """FOUND rows of the runs between cuts."""
    end, block, rep, weight = (batch.column(k).to_numpy() for k in ("end", "block", "rep", "weight"))
    (at, flat), (v_at, v) = _numbers(batch.column("own"), "<i4"), _numbers(batch.column("v"), number)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        run = Run(int(end[a]), flat[at[a] : at[b]], at[a : b + 1] - at[a], block[a:b], passing)
        found, parent = run.links(lambda a=a, b=b: _rows(v[v_at[a] : v_at[b]], b - a), weight[a:b], cosine)
        some = np.flatnonzero(found)
        if len(some):
            out.append((rep[a:b][some], found[some], rep[a:b][parent[some]]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["rep", "found", "root"])


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square overflows
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS node, a AS peer FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.peer = l.a),
m AS (SELECT node, min(peer) AS component_id FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(m.component_id, v.vec_id) AS component_id, coalesce(m.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN m ON m.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
