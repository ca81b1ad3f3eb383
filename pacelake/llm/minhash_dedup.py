"""MinHash near-deduplication by a signature-coordinate inverted join.

Documents with one shingle set form a class; the class is worked on once. Each class posts its id under
each of its K (coordinate, value) pairs. A pair of classes above the match threshold T shares T values,
so

- a class with fewer than T values that any other class holds has no partner and is skipped (skip);
- two partners share a value among the K - T + 1 rarest of each (prefix), so only those lists are joined.

Lists are not expanded into pairs. In two star rounds each class is compared with the first class of a
list, and linked ones are merged. Lists that then still hold more than one component are dealt to tasks,
long ones as pairs of blocks. A task counts equal coordinates for the pairs of different components that
meet first in its list, confirms those with T or more on the full shingle sets, merges as it goes, and
emits a spanning forest. Links inside one component would not change it, so components are those of all
links.

T is calibrated: at the similarity threshold s, matches are binomial (K, s), and T is the largest count
that such a pair misses with a probability below MISS.

Defined results: a text without words (or null) has no shingles and is linked with nothing; ties go to
the smallest doc_id; rows that repeat an id, and rows without one, are documents of their own, after those
whose id is theirs alone (so one row of each component is kept); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_row, dealt, if_few, mix64, slices, small_batches
from .components import components
from .words import split_words

COORDINATES = 64
MISS = 1e-5


def match_threshold(similarity: float, k: int = COORDINATES, miss: float = MISS) -> int:
    below, t = 0.0, 0
    while t < k:
        below += comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(1, t)
        t += 1
    return k


_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words = split_words(texts)
    distinct = np.array([w.translate(_LOWER) for w in words.distinct.to_numpy(zero_copy_only=False).tolist()], dtype=object)
    h = (pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.empty(0, np.uint64))[words.code]
    factor = mix64(np.arange(1, width + 1, dtype=np.uint64) << np.uint64(17)) | np.uint64(1)
    n = len(h)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        rolled[: max(0, n - j)] += h[j:] * factor[j]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (h[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


_FACTORS = mix64(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
_ADDS = mix64(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1 << 41))


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate, coordinate << 32 | smallest 32-bit hash."""
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048, None] * _FACTORS + _ADDS
        low = np.minimum(low, part.min(0))
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32) | low >> np.uint64(32)).astype(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash, keys of every row; no keys without shingles."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_hash", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, keys array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles of the rows whose id is in ids (doc_id, distinct)."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = [s.astype(np.int64) for s in shingle_sets(piece.column(1), width)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.join(if_few(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles array<long>")


#: Members of a list in one block.
BLOCK = 1_024


class _Merged:
    """Union-find over the numbers of the components in a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x


def _block_links(g: pd.DataFrame, threshold: int, percent: int) -> list[tuple[int, int]]:
    """Links between components of the members of one list (or pair of its blocks) that complete a spanning forest."""
    key, i, j = int(g["key"].iloc[0]), int(g["i"].iloc[0]), int(g["j"].iloc[0])
    coordinate = key >> 32
    keys = np.stack(g["keys"].to_numpy())
    low = (keys & 0xFFFFFFFF).astype(np.uint32)
    listed = np.stack([np.isin(k, p) for k, p in zip(keys, g["prefix"])])
    rep, sets = g["rep"].to_numpy(), g["shingles"].to_numpy()
    sizes = np.array([len(x) for x in sets])
    component = np.unique(g["component"].to_numpy(), return_inverse=True)[1]
    merged = _Merged(int(component.max()) + 1)
    block = g["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    out = []
    for s in range(0, len(left), 128):
        a = left[s : s + 128]
        for t in range(0, len(right), 512):
            b = right[t : t + 512]
            may = component[a][:, None] != component[b][None, :]
            if i == j:
                may &= a[:, None] < b[None, :]
            may &= 100 * np.minimum(sizes[a][:, None], sizes[b][None, :]) >= percent * np.maximum(sizes[a][:, None], sizes[b][None, :])
            x, y = np.nonzero(may)
            for c in range(0, len(x), 20_000):
                u, v = a[x[c : c + 20_000]], b[y[c : c + 20_000]]
                equal = low[u] == low[v]
                first = (equal & listed[u] & listed[v]).argmax(1) == coordinate  # in no other list before
                use = first & (equal.sum(1) >= threshold)
                for m, n in zip(u[use].tolist(), v[use].tolist()):
                    r, q = merged.root(int(component[m])), merged.root(int(component[n]))
                    if r == q:
                        continue
                    both = len(np.intersect1d(sets[m], sets[n], assume_unique=True))
                    if 100 * both >= percent * (sizes[m] + sizes[n] - both):
                        merged.parent[r] = q
                        out.append((int(rep[m]), int(rep[n])))
    return out


def list_links(members: DataFrame, threshold: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links between components. members: key, n (of the list), rep, component, keys, prefix, shingles."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.select("key", "i", "j", "block", "rep", "component", "keys", "prefix", "shingles")

    def run(frames):
        held: pd.DataFrame | None = None
        for pdf in frames:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.flatnonzero((pdf[["key", "i", "j"]] != pdf[["key", "i", "j"]].shift()).any(axis=1).to_numpy())
            out = [x for a, b in zip(new[:-1], new[1:]) for x in _block_links(pdf.iloc[a:b], threshold, percent)]
            held = pdf.iloc[new[-1] :]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if held is not None and len(held):
            yield pd.DataFrame(_block_links(held, threshold, percent), columns=["a", "b"], dtype="int64")

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, own_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Links have 100 * intersection >= percent * union. own_ids: every row is known to have an id of its own."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    if own_ids:
        return _near(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width, percent, scratch)
    return by_row(docs, id_col, text_col, lambda rows: _near(rows, width, percent, scratch), ("doc_id", "component_id"), scratch)


def _near(texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """As near_dedup, of a table whose doc_id is a key."""
    threshold = match_threshold(percent / 100)
    rows = scratch.save(signatures(texts, width), "signatures")
    classes = scratch.save(rows.where("n_shingles > 0").groupBy("set_hash", "keys").agg(F.min("doc_id").alias("rep")), "classes")

    # lists that more than one class is in; the smallest class of each
    posts = classes.select("rep", F.explode("keys").alias("key"))
    lists = scratch.save(posts.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1"), "lists")
    # written first, so that both sides of the join are plain shuffles and a hot key can be split
    shared = posts.join(dealt(lists), "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "key", "first"))).alias("shared"))
    # skip, then prefix: the values that no one else holds are the rarest
    shared = shared.where(F.size("shared") >= threshold)
    own = F.lit(COORDINATES) - F.size("shared")
    able = scratch.save(
        shared.select("rep", F.col("shared")[(F.size("shared") / 2).cast("int")]["first"].alias("middle"), F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.lit(COORDINATES - threshold + 1) - own)).alias("prefix")),
        "able",
    )
    keys = scratch.save(able.select("rep").join(classes, "rep").select("rep", "keys"), "keys")
    sets = scratch.save(sets_of(texts, able.select(F.col("rep").alias("doc_id")).distinct(), width), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) above the match threshold whose full sets are similar enough."""
        counted = pairs.join(keys.select(F.col("rep").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("rep").alias("b"), F.col("keys").alias("kb")), "b")
        counted = scratch.save(counted.where(F.size(F.array_intersect("ka", "kb")) >= threshold).select("a", "b"), name)
        full = counted.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        full = full.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
        return scratch.save(full.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sum") - F.col("both"))).select("a", "b"), name + "-links")

    def apart(pairs: DataFrame, merged: DataFrame) -> DataFrame:
        """Pairs of classes that are in different components so far."""
        label = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias("c" + c))
        out = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
        return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    links = confirmed(able.where("middle <> rep").select(F.col("middle").alias("a"), F.col("rep").alias("b")), "star")
    merged = components(links, scratch)
    prefix = able.select("rep", F.explode("prefix").alias("p")).select("rep", "p.key", "p.first")
    stars = prefix.where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    more = confirmed(apart(stars, merged), "stars")
    if not more.isEmpty():
        links = links.unionByName(more)
        merged = components(links, scratch)
    # lists that still hold more than one component
    label = merged.select(F.col("node").alias("rep"), F.col("component"))
    left = scratch.save(prefix.join(label, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "left")
    mixed = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    known = keys.join(able.select("rep", F.col("prefix")["key"].alias("prefix")), "rep").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    mixed = scratch.save(mixed, "mixed")
    members = left.join(dealt(mixed), "key").join(known, "rep")
    last = scratch.save(list_links(members, threshold, percent), "last")
    scratch.drop("lists", "able", "keys", "sets", "left", "mixed", "star", "stars")
    if not last.isEmpty():
        merged = components(links.unionByName(last), scratch)

    named = classes.join(merged, classes.rep == merged.node, "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
-- prefix filter: a pair above the threshold shares one of each set's rarest shingles
g AS (SELECT doc_id, unnest(grams) AS g FROM s),
f AS (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS df FROM g),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM f),
p AS (SELECT doc_id, g FROM r JOIN n USING (doc_id) WHERE k <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id < b.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * len(list_intersect(x.grams, y.grams)) >= 85 * (len(x.grams) + len(y.grams) - len(list_intersect(x.grams, y.grams)))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS peer FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.peer = e.a),
m AS (SELECT node, min(peer) AS component_id FROM reach GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component_id, n.doc_id) AS component_id, coalesce(m.component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN m ON m.node = n.doc_id
"""
