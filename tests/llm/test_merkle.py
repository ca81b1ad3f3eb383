"""The Merkle manifest against a plain version, on odd rows, and its proofs one by one."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pacelake.llm import merkle
from test_llm import DOC, prose

LONG = prose(77, 60_000)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, with lists alone."""
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def climb(nodes):
        """Root and, for each node, its siblings as (left, right) upwards."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for p, i in zip(paths, at):
                a = i // 16 * 16
                p.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
            at = [i // 16 for i in at]
            level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        return level[0], paths

    leaf = lambda r, text: h(*(mark(v) for v in (*r[:1], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0], leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in groups[s]])
    root, above = climb([trees[s][0] for s in names])
    out = []
    for s, over in zip(names, above):
        for (key, own, r), path in zip(groups[s], trees[s][1]):
            bad = key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and r[1] is not None
            d = leaf(r, r[1].translate(low)) if bad else own
            for left, right in path + over:
                d = h(left, d, right)
            out.append((key, own, trees[s][0], root, h(*(x for pair in path + over for x in pair)), d, d == root))
    return out


def made(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, n) for i, t, lang, s, n in rows], DOC)
    for c in ("key", "rank", "part", "at", "run", "block", "digest", "leaf", "path", "other", "root", "id", "group"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def rows_of(n, source):
    return [(i, f"Text {i}", "en", source, i) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(1, "a"),
        rows_of(16, None) + rows_of(17, "a"),
        rows_of(256, "a") + rows_of(257, "b") + rows_of(1, "c"),
        [r for k in range(300) for r in rows_of(1 + k % 3, f"s{k}")],
        [(1, LONG, None, "a", None), (1, LONG, None, "a", None), (None, "No id", "en", None, 1), (2, None, "de", "", 0), (3, "", "de", "é", -5), (5, "ÄÖ Z", "de", "z", 4), (7, "x", "en", "Z", 1), (7, "Y", "en", "Z", 1)],
    ],
)
def test_report_is_that_of_a_plain_version(spark, rows):
    got = merkle.manifest_report(made(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_a_group_over_many_partitions_and_three_tiers(spark):
    n = 70_000  # more than 256 blocks of one group
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 1000 > 0, "hot").alias("source"), F.col("id").alias("n_chars"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made_ = merkle.manifest(docs)
        got = {r["id"]: r for r in made_.proofs().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made_.groups) == 3 and len(got) == n
    want = plain([(i, f"T{i}", "en", "hot" if i % 1000 else None, i) for i in range(n)])
    for key, own, subroot, root, proof, _, _ in want:
        r = got[key]
        assert (r["leaf"], r["subroot"], h(*r["siblings"])) == (own, subroot, proof)
    assert made_.root == want[0][3]
    assert dict(map(tuple, made_.subroots().collect())) == {("hot" if w[0] % 1000 else None): w[2] for w in want}


def test_a_changed_leaf_a_moved_sibling_and_another_root_do_not_verify(spark):
    found = merkle.manifest(made(spark, rows_of(300, "a") + rows_of(2, "b")))
    for r in found.proofs().where("id in (0, 17, 299)").collect():
        path = [x.encode() for x in r["siblings"]]
        assert merkle.fold(r["leaf"].encode(), path).decode() == found.root
        assert merkle.fold(r["leaf"][::-1].encode(), path).decode() != found.root
        assert merkle.fold(r["leaf"].encode(), path[::-1]).decode() != found.root


def test_an_empty_table_has_no_root(spark):
    docs = made(spark, []).where("false")
    assert merkle.manifest(docs).root is None and merkle.manifest_report(docs).collect() == []
