"""Operators on chunks against those on whole sequences, with chunks of a few frames, and one long sequence over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake.functions import long as L
from pacelake.functions import windows as N
from pacelake.operators import contacts

BY = ["clip_id"]


@pytest.fixture(scope="module")
def sequences(spark):
    rng = np.random.default_rng(7)
    rows = []
    for clip, n in enumerate([1, 2, 3, 13, 14, 15, 40, 61, 130, 200]):
        known, flag = rng.random(n) < (0.4 if clip % 2 else 0.95), rng.random(n) < 0.6
        if n > 100:
            known[20:75] = False
            flag[30:90] = True
        for t in range(n):
            rows.append((clip, t, float(rng.normal()) if known[t] else None, float(np.cumsum(rng.normal(size=1))[0]), bool(flag[t]), 2.0 if clip % 3 else 3.0))
    rows += [(50, t, None, 1.0, True, 2.0) for t in range(30)]
    df = spark.createDataFrame(rows, "clip_id long, frame long, v double, x double, flag boolean, sigma double").repartition(5)
    return df.cache()


def same(got, want, digits=9):
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda x: round(x, digits) + 0.0 if isinstance(x, float) else x
    rows = lambda df: sorted((tuple(cell(r[c]) for c in sorted(want.columns)) for r in df.collect()), key=str)
    a, b = rows(got), rows(want)
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]


@pytest.mark.parametrize("size", [1, 7, 16, 64, 1_000])
def test_anchors_and_interpolation(sequences, size):
    same(L.anchors(sequences, BY, "v", size), N.anchors(sequences, BY, "v"))
    same(L.interpolate(sequences, BY, "v", "out", size), N.interpolate(sequences, BY, "v", "out"))


@pytest.mark.parametrize("size", [12, 13, 64, 1_000])
def test_filters(sequences, size):
    for sigma in (2.0, 3.0, "sigma"):
        same(L.gaussian(sequences, BY, "x", "out", sigma, size), N.gaussian(sequences, BY, "x", "out", sigma))
    with pytest.raises(ValueError):
        L.gaussian(sequences, BY, "x", "out", 3.0, 11)


@pytest.mark.parametrize("size", [1, 5, 64, 1_000])
def test_slopes_crossings_and_runs(sequences, size):
    same(L.gradient(sequences, BY, "x", "out", size), N.gradient(sequences, BY, "x", "out"))
    same(L.down_crossings(sequences, BY, "x", 0.1, size), N.down_crossings(sequences, BY, "x", 0.1))
    same(L.runs(sequences, BY, F.col("flag"), size), N.runs(sequences, BY, F.col("flag")))
    same(L.longest_run(sequences, BY, F.col("flag"), size), N.longest_run(sequences, BY, F.col("flag")))
    for gap in (0, 1, 3):
        same(L.first_session(sequences, BY, F.col("flag"), gap, 20, size), N.first_session(sequences, BY, F.col("flag"), gap, 20))


@pytest.mark.parametrize("size", [9, 10, 64, 1_000])
@pytest.mark.parametrize("gap", [1, 4, 9])
def test_greedy_gaps(sequences, size, gap):
    some = sequences.where("flag").select("clip_id", "frame", "x")
    whole = some.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("a"))
    whole = whole.select("clip_id", F.inline(N.greedy_min_gap(F.col("a"), gap, "struct<frame: bigint, x: double>", lambda r: r["frame"])))
    same(L.greedy(some, BY, gap, ["x"], size), whole)


def walking(spark, clips, n):
    t = F.col("frame").cast("double") / (F.lit(16) + F.col("clip_id") % 5) + F.when(F.col("leg") == "R", 0.5).otherwise(0.0)
    u = t - F.floor(t)
    rows = spark.range(clips).withColumnRenamed("id", "clip_id").withColumn("leg", F.explode(F.array(F.lit("L"), F.lit("R")))).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    still = F.floor(F.col("frame") / 97) % 4 == 2
    comp = F.lit(400.0) + F.when(still, 5.0).otherwise(70.0) * 4 * u * (1 - u) + F.pmod(F.xxhash64("clip_id", "leg", "frame"), F.lit(1_000)) / 200.0
    return rows.select("clip_id", "leg", "frame", F.when(F.pmod(F.xxhash64("frame"), F.lit(9)) > 0, comp).alias("comp"), F.when(F.col("clip_id") % 2 == 0, 0.3 + 0.1 * u).otherwise(0.5 + 0.4 * u).alias("vis"))


def test_contacts(spark):
    gait = walking(spark, 4, 700).cache()
    want = contacts.coarse_contacts(gait, 2160.0, 60.0)
    assert want.count() > 100
    for size in (12, 50, 256):
        same(L.coarse_contacts(gait, 2160.0, 60.0, size=size), want)


def test_one_long_sequence_fills_many_tasks(spark):
    n, size = 400_000, 8_192
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.range(n).select((F.col("id") * 0).alias("clip_id"), F.col("id").alias("frame"), F.when(F.pmod(F.xxhash64("id"), F.lit(50)) == 0, F.sin(F.col("id") / 30.0)).alias("v"))
        made = L.interpolate(one, BY, "v", "out", size)
        tasks = made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.max("out")).collect()
        assert len(tasks) > 20 and max(r["count"] for r in tasks) <= 6 * size
        got = np.array([x["out"] for x in made.orderBy("frame").collect()])
        long_runs = L.runs(one, BY, F.col("v").isNull(), size).where("flag").agg(F.sum("length").alias("n"), F.count("*").alias("k")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    v = np.array([np.nan if r["v"] is None else r["v"] for r in one.orderBy("frame").collect()])
    known = np.flatnonzero(np.isfinite(v))
    np.testing.assert_allclose(got, np.interp(np.arange(n), known, v[known]), atol=1e-9)
    missing = ~np.isfinite(v)
    assert long_runs["n"] == missing.sum() and long_runs["k"] == (np.diff(np.r_[0, missing.astype(int)]) == 1).sum()
