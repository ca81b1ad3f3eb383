"""Interval joins against plain loops: every length and level, crowded cells, odd rows, and the work they do."""

import random

import pytest
from pyspark.sql import functions as F

from pacelake.operators.intervals import interval_join

SCHEMA = "k string, a double, b double, id long"


def made(rng, n, span, lengths):
    out = []
    for i in range(n):
        a = rng.randrange(span)
        out.append((rng.choice(["hot"] * 5 + ["x", None]), None if rng.random() < 0.02 else float(a), float(a + rng.choice(lengths) - (rng.random() < 0.05)), i))
    return out


def plain(left, right):
    fine = lambda r: None not in r[:3] and r[1] <= r[2]
    return sorted((x[3], y[3]) for x in left for y in right if fine(x) and fine(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])


def joined(spark, left, right, **options):
    got = interval_join(spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA), ["k"], ("a", "b"), ("a", "b"), **options)
    assert got.columns == ["k", "a", "b", "id", "right_a", "right_b", "right_id"]
    return sorted((r["id"], r["right_id"]) for r in got.collect())


@pytest.mark.parametrize("lengths,others", [([0], [0]), ([0, 1, 5], [0]), ([0], [3, 400]), ([0, 1, 2, 3, 4, 7, 8, 9, 64, 500, 999], [0, 1, 16, 33, 700]), ([1000], [1, 2])])
@pytest.mark.parametrize("unit,block", [(1, 2_048), (0.3, 7), (40, 3)])
def test_matches_plain_loops(spark, lengths, others, unit, block):
    rng = random.Random(len(lengths) * 31 + block)
    left, right = made(rng, 120, 1_000, lengths), made(rng, 90, 1_000, others)
    assert joined(spark, left, right, unit=unit, block=block) == plain(left, right)


def test_negative_and_fractional_places_and_equal_ends(spark):
    left = [("k", -7.5, -0.25, 1), ("k", 0.0, 0.0, 2), ("k", -3.0, 4.0, 3), ("k", 4.0, float("inf"), 4), ("k", float("nan"), 1.0, 5)]
    right = [("k", -0.25, 0.0, 1), ("k", 4.0, 9.0, 2), ("k", -9.0, -7.5, 3)]
    assert joined(spark, left, right) == [(1, 1), (1, 3), (2, 1), (3, 1), (3, 2)]


def test_empty_tables_whole_numbers_and_points(spark):
    windows = spark.createDataFrame([(1, 3, 9), (1, 5, 5), (2, 0, 99)], "clip int, a long, b long")
    frames = spark.range(12).select(F.lit(1).alias("clip"), F.col("id").alias("t"))
    got = interval_join(windows, frames, ["clip"], ("a", "b"), ("t", "t"))
    assert sorted((r["a"], r["t"]) for r in got.collect()) == [(3, t) for t in range(3, 10)] + [(5, 5)]
    assert interval_join(windows, frames.where("false"), ["clip"], ("a", "b"), ("t", "t")).collect() == []
    assert interval_join(windows.where("false"), frames, ["clip"], ("a", "b"), ("t", "t")).collect() == []


def test_rows_compared_are_a_small_multiple_of_rows_out(spark):
    # one key, intervals of 1 to 4,096 over a long line: all pairs are 25 million
    rng = random.Random(4)
    rows = [("k", float(a), float(a + (1 << rng.randrange(13))), i) for i, a in enumerate(rng.randrange(4_000_000) for _ in range(5_000))]
    df = spark.createDataFrame(rows, SCHEMA)
    out = interval_join(df, df, ["k"], ("a", "b"), ("a", "b"))
    n = out.count()
    assert n == len(plain(rows, rows))
    compared = spark.sparkContext  # pairs that share a cell, by the join's own columns
    from pacelake.operators import intervals

    seen = []
    whole = intervals._met

    def counted(longer, shorter, by, unit, block, scratch):
        keys = [*by, "level_", "cell_"]
        seen.append(longer.groupBy(*keys).agg(F.count("*").alias("x")).join(shorter.groupBy(*keys).agg(F.count("*").alias("y")), keys).agg(F.sum(F.col("x") * F.col("y")).alias("n")).first()["n"] or 0)
        return whole(longer, shorter, by, unit, block, scratch)

    intervals._met = counted
    try:
        interval_join(df, df, ["k"], ("a", "b"), ("a", "b")).count()
    finally:
        intervals._met = whole
    assert compared is not None and sum(seen) < 6 * n


def test_plan_has_no_join_by_inequality(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0, 1)], SCHEMA)
    plan = interval_join(df, df, ["k"], ("a", "b"), ("a", "b"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
