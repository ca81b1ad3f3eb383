"""As-of joins against plain loops, over one task and over many, and what they do with odd rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pacelake.operators.asof import asof_join

LEFT, RIGHT = "k string, t long, id long", "k string, t long, v long"


def plain(left, right, direction, tolerance, exact, tie="backward"):
    out = []
    for k, t, i in left:
        rows = [] if k is None or t is None else [(rt, v) for rk, rt, v in right if rk == k and rt is not None]
        back = max((r for r in rows if r[0] < t or (exact and r[0] == t)), default=None)
        ahead = min((r for r in rows if r[0] > t or (exact and r[0] == t)), key=lambda r: (r[0], -r[1]), default=None)
        if direction == "nearest":
            ahead = min((r for r in rows if r[0] > t), key=lambda r: (r[0], -r[1]), default=None)
            near = [r for r in (back, ahead) if r]
            hit = min(near, key=lambda r: (abs(r[0] - t), (r is back) != (tie == "backward")), default=None)
        else:
            hit = back if direction == "backward" else ahead
        if hit and tolerance is not None and abs(hit[0] - t) > tolerance:
            hit = None
        out.append((k, t, i, *(hit or (None, None))))
    return sorted(out, key=str)


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def tables(seed, n, m, span):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    time = lambda: None if rng.random() < 0.03 else rng.randrange(span)
    return [(key(), time(), i) for i in range(n)], [(key(), time(), i) for i in range(m)]


@pytest.mark.parametrize("direction,tolerance,exact,tie", [("backward", None, True, "backward"), ("backward", 3, False, "backward"), ("forward", None, True, "backward"), ("forward", 5, False, "backward"), ("nearest", 2, True, "backward"), ("nearest", None, True, "forward")])
@pytest.mark.parametrize("n,m,span", [(300, 40, 2_000), (60, 300, 50), (200, 3, 500)])
def test_matches_plain_loops(spark, many_tasks, direction, tolerance, exact, tie, n, m, span):
    left, right = tables(n + m, n, m, span)
    got = asof_join(spark.createDataFrame(left, LEFT).repartition(5), spark.createDataFrame(right, RIGHT).repartition(3), ["k"], "t", "t", direction, tolerance, exact, tie, ["v"])
    assert got.columns == ["k", "t", "id", "right_t", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(left, right, direction, tolerance, exact, tie)


def test_rows_of_one_key_and_time_fill_many_tasks(spark, many_tasks):
    left = spark.range(500).select(F.lit("hot").alias("k"), F.lit(7).alias("t"), "id")
    right = spark.createDataFrame([("hot", 3, 1), ("hot", 9, 2)], RIGHT)
    for direction, v in (("backward", 1), ("forward", 2), ("nearest", 2)):
        assert {r["v"] for r in asof_join(left, right, ["k"], "t", "t", direction).collect()} == {v}


def test_no_join_by_inequality_and_one_sort(spark):
    left, right = spark.createDataFrame([("a", 1, 1)], LEFT), spark.createDataFrame([("a", 1, 1)], RIGHT)
    plan = asof_join(left, right, ["k"], "t", "t")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_times_of_every_kind(spark):
    day = dt.datetime(2024, 3, 31, 1, 30)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # an hour is missing on that day; local times have none missing
    try:
        for kind in ("timestamp_ntz", "timestamp"):
            left = spark.createDataFrame([(1, day + dt.timedelta(hours=3, microseconds=5))], "k int, a timestamp_ntz").withColumn("a", F.col("a").cast(kind))
            right = spark.createDataFrame([(1, day + dt.timedelta(hours=h, microseconds=m), h) for h, m in ((0, 0), (2, 9), (3, 5), (4, 1))], "k int, b timestamp_ntz, h int").withColumn("b", F.col("b").cast(kind))
            got = lambda d, **o: asof_join(left, right, ["k"], "a", "b", d, **o).first()["h"]  # noqa: E731, B023
            assert (got("backward"), got("backward", exact=False), got("forward", exact=False)) == (3, 2, 4)
            assert got("backward", exact=False, tolerance=dt.timedelta(minutes=59)) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    left = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "a double")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "b int, s string")
    assert sorted((str(r["a"]), r["s"]) for r in asof_join(left, right, [], "a", "b").collect()) == [("1.5", "x"), ("None", None), ("nan", None)]
    days = spark.createDataFrame([(dt.date(2024, 1, 5), 1)], "a date, i int")
    assert asof_join(days, spark.createDataFrame([(dt.date(2024, 1, 2), 2)], "a date, j int"), [], "a", "a", tolerance=3).first()["j"] == 2


def test_empty_tables_and_wrong_directions(spark):
    left, right = spark.createDataFrame([("a", 1, 1)], LEFT), spark.createDataFrame([], RIGHT)
    assert [tuple(r) for r in asof_join(left, right, ["k"], "t", "t", "nearest").collect()] == [("a", 1, 1, None, None)]
    assert asof_join(left.where("false"), right, ["k"], "t", "t").collect() == []
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "t", "t", "sideways")
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "t", "t", "nearest", exact=False)
