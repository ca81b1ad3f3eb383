"""Filling of gaps whose work must not grow with the square of a sequence."""

import pytest
from pyspark.sql import functions as F

from pacelake.functions import windows


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_are_filled_without_frames_that_end_at_the_last_row(spark):
    s = spark.createDataFrame([(1, t, None if t % 3 else float(t), float(t), 0.9) for t in range(20)], "clip_id long, frame long, x double, y double, vis double")
    made = (
        windows.interpolate(s, ["clip_id"], "x", "o"),
        windows.fill_gaps_linear(s, ["clip_id"], "x", "vis", "o"),
        windows.fill_gaps_xy(s, ["clip_id"], "x", "y", "vis", ("y",)),
        windows.fill_short_gaps(s, ["clip_id"], "x", "vis", "o"),
    )
    for df in made:
        assert "currentrow$(), unboundedfollowing$()" not in _plan(df)


def test_columns_filled_together_are_as_each_on_its_own(spark):
    rows = [(c, t, None if (t * 7 + c) % 3 else float(t * t), None if (t + c) % 4 else float(t), 0.5) for c in (1, 2) for t in range(15)] + [(3, t, None, None, 0.5) for t in range(3)]
    s = spark.createDataFrame(rows, "clip_id long, frame long, a double, b double, sigma double").withColumn("sigma", F.when(F.col("clip_id") == 1, F.lit(2.0)).otherwise(F.lit(3.0)))
    both = windows.interpolate_all(s, ["clip_id"], {"a": "fa", "b": "fb"})
    each = windows.interpolate(windows.interpolate(s, ["clip_id"], "a", "fa"), ["clip_id"], "b", "fb")
    assert sorted(map(str, both.collect())) == sorted(map(str, each.collect()))
    both = windows.gaussian_all(both, ["clip_id"], {"fa": "ga", "fb": "gb"}, "sigma")
    for r in both.where("clip_id < 3").collect():
        values = [x["fa"] for x in each.where(f"clip_id = {r['clip_id']}").orderBy("frame").collect()]
        w = windows.gaussian_weights(r["sigma"])
        places = [(r["frame"] + k - len(w) // 2) % (2 * len(values)) for k in range(len(w))]
        assert r["ga"] == pytest.approx(sum(x * values[m if m < len(values) else 2 * len(values) - 1 - m] for x, m in zip(w, places)), abs=1e-9)
