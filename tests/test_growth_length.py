"""Clips are brought to one length without a table of all output frames."""

import pytest

from pacelake.operators import body


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("length,least", [(7, 1), (6, 3), (1, 1)])
def test_clips_are_brought_to_length_by_their_own_rows(spark, length, least):
    rows = [(c, t, lm, float(100 * c + t)) for c in range(1, 12) for t in range(c) for lm in (0, 5)]
    pose = spark.createDataFrame(rows, "clip_id long, frame long, lm int, x double")
    nose = pose.where("lm = 0").select("clip_id", "frame")
    columns = ["clip_id", "i", "lm", "x", "status"]
    want = pose.join(body.windowed_index(nose, length, least), ["clip_id", "frame"]).select(*columns).collect()
    made = body.brought_to_length(pose, nose, length, least)
    assert sorted((r["clip_id"], int(r["i"]), r["lm"], r["x"], r["status"]) for r in made.select(*columns).collect()) == sorted(map(tuple, want))
    # no table of all output frames is joined, which could be sent through the driver
    plan = _plan(made)
    assert plan.index("Generate") < plan.index("Join")
