"""Two streams of frames against combine_two over tables: order, late sides, and what is kept."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake.operators import body
from pacelake.streaming.passes import combined_stream, gathered

START = dt.datetime(2024, 5, 1, 12)
POSE = "clip_id long, frame long, at timestamp, lm int, x double, y double, vis double"
LMS = (0, 11, 12, 23, 24, 25, 26)


def rows(clip, n, seed, off):
    rng = np.random.default_rng(seed)
    out = []
    for t in range(n):
        lost = rng.random() < 0.15
        shift = 60 if rng.random() < 0.2 else 2
        for lm in LMS:
            gone = lost or rng.random() < 0.05
            out.append((clip, t, START + dt.timedelta(seconds=t / 10 + off), lm, None if gone else 100.0 * lm + 9 * t + shift * float(rng.random()), None if gone else 50.0 * lm, 0.0 if gone else float(rng.random())))
    return out


def shown(df):
    flat = df.select("clip_id", "frame", "chosen", F.inline("points"))
    return {(r["clip_id"], r["frame"], r["lm"]): (r["chosen"], *(None if r[c] is None else round(r[c], 9) for c in ("x", "y", "vis"))) for r in flat.collect()}


@pytest.fixture(scope="module")
def passes(spark):
    a = [r for k in (1, 2) for r in rows(k, 200, k, 0.0)]
    b = [r for k in (1, 2) for r in rows(k, 200, 10 + k, 1.0)]
    return a, b


def test_tables_of_frames_give_the_rows_of_landmarks(spark, passes):
    a, b = (spark.createDataFrame(p, POSE) for p in passes)
    want = {(r["clip_id"], r["frame"], r["lm"]): (r["chosen"], *(None if r[c] is None else round(r[c], 9) for c in ("x", "y", "vis"))) for r in body.combine_two(a, b, 500.0).collect()}
    got = combined_stream(gathered(a), gathered(b), 500.0)
    assert shown(got) == want and {v[0] for v in want.values()} == {"avg", "fwd", "rev", "none"}
    assert got.where("not complete").count() == 0


def test_streams_give_the_rows_of_tables_and_forget_what_has_met(spark, passes, tmp_path):
    a, b = passes
    missing = {(1, 7), (2, 30), (2, 59)}  # frames of the second pass that never come
    clock = [(99, 10_000, START + dt.timedelta(hours=h), lm, 1.0, 1.0, 1.0) for h in (1, 2) for lm in (23, 24)]
    whole = {"a": a, "b": [r for r in b if (r[0], r[1]) not in missing]}
    schema = gathered(spark.createDataFrame(a, POSE)).schema
    rng = np.random.default_rng(3)
    for name, mine in whole.items():
        (tmp_path / name).mkdir()
        frames = sorted({r[:2] for r in mine}, key=lambda f: f[1] / 10 + rng.random() * (3 if name == "b" else 1))
        cuts = [frames[i : i + 40] for i in range(0, len(frames), 40)]
        for i, cut in enumerate([*cuts, [(99, 10_000)], [(99, 10_000)]]):
            part = [r for r in mine if r[:2] in set(cut)] if i < len(cuts) else clock[2 * (i - len(cuts)) : 2 * (i - len(cuts)) + 2]
            gathered(spark.createDataFrame(part, POSE)).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
            for path in (tmp_path / f"{name}-{i}").glob("*.parquet"):
                path.rename(tmp_path / name / f"{i:04}.parquet")
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = combined_stream(read("a"), read("b"), 500.0, "4 seconds", "2 seconds")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("clip_id < 99")
    pair = [gathered(spark.createDataFrame(whole[k], POSE)) for k in "ab"]
    assert shown(got) == shown(combined_stream(*pair, 500.0))
    alone = {(r["clip_id"], r["frame"]) for r in got.where("not complete").select("clip_id", "frame").collect()}
    assert alone == missing
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) < 500 and kept[-1] <= 4  # of 797 frames; at the end no more than the clock's
