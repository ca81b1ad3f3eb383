"""Contacts of a stream against those of a table: any order, any micro-batches, late frames, and a restart."""

import datetime as dt

import numpy as np
import pytest

from pacelake.operators import contacts
from pacelake.streaming.contacts import ROCKSDB, Detector, Leg, stream_contacts

SCHEMA = "clip_id long, leg string, frame long, at timestamp, comp double, vis double"
START = dt.datetime(2024, 5, 1, 12)
FPS, HEIGHT = 60.0, 2160.0


def walk(clip, n, seed, gaps=True):
    rng = np.random.default_rng(seed)
    out = []
    for leg in "LR":
        t = np.arange(n) / (16 + clip % 5) + (0.5 if leg == "R" else 0.0)
        u = t - np.floor(t)
        comp = 400 + np.where(np.arange(n) // 97 % 4 == 2, 5.0, 70.0) * 4 * u * (1 - u) + rng.random(n) * 4
        missing = rng.random(n) < (0.1 if gaps else 0)
        if gaps and n > 60:
            missing[:3], missing[-4:], missing[20:40] = True, True, True
        for f in range(n):
            out.append((clip, leg, f, START + dt.timedelta(seconds=f / FPS), None if missing[f] else float(comp[f]), float(0.55 + 0.4 * u[f])))
    return out


def batch(spark, rows):
    found = contacts.coarse_contacts(spark.createDataFrame(rows, SCHEMA).drop("at"), HEIGHT, FPS)
    return sorted((r["clip_id"], r["leg"], r["frame"], round(r["confidence"], 9), r["toe_off"], round(r["gct_ms"], 9)) for r in found.collect())


def test_the_detector_gives_the_rows_of_a_table(spark):
    rows = [r for clip, n in enumerate([1, 2, 5, 17, 18, 40, 90, 300]) for r in walk(clip, n, clip)] + [(90, "L", f, START, None, 0.9) for f in range(20)]
    want = batch(spark, rows)
    got = []
    for clip, leg in sorted({r[:2] for r in rows}):
        state = Leg()
        found = []
        for r in rows:
            if r[:2] == (clip, leg):
                d = Detector(state, 0.001 * HEIGHT, FPS)  # as if each frame came in a batch of its own
                d.push(r[4], r[5])
                found += d.out
                assert len(state.full) <= 2 * 8 + 26 and (len(state.vis) <= 45 or state.known_at < 0)
        d = Detector(state, 0.001 * HEIGHT, FPS)
        d.finish()
        got += [(clip, leg, f, round(c, 9), t, round(ms, 9)) for f, c, t, ms in found + d.out]
    assert len(want) > 30 and sorted(got) == want


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(*ROCKSDB)
    yield
    spark.conf.unset(ROCKSDB[0])


def run(spark, folder, batches, late="10 seconds", restart=None):
    """Files of rows, a micro-batch each; the query is stopped and begun anew after `restart` of them."""
    source, sink = folder / "in", folder / "out"
    source.mkdir()

    def go():
        frames = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
        found = stream_contacts(frames, HEIGHT, FPS, late=late, idle_ms=5_000)
        q = found.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(folder / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"part-{i}"))
        for path in (folder / f"part-{i}").glob("*.parquet"):
            path.rename(source / f"{i:04}.parquet")
        if restart is not None and i + 1 == restart:
            go()
    go()
    got = spark.read.schema("clip_id long, leg string, frame long, confidence double, toe_off long, gct_ms double").parquet(str(sink))
    return sorted((r["clip_id"], r["leg"], r["frame"], round(r["confidence"], 9), r["toe_off"], round(r["gct_ms"], 9)) for r in got.collect())


#: A frame of no leg that is looked at, so late that all others end.
CLOCK = [(99, "L", 0, START + dt.timedelta(hours=h), None, 0.0) for h in (1, 2)]


@pytest.mark.parametrize("restart", [None, 3])
def test_any_order_within_the_watermark_gives_the_rows_of_a_table(spark, rocksdb, tmp_path, restart):
    rows = [r for clip, n in ((1, 40), (2, 300), (3, 330)) for r in walk(clip, n, clip)]
    rng = np.random.default_rng(2)
    shuffled = sorted(rows, key=lambda r: r[3].timestamp() + rng.random())  # a second ahead or behind
    batches = [shuffled[i : i + 250] for i in range(0, len(shuffled), 250)] + [[c] for c in CLOCK]
    want = batch(spark, rows)
    assert len(want) > 20 and run(spark, tmp_path, batches, "2 seconds", restart) == want


def test_late_frames_are_dropped_and_lost_ones_are_gaps(spark, rocksdb, tmp_path):
    rows = walk(1, 300, 5, gaps=False)
    lost = {(leg, f) for leg in "LR" for f in (30, 31, 100)}
    late = {(leg, f) for leg in "LR" for f in (50, 51, 200)}
    ahead = [r for r in rows if (r[1], r[2]) not in lost | late]
    after = [r for r in rows if (r[1], r[2]) in late]
    got = run(spark, tmp_path, [ahead, [(99, "L", 0, START + dt.timedelta(seconds=5.5), None, 0.0)], [(99, "L", 1, START + dt.timedelta(seconds=5.6), None, 0.0)], after, [CLOCK[0]], [CLOCK[1]]], "0 seconds")
    missing = [r if (r[1], r[2]) not in lost | late else (*r[:4], None, 0.0) for r in rows]
    assert got == batch(spark, missing)


def test_a_clip_that_ends_leaves_no_state(spark, rocksdb, tmp_path):
    run(spark, tmp_path, [walk(1, 60, 1), [CLOCK[0]], [CLOCK[1]]])
    left = spark.read.format("statestore").option("stateVarName", "leg").load(str(tmp_path / "checkpoint"))
    assert {r["key"]["clip_id"] for r in left.select("key").collect()} <= {99}
