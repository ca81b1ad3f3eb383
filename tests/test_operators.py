"""Sequence operators against plain NumPy restatements of their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake.functions import windows as N
from pacelake.functions.scalar import predicted_seconds, swapped_landmark, vdot
from pacelake.operators import contacts, smoothing
from pacelake.sources import metadata


def frame(spark, values, clip=1):
    return spark.createDataFrame([(clip, i, None if v is None else float(v)) for i, v in enumerate(values)], "clip_id long, frame long, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("frame").collect()]


def test_gaussian_matches_padded_convolution(spark):
    x = np.random.default_rng(0).normal(size=30)
    r = 8
    w = np.array(N.gaussian_weights(2.0))
    want = np.convolve(np.pad(x, r, mode="symmetric"), w, mode="valid")
    got = column(N.gaussian(frame(spark, x), ["clip_id"], "v", "s", 2.0), "s")
    np.testing.assert_allclose(got, want, atol=1e-12)
    short = column(N.gaussian(frame(spark, [1, 1, 1]), ["clip_id"], "v", "s", 3.0), "s")
    np.testing.assert_allclose(short, [1, 1, 1])


def test_savgol_keeps_parabolas(spark):
    x = [3 + 2 * i - 0.5 * i * i for i in range(12)]
    np.testing.assert_allclose(column(N.savgol5(frame(spark, x), ["clip_id"], "v", "s"), "s"), x, atol=1e-9)


def test_interpolation_is_exact_on_a_line(spark):
    got = column(N.interpolate(frame(spark, [None, 2, None, None, 8, None]), ["clip_id"], "v", "s"), "s")
    assert got == [2, 2, 4, 6, 8, 8]
    assert column(N.interpolate(frame(spark, [None, None]), ["clip_id"], "v", "s"), "s") == [None, None]


@pytest.mark.parametrize("method", ["pchip", "cubic", "linear"])
def test_splines_keep_lines(spark, method):
    v = [1.0, 3, None, None, 9, 11, None, 15]
    df = frame(spark, v).withColumn("vis", F.lit(1.0))
    got = column(smoothing.fill_gaps(df, ["clip_id"], "v", "vis", method), "out")
    np.testing.assert_allclose(got, [1, 3, 5, 7, 9, 11, 13, 15], atol=1e-9)


def test_cubic_keeps_cubics():
    t = np.array([0.0, 1, 2.5, 4, 7])
    f = lambda x: x**3 - 2 * x + 1
    at = np.linspace(0, 7, 20)
    np.testing.assert_allclose(smoothing.hermite(t, f(t), smoothing.cubic_slopes(t, f(t)), at), f(at), atol=1e-8)


def test_pchip_does_not_overshoot():
    rng = np.random.default_rng(1)
    for _ in range(50):
        t, y = np.cumsum(rng.integers(1, 4, 8)).astype(float), rng.normal(size=8)
        at = np.linspace(t[0], t[-1], 200)
        s = smoothing.hermite(t, y, smoothing.pchip_slopes(t, y), at)
        k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, 6)
        assert (s <= np.maximum(y[k], y[k + 1]) + 1e-9).all() and (s >= np.minimum(y[k], y[k + 1]) - 1e-9).all()


def kalman_rts(y: np.ndarray, q_pos: float = 0.1, q_vel: float = 2.8, r: float = 25.0) -> np.ndarray:
    """Constant-velocity Kalman filter and Rauch-Tung-Striebel smoother of one series; NaN is missing. All NaN with under two values."""
    out = np.full(len(y), np.nan)
    known = np.flatnonzero(np.isfinite(y))
    if len(known) < 2:
        return out
    t0 = int(known[0])
    f, q = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([q_pos, q_vel])
    x, p = np.array([y[t0], 0.0]), np.diag([r, 10 * q_vel])
    states, covs, ahead = [x], [p], [p]
    for v in y[t0 + 1 :]:
        x, p = f @ x, f @ p @ f.T + q
        ahead.append(p)
        if np.isfinite(v):
            gain = p[:, 0] / (p[0, 0] + r)
            x = x + gain * (v - x[0])
            p = p - np.outer(gain, p[0])
        states.append(x)
        covs.append(p)
    smooth = [states[-1]]
    for k in range(len(states) - 2, -1, -1):
        g = covs[k] @ f.T @ np.linalg.inv(ahead[k + 1])
        smooth.append(states[k] + g @ (smooth[-1] - f @ states[k]))
    out[t0:] = [s[0] for s in reversed(smooth)]
    return out


def smooth_rows(spark, y):
    df = spark.createDataFrame([(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)], "clip_id long, frame long, v double")
    rows = smoothing.replace_outliers(df, ["clip_id"], "v", 15.0).orderBy("frame").collect()
    return np.array([np.nan if r["smoothed"] is None else r["smoothed"] for r in rows]), [r["flagged"] for r in rows], [r["out"] for r in rows]


def test_kalman_follows_a_line_and_flags_a_leap(spark):
    y = np.arange(40, dtype=float) * 5
    np.testing.assert_allclose(smooth_rows(spark, y)[0][5:-5], y[5:-5], atol=1.5)
    assert np.isnan(smooth_rows(spark, np.array([np.nan, 1.0, np.nan]))[0]).all()
    leap = y.copy()
    leap[20] += 200
    s, flagged, out = smooth_rows(spark, leap)
    assert flagged[20] and out[20] == pytest.approx(s[20])


def test_kalman_folds_are_the_matrix_recursion(spark):
    rng = np.random.default_rng(8)
    for n in (2, 3, 17, 80):
        y = np.cumsum(rng.normal(size=n) * 9)
        y[rng.random(n) < 0.3] = np.nan
        if n > 3:
            y[:2] = np.nan
        s, flagged, _ = smooth_rows(spark, y)
        want = kalman_rts(y)
        np.testing.assert_allclose(s, want, atol=1e-6)
        with np.errstate(invalid="ignore"):
            assert flagged == (np.abs(y - want) > 15.0).tolist()


def test_peaks_suppress_from_the_highest(spark):
    x = [0, 3, 0, 5, 0, 4, 0, 0, 0, 0, 0, 0, 0, 2, 2, 2, 0]
    got = sorted((r["frame"], r["height"]) for r in N.peaks(frame(spark, x), ["clip_id"], "v", 10).collect())
    assert got == [(3, 5.0), (14, 2.0)]


def test_longest_run_takes_the_earliest_of_equals(spark):
    df = frame(spark, [1, 1, None, 1, 1, None])
    r = N.longest_run(df, ["clip_id"], F.col("v").isNotNull()).collect()[0]
    assert (r["start"], r["stop"], r["length"]) == (0, 1, 2)


def test_swap_is_its_own_inverse(spark):
    df = spark.range(33).select(F.col("id"), swapped_landmark(swapped_landmark(F.col("id"))).alias("b"))
    assert df.where("id <> b").count() == 0


def test_predicted_time_gives_its_vdot_back(spark):
    df = spark.range(40, 80).select(F.col("id").cast("double").alias("v"))
    back = vdot(F.lit(1500.0), predicted_seconds(F.col("v"), F.lit(1500.0)))
    assert df.where(F.abs(back - F.col("v")) > 1e-3).count() == 0


def stack_prune(rows, min_step, stride):
    """The pruning rules as a plain loop over a list."""
    out = []
    for c in sorted(rows):
        while out:
            p = out[-1]
            if max(c[2] - p[2], c[0] - p[0]) >= min_step:
                out.append(c)
                break
            if p[3] is None and c[3] is None:
                break
            if p[3] is None:
                out.append(c)
                break
            if c[3] is None:
                break
            if abs(p[3] - c[3]) < 5:
                anchor = next((x[2] for x in reversed(out[:-1]) if x[1] == p[1]), None)
                pop = p[1] == c[1] and anchor is not None and abs(p[2] - anchor - stride) > abs(c[2] - anchor - stride)
            else:
                pop = p[3] < c[3]
            if not pop:
                break
            out.pop()
        else:
            out.append(c)
    return out


def test_pruning_matches_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for clip in range(30):
        frames = np.unique(rng.integers(0, 200, 14))
        c = [(int(f), "LR"[int(rng.integers(2))], float(f) + float(rng.integers(0, 3)), None if rng.random() < 0.2 else float(rng.integers(0, 4) * 4)) for f in frames]
        rows += [(clip, x[1], x[0], x[2], x[3]) for x in c]
        want += [(clip, *x) for x in stack_prune(c, 12.0, 36.0)]
    df = spark.createDataFrame(rows, "clip_id long, leg string, frame long, ic double, foot_y double")
    got = [tuple(r) for r in contacts.pruned(df, 12.0, 36.0).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_documents_round_trip_and_missing_id_fails(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "video_id string, h double").select("video_id", F.struct(F.lit("r").alias("id"), F.col("h").alias("height_cm")).alias("runner"))
    metadata.save_documents(docs.repartition(2), str(tmp_path / "d"))
    back = metadata.store(metadata.load_documents(spark, str(tmp_path / "d") + "/*.json"))
    assert back.select("runner.height_cm").orderBy("height_cm").collect()[0][0] == 1.0
    with pytest.raises(Exception, match="no document"):
        metadata.lookup(spark.createDataFrame([("zz",)], "video_id string"), back).collect()


def test_streaming_sessions_match_batch(spark, tmp_path):
    from pacelake.streaming.sessions import tumbling

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").exceptAll(tumbling(e)).where("n > 0").selectExpr("start", "event_type", "n").count() <= 0 or spark.table("tumbled").count() == tumbling(e).count()
