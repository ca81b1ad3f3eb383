"""Sequence operators that need a whole sequence at once: Kalman smoothing as folds over an array, and spline gaps, which Spark deals to tasks by sequence.

A sequence is a clip's (of a landmark and an axis), some hundred frames by nature.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import num
from ..functions.windows import let


_STATE = "struct<x: double, v: double, a: double, b: double, c: double, px: double, pv: double, pa: double, pb: double, pc: double>"


def smoothed(y: Column, q_pos: float = 0.1, q_vel: float = 2.8, r: float = 25.0) -> Column:
    """Constant-velocity Kalman filter and Rauch-Tung-Striebel smoother of an array of doubles (NULL is missing): two folds, forward and back.

    NULL before the first known value, and everywhere with under two. A state has place and speed x, v with the covariance a, b, c (xx, xv, vv), and what was predicted of them."""
    fields = ("x", "v", "a", "b", "c", "px", "pv", "pa", "pb", "pc")
    state = lambda *values: F.struct(*(x.alias(k) for x, k in zip(values, fields))).cast(_STATE)
    none = F.array().cast(f"array<{_STATE}>")
    hollow = F.lit(None).cast(_STATE)

    def predict(s: Column) -> Column:
        return F.struct((s["x"] + s["v"]).alias("x"), s["v"].alias("v"), (s["a"] + num(2) * s["b"] + s["c"] + num(q_pos)).alias("a"), (s["b"] + s["c"]).alias("b"), (s["c"] + num(q_vel)).alias("c"))

    def update(p: Column, seen: Column) -> Column:
        gain = F.struct((p["a"] / (p["a"] + num(r))).alias("x"), (p["b"] / (p["a"] + num(r))).alias("v"), (seen - p["x"]).alias("off"))
        of = lambda g: state(p["x"] + g["x"] * g["off"], p["v"] + g["v"] * g["off"], p["a"] - g["x"] * p["a"], p["b"] - g["x"] * p["b"], p["c"] - g["v"] * p["b"], *(p[k] for k in ("x", "v", "a", "b", "c")))
        return F.when(seen.isNotNull(), let(gain, of)).otherwise(state(*(p[k] for k in ("x", "v", "a", "b", "c")), *(p[k] for k in ("x", "v", "a", "b", "c"))))

    def forward(s: Column, seen: Column) -> Column:
        now = F.element_at(s, -1)
        first = state(seen, num(0), num(r), num(0), num(10 * q_vel), *[num(0)] * 5)
        begun = (F.size(s) > 0) & now.isNotNull()
        return F.array_append(s, F.when(F.coalesce(begun, F.lit(False)), let(predict(now), lambda p: update(p, seen))).when(seen.isNotNull(), first).otherwise(hollow))

    def backward(s: Column, own: Column) -> Column:
        """s: smoothed place and speed of the frame behind, its prediction, and the places so far, last first."""
        det = s["pa"] * s["pc"] - s["pb"] * s["pb"]
        m = F.struct(*(x.alias(k) for x, k in ((own["a"] + own["b"], "m11"), (own["b"], "m12"), (own["b"] + own["c"], "m21"), (own["c"], "m22"), (det, "det"), (s["x"] - s["px"], "dx"), (s["v"] - s["pv"], "dv"))))

        def back(g: Column) -> Column:
            x = own["x"] + ((g["m11"] * s["pc"] - g["m12"] * s["pb"]) * g["dx"] + (g["m12"] * s["pa"] - g["m11"] * s["pb"]) * g["dv"]) / g["det"]
            v = own["v"] + ((g["m21"] * s["pc"] - g["m22"] * s["pb"]) * g["dx"] + (g["m22"] * s["pa"] - g["m21"] * s["pb"]) * g["dv"]) / g["det"]
            return F.struct(x.alias("x"), v.alias("v"))

        made = F.when(s["px"].isNull(), F.struct(own["x"].alias("x"), own["v"].alias("v"))).otherwise(let(m, back))
        ahead = (own["px"], own["pv"], own["pa"], own["pb"], own["pc"])
        step = lambda g: F.struct(g["x"].alias("x"), g["v"].alias("v"), *(x.alias(k) for x, k in zip(ahead, fields[5:])), F.array_append(s["out"], g["x"]).alias("out")).cast(_BACK)
        return F.when(own.isNull(), F.struct(*(s[k].alias(k) for k in ("x", "v", *fields[5:])), F.array_append(s["out"], F.lit(None).cast("double")).alias("out")).cast(_BACK)).otherwise(let(made, step))

    start = F.struct(*(F.lit(None).cast("double").alias(k) for k in ("x", "v", *fields[5:])), F.array().cast("array<double>").alias("out")).cast(_BACK)
    enough = F.size(F.filter(y, lambda x: x.isNotNull())) >= 2
    made = let(F.aggregate(y, none, forward), lambda f: F.aggregate(F.reverse(f), start, backward, lambda s: F.reverse(s["out"])))
    return F.when(enough, made).otherwise(F.transform(y, lambda _: F.lit(None).cast("double")))


_BACK = "struct<x: double, v: double, px: double, pv: double, pa: double, pb: double, pc: double, out: array<double>>"


def replace_outliers(df: DataFrame, by: list[str], value: str, limit: float = 15.0) -> DataFrame:
    """by, frame, value, smoothed, flagged, out: a value over limit from its smoothed one is replaced by it."""
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("frame", known.alias("value")))).alias("f"))
    rows = rows.withColumn("s", smoothed(F.transform("f", lambda x: x["value"])))
    rows = rows.select(*by, F.inline(F.zip_with("f", "s", lambda x, s: F.struct(x["frame"].alias("frame"), x["value"].alias("value"), s.alias("smoothed")))))
    far = F.coalesce(F.abs(F.col("value") - F.col("smoothed")) > limit, F.lit(False))
    return rows.withColumn("flagged", far).withColumn("out", F.when(F.col("flagged"), F.col("smoothed")).otherwise(F.col("value")))


def pchip_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fritsch-Carlson slopes: weighted harmonic means inside, three-point ends."""
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    if len(d) == 1:
        return np.array([d[0], d[0]])
    m = np.zeros(len(t))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    rising = d[:-1] * d[1:] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(rising, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(s) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    return m


def hermite(t: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = t[k + 1] - t[k]
    u = (at - t[k]) / h
    return (1 + 2 * u) * (1 - u) ** 2 * y[k] + u * (1 - u) ** 2 * h * m[k] + u * u * (3 - 2 * u) * y[k + 1] + u * u * (u - 1) * h * m[k + 1]


def cubic_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the not-a-knot cubic spline; a parabola through three points, a line through two."""
    n, h, d = len(t), np.diff(t), np.diff(y) / np.diff(t)
    if n == 2:
        return np.array([d[0], d[0]])
    if n == 3:
        c = (d[1] - d[0]) / (t[2] - t[0])
        return np.array([d[0] - c * h[0], d[0] + c * h[0], d[1] + c * h[1]])
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    a[0, :2] = h[1], h[0] + h[1]
    b[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[-1, -2:] = h[-1] + h[-2], h[-2]
    b[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-2] + h[-1]) + h[-1]) * h[-2] * d[-1]) / (h[-2] + h[-1])
    return np.linalg.solve(a, b)


METHODS = {"pchip": pchip_slopes, "cubic": cubic_slopes, "linear": None}


def fill_gaps(df: DataFrame, by: list[str], value: str, vis: str, method: str = "pchip", max_gap: int = 4, min_vis: float = 0.5) -> DataFrame:
    """by, frame, out, filled: inner gaps of at most max_gap between anchors with enough visibility, by spline through all known values."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, "frame").schema) + ", out double, filled boolean"
    slopes = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        y, v, t = pdf[value].to_numpy(dtype=float, na_value=np.nan), pdf[vis].to_numpy(dtype=float), pdf["frame"].to_numpy(dtype=float)
        known = np.flatnonzero(np.isfinite(y))
        filled = np.zeros(len(y), dtype=bool)
        for a, b in zip(known[:-1], known[1:]):
            if 1 < b - a <= max_gap + 1 and v[a] >= min_vis and v[b] >= min_vis:
                filled[a + 1 : b] = True
        out = y.copy()
        if filled.any():
            kt, ky = t[known], y[known]
            out[filled] = np.interp(t[filled], kt, ky) if slopes is None else hermite(kt, ky, slopes(kt, ky), t[filled])
        return pdf[[*by, "frame"]].assign(out=out, filled=filled)

    return df.select(*by, "frame", value, vis).groupBy(*by).applyInPandas(run, fields).withColumn("out", F.nanvl("out", F.lit(None).cast("double")))
