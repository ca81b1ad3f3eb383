"""Two passes (or sensors) of the same clips as two streams, met frame by frame (an extension: body.combine_two over tables is the reference point).

A frame is one row: clip_id, frame, at (timestamp) and points, an array of struct(lm, x, y, vis). Both streams have watermarks, and the two rows
of a frame are at most `within` apart, so what is kept of each stream is what the other may still meet: a frame whose
other side has not come by then goes out alone and is forgotten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import length_2d, num
from ..functions.windows import array_mean, let
from ..operators.body import HIP


def gathered(pose: DataFrame) -> DataFrame:
    """Landmark rows (clip_id, frame, at, lm, x, y, vis) as frames."""
    return pose.groupBy("clip_id", "frame", "at").agg(F.array_sort(F.collect_list(F.struct("lm", "x", "y", "vis"))).alias("points"))


def _hips(points: Column) -> tuple[Column, Column]:
    """Whether a hip has a place, and the mean visibility of both."""
    hips = F.filter(points, lambda p: p["lm"].isin(*HIP))
    return F.coalesce(F.exists(hips, lambda p: p["x"].isNotNull()), F.lit(False)), array_mean(F.transform(hips, lambda p: p["vis"]))


def combined_points(a: Column, b: Column, near: Column) -> Column:
    """Struct of chosen (avg, fwd, rev or none) and points, of the points of two passes (NULL for a pass that has not come).

    avg: the mean of both, where both have hips and lie within near pixels of each other on the average; else the one with the better hips, the first on a tie."""
    none = F.array().cast("array<struct<lm: int, x: double, y: double, vis: double>>")

    def of(s: Column) -> Column:
        pairs = F.zip_with(s["a"], s["b"], lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        apart = array_mean(F.transform(pairs, lambda z: length_2d(z["p"]["x"], z["p"]["y"], z["q"]["x"], z["q"]["y"])))
        (a_in, a_vis), (b_in, b_vis) = _hips(s["a"]), _hips(s["b"])
        better = F.when(F.bround(a_vis, 9) >= F.bround(b_vis, 9), "fwd").otherwise("rev")
        chosen = F.when(a_in & b_in, F.when(apart <= near, "avg").otherwise(better)).when(a_in, "fwd").when(b_in, "rev").otherwise("none")
        mean = lambda z, c: (z["p"][c] + z["q"][c]) / num(2)
        both = F.transform(pairs, lambda z: F.struct(z["p"]["lm"].alias("lm"), *(mean(z, c).alias(c) for c in ("x", "y")), F.coalesce(mean(z, "vis"), num(0)).alias("vis")))
        lost = lambda points: F.transform(points, lambda p: F.struct(p["lm"].alias("lm"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), num(0).alias("vis")))
        known = lambda points: F.transform(points, lambda p: F.struct(p["lm"].alias("lm"), p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["vis"], num(0)).alias("vis")))
        points = lambda c: F.when(c == "avg", both).when(c == "fwd", known(s["a"])).when(c == "rev", known(s["b"])).otherwise(lost(F.when(F.size(s["a"]) > 0, s["a"]).otherwise(s["b"])))
        return let(chosen, lambda c: F.struct(c.alias("chosen"), points(c).alias("points")))

    return let(F.struct(F.coalesce(a, none).alias("a"), F.coalesce(b, none).alias("b")), of)


def combined_stream(forward: DataFrame, reverse: DataFrame, height_px: float, late: str = "10 seconds", within: str = "5 seconds", share: float = 0.03) -> DataFrame:
    """clip_id, frame, at, complete (both passes have come), chosen, points of two streams of frames, or of two tables of them. The output mode is append."""
    a, b = (df.withWatermark("at", late) if df.isStreaming else df for df in (forward, reverse))
    a = a.select("clip_id", "frame", "at", "points").alias("a")
    b = b.select("clip_id", "frame", "at", "points").alias("b")
    c = F.col
    same = (c("a.clip_id") == c("b.clip_id")) & (c("a.frame") == c("b.frame"))
    span = F.expr(f"INTERVAL {within}")
    met = a.join(b, same & (c("a.at") >= c("b.at") - span) & (c("a.at") <= c("b.at") + span), "full_outer")
    either = lambda x: F.coalesce(c(f"a.{x}"), c(f"b.{x}")).alias(x)
    made = combined_points(c("a.points"), c("b.points"), num(share * height_px))
    complete = (c("a.frame").isNotNull() & c("b.frame").isNotNull()).alias("complete")
    return met.select(either("clip_id"), either("frame"), either("at"), complete, made.alias("made")).select("clip_id", "frame", "at", "complete", "made.chosen", "made.points")
