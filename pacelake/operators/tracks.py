"""The track of one body among several candidates a frame: edges by a band join, the best path by a fold over a clip's candidates.

candidates: clip_id, frame, cand, x (of the hip), vis (of the hips), area. An edge leads from a candidate to one of a later frame, at most
max_gap on, if the speed it means lies in the band. A path begins at 1, each edge adds its gain, and of equally good ones the first counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import num
from ..functions.windows import let


@dataclass(frozen=True)
class Band:
    """Which candidates and edges count: speeds in pixels a frame, the least visibility of the hips, frames that an edge may span."""

    low: float
    high: float
    max_gap: int = 3
    min_vis: float = 0.0


def _eligible(band: Band) -> Column:
    return F.col("x").isNotNull() & ~F.isnan("x") & (F.col("vis") >= band.min_vis)


def edges(candidates: DataFrame, band: Band) -> DataFrame:
    """clip_id, frame, cand, before (frame and cand where the edge begins), speed, vis and area of its end.

    Every candidate is sent to the frames that it may lead to, so the join is one of equal frames."""
    c = candidates.where(_eligible(band))
    sent = c.select("clip_id", F.struct("frame", "cand").alias("before"), F.col("x").alias("x_"), F.explode(F.sequence(F.lit(1), F.lit(band.max_gap))).alias("k"))
    sent = sent.select("clip_id", "before", "x_", "k", (F.col("before.frame") + F.col("k")).alias("frame"))
    speed = F.abs(F.col("x") - F.col("x_")) / F.col("k").cast("double")
    joined = c.join(sent, ["clip_id", "frame"]).withColumn("speed", speed)
    return joined.where(F.col("speed").between(band.low, band.high)).select("clip_id", "frame", "cand", "before", "speed", "vis", "area")


def unit_gain(band: Band) -> Column:
    """Every edge counts one: the longest path."""
    return num(1)


def composite_gain(weights: tuple[float, float, float]):
    """Of an edge: how near its speed is to the middle of the band, and visibility and area (as a share of the clip's largest) of its end, weighted."""

    def gain(band: Band) -> Column:
        middle, half = (band.low + band.high) / 2, max(1e-6, (band.high - band.low) / 2)
        near = F.least(num(1), F.greatest(num(0), num(1) - F.abs(F.col("speed") - num(middle)) / num(half)))
        return num(weights[0]) * near + num(weights[1]) * F.col("vis") + num(weights[2]) * (F.col("area") / F.col("most"))

    return gain


#: Ways to choose a track by name; composite needs weights of speed, visibility and area.
SELECTORS = {"velocity": lambda weights=None: unit_gain, "composite": composite_gain}

_NODE = "struct<frame: bigint, cand: int, score: double, before: struct<frame: bigint, cand: int>>"


def _best_path(nodes: Column, max_gap: int) -> Column:
    """Nodes of the best path, first to last, as structs of frame, cand, score (of the path so far), before. nodes: in order, each with its edges (before, gain) in order."""

    def score(ring: Column, node: Column) -> Column:
        start = F.struct(num(1).alias("score"), F.lit(None).cast("struct<frame: bigint, cand: int>").alias("before"))

        def better(best: Column, e: Column) -> Column:
            at = F.get(F.filter(ring, lambda r: (r["frame"] == e["before"]["frame"]) & (r["cand"] == e["before"]["cand"])), 0)
            total = at["score"] + e["gain"]
            return F.when(total > best["score"], F.struct(total.alias("score"), e["before"].alias("before"))).otherwise(best)

        return F.aggregate(node["edges"], start.cast("struct<score: double, before: struct<frame: bigint, cand: int>>"), better)

    def step(s: Column, node: Column) -> Column:
        made = let(score(s["ring"], node), lambda b: F.struct(node["frame"].alias("frame"), node["cand"].alias("cand"), b["score"].alias("score"), b["before"].alias("before")).cast(_NODE))
        # no edge reaches further back than max_gap frames
        ring = F.filter(s["ring"], lambda r: r["frame"] >= node["frame"] - max_gap)
        return let(made, lambda m: F.struct(F.array_append(ring, m).alias("ring"), F.array_append(s["all"], m).alias("all")))

    none = F.array().cast(f"array<{_NODE}>")
    scored = F.aggregate(nodes, F.struct(none.alias("ring"), none.alias("all")), step, lambda s: s["all"])

    def back(all_: Column) -> Column:
        top = F.aggregate(all_, F.lit(None).cast(_NODE), lambda s, n: F.when(s.isNull() | (n["score"] > s["score"]), n).otherwise(s))

        def follow(s: Column, n: Column) -> Column:
            wanted = (n["frame"] == s["next"]["frame"]) & (n["cand"] == s["next"]["cand"])
            return F.when(wanted, F.struct(n["before"].alias("next"), F.array_append(s["path"], n).alias("path"))).otherwise(s)

        begin = lambda t: F.struct(F.struct(t["frame"].alias("frame"), t["cand"].alias("cand")).alias("next"), none.alias("path")).cast(f"struct<next: struct<frame: bigint, cand: int>, path: array<{_NODE}>>")
        path = let(top, lambda t: F.when(t["score"] > 1.0, F.aggregate(F.reverse(all_), begin(t), follow, lambda s: F.reverse(s["path"]))))
        return F.coalesce(path, none)

    return let(scored, back)


def longest_track(candidates: DataFrame, band: Band, gain=unit_gain) -> DataFrame:
    """clip_id, frame, cand, score (what the node's edge has added; of the first one the whole path begins with 1) of each clip's best path; nothing for a clip without an edge."""
    c = candidates.select("clip_id", F.col("frame").cast("bigint").alias("frame"), F.col("cand").cast("int").alias("cand"), *(F.col(k).cast("double").alias(k) for k in ("x", "vis", "area")))
    most = c.groupBy("clip_id").agg(F.greatest(F.coalesce(F.max(F.nanvl("area", F.lit(None).cast("double"))), num(1)), num(1e-6)).alias("most"))
    e = edges(c, band).join(most, "clip_id")
    e = e.groupBy("clip_id", "frame", "cand").agg(F.array_sort(F.collect_list(F.struct("before", gain(band).alias("gain")))).alias("edges"))
    kind = "array<struct<before: struct<frame: bigint, cand: int>, gain: double>>"
    nodes = c.where(_eligible(band)).select("clip_id", "frame", "cand").join(e, ["clip_id", "frame", "cand"], "left")
    nodes = nodes.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "cand", F.coalesce("edges", F.array().cast(kind)).cast(kind).alias("edges")))).alias("nodes"))
    path = nodes.select("clip_id", _best_path(F.col("nodes"), band.max_gap).alias("p"))
    added = F.transform("p", lambda n, i: F.struct(n["frame"].alias("frame"), n["cand"].alias("cand"), (n["score"] - F.when(i > 0, F.get("p", i - 1)["score"]).otherwise(num(0))).alias("score")))
    return path.select("clip_id", F.inline(added))


def selection(candidates: DataFrame, band: Band, method: str = "velocity", weights: tuple[float, float, float] | None = None) -> DataFrame:
    """A row for each clip and frame that has candidates: clip_id, frame, cand (NULL where none is chosen), reason, n_eligible, vis, speed, area, score.

    reason: track_start, on_track, off_track, or no_valid_track for a clip without a track. vis and area are the chosen candidate's, else the largest."""
    track = longest_track(candidates, band, SELECTORS[method](weights))
    c = candidates.withColumns({"frame": F.col("frame").cast("bigint"), "cand": F.col("cand").cast("int")})
    frames = c.groupBy("clip_id", "frame").agg(F.count_if(F.col("vis") >= band.min_vis).alias("n_eligible"), F.max("vis").alias("most_vis"), F.max("area").alias("most_area"))
    chosen = track.join(c.select("clip_id", "frame", "cand", "x", "vis", "area"), ["clip_id", "frame", "cand"])
    rows = chosen.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "cand", "x", "vis", "area", "score"))).alias("t"))

    def of(t: Column) -> Column:
        def row(n: Column, i: Column) -> Column:
            before = F.get(t, i - 1)
            speed = F.when(i > 0, F.abs(n["x"] - before["x"]) / (n["frame"] - before["frame"]).cast("double"))
            return F.struct(*(n[k].alias(k) for k in ("frame", "cand", "vis", "area", "score")), speed.alias("speed"), F.when(i > 0, "on_track").otherwise("track_start").alias("why"))

        return F.transform(t, row)

    on = rows.select("clip_id", F.inline(of(F.col("t"))))
    tracked = rows.select("clip_id", F.lit(True).alias("tracked"))
    out = frames.join(on, ["clip_id", "frame"], "left").join(tracked, "clip_id", "left")
    seen = (F.col("n_eligible") > 0) | F.col("tracked").isNull()
    return out.select(
        "clip_id", "frame", "cand", F.coalesce("why", F.when(F.col("tracked"), "off_track").otherwise("no_valid_track")).alias("reason"), "n_eligible",
        F.coalesce("vis", F.when(seen, F.col("most_vis")).otherwise(num(0))).alias("vis"), "speed", F.coalesce("area", F.when(seen, F.col("most_area")).otherwise(num(0))).alias("area"), F.coalesce("score", num(0)).alias("score"),
    )


def track_and_rest(candidates: DataFrame, band: Band, gain=unit_gain) -> tuple[DataFrame, DataFrame]:
    """The candidates of longest_track, and the frames (clip_id, frame) of which none is in it."""
    track = longest_track(candidates, band, gain)
    return candidates.join(track.drop("score"), ["clip_id", "frame", "cand"], "left_semi"), candidates.select("clip_id", "frame").distinct().join(track, ["clip_id", "frame"], "left_anti")
