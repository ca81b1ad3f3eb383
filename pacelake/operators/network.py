"""From landmarks to the input of a network: canonical form, 17 keypoints, short gaps filled, centred and scaled.

Canonical form: the near side is the left one, and the runner goes from right to left. Landmarks: clip_id,
frame, lm, x, y, vis. Network rows: clip_id, frame, kp, x, y, vis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import num
from ..functions.windows import fill_short_gaps, let, nearest_points
from .body import SIDE_JOINTS, both, direction_of, of_points, side_columns, wide

#: The landmark of each network keypoint (0 to 16), around the body from the nose.
KEYPOINTS = (0, 15, 13, 11, 23, 25, 27, 29, 31, 32, 30, 28, 26, 24, 12, 14, 16)
NN_SHOULDER, NN_HIPS = 3, (4, 13)
LANDMARKS, LEAST_VIS, LEAST_TORSO, TORSO_OF_FRAME = 33, 0.5, 1e-6, 0.3


def orientation(pose: DataFrame) -> DataFrame:
    """Per clip: near_side (left or right), direction (LR or RL), is_canonical; from one pass over the landmarks."""
    return _turned(wide(pose, both(**SIDE_JOINTS), "x", "vis"))


def _turned(frames: DataFrame) -> DataFrame:
    """orientation of wide frames."""
    x = S.midpoint_both(F.col("l_hip_x"), F.col("r_hip_x"))
    means = [F.avg(f"{'lr'[k]}_{j}_vis").alias(f"m_{j}_{k}") for j in SIDE_JOINTS for k in (0, 1)]
    per = frames.groupBy("clip_id").agg(direction_of(x, F.col("frame")).alias("direction"), *means)
    near = side_columns(lambda j, k: F.col(f"m_{j}_{k}"))[2].alias("near_side")
    return per.select("clip_id", near, "direction").withColumn("is_canonical", (F.col("near_side") == "left") & (F.col("direction") == "RL"))


def canonical(pose: DataFrame, width: float) -> DataFrame:
    """The landmarks in canonical form, with swapped (left for right) and mirrored (x)."""
    turns = orientation(pose).select("clip_id", (F.col("near_side") == "right").alias("swapped"), (F.col("direction") == "LR").alias("mirrored"))
    lm = F.when(F.col("swapped"), S.swapped_landmark(F.col("lm"))).otherwise(F.col("lm"))
    x = F.when(F.col("mirrored"), S.mirrored_x(F.col("x"), width)).otherwise(F.col("x"))
    return pose.join(turns, "clip_id").select("clip_id", "frame", lm.cast("int").alias("lm"), x.alias("x"), "y", "vis", "swapped", "mirrored")


def _kp_of():
    return F.create_map(*(F.lit(v) for kp, lm in enumerate(KEYPOINTS) for v in (lm, kp)))


def keypoints(landmarks: DataFrame) -> DataFrame:
    """The 17 network keypoints of the landmarks; other landmarks go. The filter comes before anything else."""
    rows = landmarks.where(F.col("lm").isin(*KEYPOINTS))
    return rows.withColumn("lm", F.element_at(_kp_of(), F.col("lm").cast("int"))).withColumnRenamed("lm", "kp")


def landmarks_of(network: DataFrame) -> DataFrame:
    """All 33 landmarks of each frame: those of the keypoints, the rest unknown with visibility 0."""
    lm_of = F.array(*(F.lit(lm) for lm in KEYPOINTS))
    known = F.map_from_entries(F.collect_list(F.struct(F.element_at(lm_of, F.col("kp") + 1).alias("lm"), F.struct("x", "y", "vis").alias("p"))))
    rows = network.groupBy("clip_id", "frame").agg(known.alias("m")).select("clip_id", "frame", "m", F.explode(F.sequence(F.lit(0), F.lit(LANDMARKS - 1))).alias("lm"))
    p = F.try_element_at(F.col("m"), F.col("lm"))
    return rows.select("clip_id", "frame", "lm", p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["vis"], num(0)).alias("vis"))


def centred(network: DataFrame) -> DataFrame:
    """Positions from the clip's hip, in units of its torso (torso_px); other columns stay.

    The centre is the mean of the seen hips, else the median of all; the torso the median of the seen near one, else of
    any, else 0.3 of the lowest place, and at least 1e-6. The rows become frames and then clips, and are dealt
    out again: one pass."""
    l, r = NN_HIPS  # noqa: E741
    names = {"s": NN_SHOULDER, "l": l, "r": r}
    at = lambda n, f: F.max(F.when(F.col("kp") == names[n], F.col(f))).alias(f"{n}_{f}")
    rest = [x for x in network.columns if x not in ("clip_id", "frame")]
    f = network.groupBy("clip_id", "frame").agg(*(at(n, f) for n in names for f in ("x", "y", "vis")), F.max("y").alias("low"), F.collect_list(F.struct(*rest)).alias("points_"))
    c = F.col
    hx, hy, hv = S.midpoint_both(c("l_x"), c("r_x")), S.midpoint_both(c("l_y"), c("r_y")), F.least("l_vis", "r_vis")
    torso = S.length_2d(c("s_x"), c("s_y"), c("l_x"), c("l_y"))
    hips_seen = (hv >= LEAST_VIS) & hx.isNotNull() & hy.isNotNull()
    torso_seen = F.least(hv, c("s_vis")) >= LEAST_VIS
    seen = lambda v, ok: F.when(ok, v)
    length = F.coalesce(F.median(seen(torso, torso_seen)), F.median(torso), num(TORSO_OF_FRAME) * F.max("low"))
    per = f.groupBy("clip_id").agg(
        F.coalesce(F.avg(seen(hx, hips_seen)), F.median(hx)).alias("cx_"), F.coalesce(F.avg(seen(hy, hips_seen)), F.median(hy)).alias("cy_"), F.greatest(length, num(LEAST_TORSO)).alias("torso_px"),
        F.collect_list(F.struct("frame", "points_")).alias("frames_"),
    )
    out = per.select("clip_id", "torso_px", "cx_", "cy_", F.inline("frames_")).select("clip_id", "frame", "torso_px", "cx_", "cy_", F.inline("points_"))
    return out.withColumns({"x": (c("x") - c("cx_")) / c("torso_px"), "y": (c("y") - c("cy_")) / c("torso_px")}).drop("cx_", "cy_")


def preprocess(pose: DataFrame, width: float, max_gap: int = 3, discount: float = 0.8) -> DataFrame:
    """clip_id, frame, kp, x, y, vis, status (0 measured, 1 filled, 2 missing: at the hip with visibility 0), torso_px, swapped, mirrored."""
    c = F.col
    x, y = c("x"), c("y")
    valid = pose.select("clip_id", "frame", "lm", S.valid_or_null(x, x, y).alias("x"), S.valid_or_null(y, x, y).alias("y"), S.visibility_or_zero(c("vis"), x, y).alias("vis"))
    rows = keypoints(canonical(valid, width))
    # a place is known if both axes are
    both_known = x.isNotNull() & y.isNotNull()
    rows = rows.withColumns({"x": F.when(both_known, x), "y": F.when(both_known, y)})
    by = ["clip_id", "kp"]
    rows = fill_short_gaps(rows, by, "x", "vis", "fx", max_gap, discount, {"y": "fy"})
    out = centred(rows.select("clip_id", "frame", "kp", c("fx").alias("x"), c("fy").alias("y"), c("fx_vis").alias("vis"), "status", "swapped", "mirrored"))
    missing = c("status") == 2
    zero = lambda v: F.when(missing, num(0)).otherwise(c(v)).alias(v)
    return out.select("clip_id", "frame", "kp", zero("x"), zero("y"), zero("vis"), "status", "torso_px", "swapped", "mirrored")


def tensors(rows: DataFrame) -> DataFrame:
    """One row a clip: input, an array by frame of arrays by keypoint of x, y, vis; n_filled, n_missing."""
    point = F.struct("kp", F.array("x", "y", "vis").alias("p"))
    frames = rows.groupBy("clip_id", "frame").agg(F.array_sort(F.collect_list(point))["p"].alias("points"), F.count_if(F.col("status") == 1).alias("f"), F.count_if(F.col("status") == 2).alias("m"))
    return frames.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "points")))["points"].alias("input"), F.sum("f").alias("n_filled"), F.sum("m").alias("n_missing"))


def _filled(rows: DataFrame, max_gap: int, discount: float) -> DataFrame:
    """fill_short_gaps of each keypoint of points (structs of x, y, vis, status), in place."""
    # rows of each keypoint, for a gap that ends with the clip
    lengths = F.array(*(F.count(F.get("points", F.lit(kp))["status"]).over(W.partitionBy("clip_id")) for kp in range(len(KEYPOINTS))))
    rows, found, ends = nearest_points(rows.withColumn("lengths_", lengths), ["clip_id"], "points", max_gap)
    unknown = lambda p: p.isNotNull() & p["x"].isNull()
    none = F.lit(None).cast("double")

    def made(p: Column, e: Column, n: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (F.col("frame") - a["frame"]).cast("double") / (b["frame"] - a["frame"]).cast("double")
        at = lambda f: F.coalesce(a["p"][f] + (b["p"][f] - a["p"][f]) * t, a["p"][f], b["p"][f]).alias(f)
        fills = (F.coalesce(b["frame"], n) - F.coalesce(a["frame"], F.lit(-1)) - 1 <= max_gap) & (a.isNotNull() | b.isNotNull())
        new = F.struct(at("x"), at("y"), (num(discount) * F.least(a["p"]["vis"], b["p"]["vis"])).alias("vis"), F.lit(1).alias("status"))
        return F.when(fills, new).otherwise(F.struct(none.alias("x"), none.alias("y"), p["vis"].alias("vis"), F.lit(2).alias("status")))

    filled = F.transform("points", lambda p, i: F.when(unknown(p), let(ends(i), lambda e: made(p, e, F.get("lengths_", i)))).otherwise(p))
    return rows.withColumn("points", F.when(F.exists("points", unknown), filled).otherwise(F.col("points"))).drop(*found, "lengths_")


def input_rows(frames: DataFrame, width: float, keep: tuple[str, ...] = (), max_gap: int = 3, discount: float = 0.8) -> DataFrame:
    """tensors of preprocess, from frames with their points (see body.frames_of): clip_id, input, n_filled, n_missing, and the columns of keep, which are the same in all rows of a clip.

    Frames of a clip become its row where they lie; landmarks are not rows at any step."""
    c = F.col
    clean = lambda p, f: S.visibility_or_zero(p["vis"], p["x"], p["y"]) if f == "vis" else S.valid_or_null(p[f], p["x"], p["y"])
    joints = both(**SIDE_JOINTS)
    at = {name: F.get("points", F.lit(lm)) for name, lm in joints.items()}
    seen = F.exists(F.array(*(p.isNotNull() for p in at.values())), lambda x: x).alias("seen_")
    wide_ = frames.select("clip_id", "frame", seen, *(F.when(p.isNotNull(), clean(p, f)).alias(f"{name}_{f}") for name, p in at.items() for f in ("x", "vis")))
    sides = wide_.groupBy("clip_id").agg(F.max("seen_").alias("seen_")).where("seen_").select("clip_id")
    turns = _turned(wide_).join(sides.hint("shuffle_hash"), "clip_id").select("clip_id", (c("near_side") == "right").alias("swapped"), (c("direction") == "LR").alias("mirrored"))
    rows = frames.join(turns.hint("shuffle_hash"), "clip_id")

    def keypoint(lm: int) -> Column:
        other = lm if lm < 11 else lm + 1 if lm % 2 else lm - 1
        p = F.when(c("swapped"), F.get("points", F.lit(other))).otherwise(F.get("points", F.lit(lm)))
        x, y = clean(p, "x"), clean(p, "y")
        x = F.when(c("mirrored"), S.mirrored_x(x, width)).otherwise(x)
        both_known = x.isNotNull() & y.isNotNull()
        return F.when(p.isNotNull(), F.struct(F.when(both_known, x).alias("x"), F.when(both_known, y).alias("y"), clean(p, "vis").alias("vis"), F.lit(0).alias("status")))

    rows = _filled(rows.select("clip_id", "frame", *keep, F.array(*map(keypoint, KEYPOINTS)).alias("points")), max_gap, discount)
    rows = rows.select("clip_id", "frame", *keep, "points", *(v.alias(k) for k, v in of_points(c("points"), {"s": NN_SHOULDER, "l": NN_HIPS[0], "r": NN_HIPS[1]}, "x", "y", "vis").items()))
    hv = F.least("l_vis", "r_vis")
    count = lambda status: sum((F.coalesce((F.get("points", F.lit(kp))["status"] == status).cast("long"), F.lit(0)) for kp in range(len(KEYPOINTS))), F.lit(0))
    low = F.greatest(*(F.get("points", F.lit(kp))["y"] for kp in range(len(KEYPOINTS))))
    rows = rows.withColumns({"hx": S.midpoint_both(c("l_x"), c("r_x")), "hy": S.midpoint_both(c("l_y"), c("r_y")), "torso": S.length_2d(c("s_x"), c("s_y"), c("l_x"), c("l_y"))})
    hips_seen, torso_seen = (hv >= LEAST_VIS) & c("hx").isNotNull() & c("hy").isNotNull(), F.least(hv, c("s_vis")) >= LEAST_VIS
    rows = rows.select(
        "clip_id", *keep, "hx", "hy", "torso", F.when(hips_seen, c("hx")).alias("seen_hx"), F.when(hips_seen, c("hy")).alias("seen_hy"), F.when(torso_seen, c("torso")).alias("seen_torso"),
        low.alias("low"), count(1).alias("f"), count(2).alias("m"), F.struct("frame", "points").alias("one_"),
    )
    length = F.coalesce(F.median("seen_torso"), F.median("torso"), num(TORSO_OF_FRAME) * F.max("low"))
    per = rows.groupBy("clip_id").agg(
        F.coalesce(F.avg("seen_hx"), F.median("hx")).alias("cx_"), F.coalesce(F.avg("seen_hy"), F.median("hy")).alias("cy_"), F.greatest(length, num(LEAST_TORSO)).alias("torso_px"),
        F.sum("f").alias("n_filled"), F.sum("m").alias("n_missing"), *(F.first(k).alias(k) for k in keep), F.array_sort(F.collect_list("one_")).alias("frames_"),
    )
    value = lambda p: F.when(p["status"] == 2, F.array(num(0), num(0), num(0))).otherwise(F.array((p["x"] - c("cx_")) / c("torso_px"), (p["y"] - c("cy_")) / c("torso_px"), p["vis"]))
    tensor = F.transform("frames_", lambda f: F.transform(F.filter(f["points"], lambda p: p.isNotNull()), value))
    return per.select("clip_id", tensor.alias("input"), "n_filled", "n_missing", *keep)
