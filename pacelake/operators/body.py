"""Per-frame and per-clip operators on landmark tables: sides, quality, calibration, fusion, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import num
from ..functions.windows import array_mean, longest_run, rolling_max, velocity

#: Fixed landmark numbers.
NOSE = 0
EAR, SHOULDER, HIP, KNEE, ANKLE, HEEL, TOE = (7, 8), (11, 12), (23, 24), (25, 26), (27, 28), (29, 30), (31, 32)
#: Expected share of the body height, least and most.
PROPORTIONS = {"foot": (0.04, 0.07), "shank": (0.20, 0.26), "thigh": (0.23, 0.29), "torso": (0.28, 0.34), "head": (0.12, 0.16)}
SHOE_SOLES = {"racing_flat": 1.5, "super_shoe": 3.5, "track_spike": 1.0, "training_shoe": 2.5, "barefoot": 0.0}
#: The shoes of the form, each with its kind of sole and what it says of the strike; events and their metres.
SHOES = {
    "Track spike": ("track_spike", "track_spike"),
    "Trainer": ("training_shoe", "trainer"),
    "Super shoe": ("super_shoe", "super_shoe"),
    "Racing flat": ("racing_flat", "racing_flat"),
    "Barefoot": ("barefoot", None),
    "Other / unknown": (None, None),
}
PACES = {"Threshold": "threshold", "1500m": "1500m", "800m": "800m"}
EVENT_METRES = {"800 m": 800, "1500 m": 1500, "Mile": 1609, "3000 m": 3000, "3000 m steeplechase": 3000, "5000 m": 5000, "400 m": 400, "10000 m": 10000}
DEFAULT_SOLE_CM = 2.5
SEGMENT_SHARES = {"torso": (0.30, 0.20), "thigh": (0.245, 0.30), "shank": (0.246, 0.30)}
HEAD_FACTOR, FOOT_TO_SHANK = 1.40, 0.20


def _chosen(key: Column, values: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def sole_cm(shoe: Column) -> Column:
    """Thickness of the sole of a kind of shoe; without a kind, 2.5."""
    return F.coalesce(_chosen(shoe, SHOE_SOLES, "double"), num(DEFAULT_SOLE_CM))


def form_choices(shoe: Column, pace: Column, event: Column) -> Column:
    """What the words of the form stand for: struct of shoe_type, footwear (the strike's vote), pace_level, distance_m; NULL for other words."""
    return F.struct(
        _chosen(shoe, {k: v[0] for k, v in SHOES.items()}, "string").alias("shoe_type"), _chosen(shoe, {k: v[1] for k, v in SHOES.items()}, "string").alias("footwear"),
        _chosen(pace, PACES, "string").alias("pace_level"), _chosen(event, EVENT_METRES, "int").alias("distance_m"),
    )


def near_landmarks(side: Column) -> Column:
    """Struct of the landmark numbers (ear, shoulder, hip, knee, ankle) of a side, L or R."""
    return F.struct(*(F.when(side == "L", F.lit(pair[0])).otherwise(F.lit(pair[1])).alias(name) for name, pair in (("ear", EAR), ("shoulder", SHOULDER), ("hip", HIP), ("knee", KNEE), ("ankle", ANKLE))))


def wide(pose: DataFrame, landmarks: dict[str, int], *fields: str) -> DataFrame:
    """One row for each clip and frame, with name_field columns; landmarks are filtered before the pivot."""
    rows = pose.where(F.col("lm").isin(*landmarks.values()))
    return rows.groupBy("clip_id", "frame").agg(*(F.max(F.when(F.col("lm") == lm, F.col(f))).alias(f"{name}_{f}") for name, lm in landmarks.items() for f in fields))


def frames_of(pose: DataFrame, passes: tuple[str, ...] = ()) -> DataFrame:
    """A row for each clip and frame: clip_id, frame, and points, or a column of points for each of passes (pose then has a column pass).

    Points are an array by landmark, from 0, of structs of x, y, vis; NULL where the pose has no row of a landmark, and as a whole where it has none of the pass."""
    one = F.struct(F.col("lm").alias("lm"), F.struct(*(F.col(f).cast("double").alias(f) for f in ("x", "y", "vis"))).alias("p"))
    lists = {name: F.collect_list(F.when(F.col("pass") == name, one)) for name in passes} or {"points": F.collect_list(one)}
    rows = pose.groupBy("clip_id", "frame").agg(*(v.alias(name) for name, v in lists.items()))

    def dense(name: str) -> Column:
        last = F.array_max(F.transform(name, lambda r: r["lm"].cast("int")))
        return F.when(F.size(name) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.get(F.filter(name, lambda r: r["lm"] == i), 0)["p"]))

    return rows.select("clip_id", "frame", *(dense(name).alias(name) for name in lists))


def landmark_rows(frames: DataFrame, points: str = "points") -> DataFrame:
    """The landmarks of frames with points: clip_id, frame, lm, x, y, vis."""
    return frames.select("clip_id", "frame", F.posexplode(points).alias("lm", "p")).where("p is not null").select("clip_id", "frame", "lm", "p.x", "p.y", "p.vis")


def of_points(points: Column, landmarks: dict[str, int], *fields: str) -> dict[str, Column]:
    """The name_field columns of wide, from points."""
    return {f"{name}_{f}": F.get(points, F.lit(lm))[f] for name, lm in landmarks.items() for f in fields}


def known(p: Column) -> Column:
    """Of a point: both axes are known."""
    return p["x"].isNotNull() & p["y"].isNotNull()


def unseen(points: Column) -> Column:
    """The same landmarks with unknown places and visibility 0."""
    none = F.lit(None).cast("double")
    return F.transform(points, lambda p: F.when(p.isNotNull(), F.struct(none.alias("x"), none.alias("y"), num(0).alias("vis"))))


def both(**pairs: tuple[int, int]) -> dict[str, int]:
    return {f"{side}_{name}": lm for name, two in pairs.items() for side, lm in zip("lr", two)}


JOINTS = both(shoulder=SHOULDER, hip=HIP, knee=KNEE, ankle=ANKLE)


def segments(frames: DataFrame) -> DataFrame:
    """Adds torso, thigh, shank of each frame: torso between midpoints; thigh and shank the longer side. All joints are needed."""
    c = F.col
    seg = lambda a, b: S.length_2d(c(a + "_x"), c(a + "_y"), c(b + "_x"), c(b + "_y"))
    mid = lambda j, f: S.midpoint_both(c(f"l_{j}_{f}"), c(f"r_{j}_{f}"))
    torso = S.length_2d(mid("shoulder", "x"), mid("shoulder", "y"), mid("hip", "x"), mid("hip", "y"))
    return frames.withColumns({"torso": torso, "thigh": S.longer(seg("l_hip", "l_knee"), seg("r_hip", "r_knee")), "shank": S.longer(seg("l_knee", "l_ankle"), seg("r_knee", "r_ankle"))})


def anatomy_gate(frames: DataFrame, height: Column) -> DataFrame:
    """Adds anatomy_ok and anatomy_reason: joints in order from head to knee, and segment shares within tolerance."""
    mid = lambda j: S.midpoint_both(F.col(f"l_{j}_y"), F.col(f"r_{j}_y"))
    order = (F.col("nose_y") < mid("shoulder")) & (mid("shoulder") < mid("hip")) & (mid("hip") < mid("knee"))
    off = F.array_compact(F.array(*(F.when(F.abs(F.col(s) / height - num(share)) > num(share * tol), F.lit(s)) for s, (share, tol) in SEGMENT_SHARES.items())))
    known = order.isNotNull() & F.col("torso").isNotNull() & F.col("thigh").isNotNull() & F.col("shank").isNotNull()
    reason = F.when(~known, "missing").when(~order, "order").when(F.size(off) > 0, F.concat(F.lit("ratios:"), F.array_join(off, "+"))).otherwise("ok")
    return frames.withColumn("anatomy_reason", reason).withColumn("anatomy_ok", F.col("anatomy_reason") == "ok")


def motion_filter(frames: DataFrame, pixels_per_cm: Column, fps: float, min_ms: float = 0.5, window: int = 5) -> DataFrame:
    """frames: clip_id, frame, l_hip_x, r_hip_x. Adds hip_x, peak and reason; a rejected frame is to be masked, not deleted."""
    df = frames.withColumn("hip_x", S.midpoint_any(F.col("l_hip_x"), F.col("r_hip_x")))
    df = rolling_max(velocity(df, ["clip_id"], "hip_x", "moved"), ["clip_id"], "moved", "peak", window // 2)
    least = num(min_ms) * pixels_per_cm * num(100) / num(fps)
    reason = F.when(F.col("hip_x").isNull(), "no_detection").when(F.col("peak").isNull(), "no_velocity_context").when(F.col("peak") < least, "below_velocity_threshold").otherwise("moving")
    return df.withColumn("reason", reason)


def masked(pose: DataFrame, keep: DataFrame) -> DataFrame:
    """pose with x, y NULL and vis 0 on frames of keep whose ok is false."""
    df = pose.join(keep.select("clip_id", "frame", "ok"), ["clip_id", "frame"])
    return df.select("clip_id", "frame", "lm", F.when(F.col("ok"), F.col("x")).alias("x"), F.when(F.col("ok"), F.col("y")).alias("y"), F.when(F.col("ok"), F.col("vis")).otherwise(num(0)).alias("vis"))


def quality_aggs(hip: Column, ankle: Column, seen: Column) -> list[Column]:
    """Aggregates over frames: n_frames, n_detected, detection_rate, n_low, hip_vis, ankle_vis."""
    return [
        F.count("*").alias("n_frames"), F.count_if(seen).alias("n_detected"), (F.count_if(seen) / F.count("*")).alias("detection_rate"), F.count_if(hip < 0.5).alias("n_low"),
        F.avg(hip).alias("hip_vis"), F.avg(ankle).alias("ankle_vis"),
    ]


def quality(pose: DataFrame) -> DataFrame:
    """Per clip: frames, detected, rate, low-confidence frames (mean hip visibility under 0.5), mean hip and ankle visibility."""
    f = pose.groupBy("clip_id", "frame").agg(
        F.avg(F.when(F.col("lm").isin(*HIP), F.col("vis"))).alias("hip"), F.avg(F.when(F.col("lm").isin(*ANKLE), F.col("vis"))).alias("ankle"), F.max(F.when(F.col("lm").isin(*HIP), F.col("x").isNotNull())).alias("seen")
    )
    return f.groupBy("clip_id").agg(*quality_aggs(F.col("hip"), F.col("ankle"), F.col("seen")))


SIDE_JOINTS = {"shoulder": SHOULDER, "hip": HIP, "knee": KNEE, "ankle": ANKLE}


def side_columns(mean) -> list[Column]:
    """The three rules on the mean visibilities mean(joint, 0 for left or 1 for right): calibration (hip, knee, ankle, shoulder; L on a tie, with its share), footage (no knee; R on a tie), camera (L on a tie)."""
    score = lambda side, *but: F.bround(sum((F.coalesce(mean(j, side), num(0)) for j in SIDE_JOINTS if j not in but), num(0)), 9)
    left, right = score(0), score(1)
    total = left + right
    return [
        F.when(left >= right, "L").otherwise("R").alias("calibration_side"),
        F.when(total > 0, F.greatest(left, right) / total).otherwise(num(0.5)).alias("confidence"),
        F.when(left >= right, "left").otherwise("right").alias("camera_side"),
        F.when(score(0, "knee") > score(1, "knee"), "left").otherwise("right").alias("footage_side"),
    ]


def near_sides(pose: DataFrame) -> DataFrame:
    """clip_id and the near side by three rules (see side_columns)."""
    lms = [lm for pair in SIDE_JOINTS.values() for lm in pair]
    means = pose.where(F.col("lm").isin(*lms)).groupBy("clip_id").agg(*(F.avg(F.when(F.col("lm") == lm, F.col("vis"))).alias(f"m_{lm}") for lm in lms))
    return means.select("clip_id", *side_columns(lambda j, side: F.col(f"m_{SIDE_JOINTS[j][side]}")))


#: Visibility and sample count of each try of the calibration, strictest first.
LADDER = ((0.5, 10), (0.35, 5), (0.0, 3))


#: Ends of each measured segment, its least and most length, and the share of the visibility that its second end needs.
SEGMENTS = {"shank": ("ankle", "knee", 30, 500, 1.0), "thigh": ("knee", "hip", 30, 500, 1.0), "torso": ("hip", "shoulder", 30, 600, 1.0), "ear": ("shoulder", "ear", 10, 200, 0.8)}
CALIBRATED = both(ear=EAR, shoulder=SHOULDER, hip=HIP, knee=KNEE, ankle=ANKLE)


def gated_lengths() -> dict[str, Column]:
    """Columns of wide frames (names of CALIBRATED) that segment_aggs reads: the length of each segment where it is gated, for both sides and each try.

    A median works its argument out expression by expression, unless that is a column."""
    found = {}
    for side in "lr":
        c = lambda p, f, side=side: F.col(f"{side}_{p}_{f}")
        for i, (vis, _) in enumerate(LADDER):
            for name, (a, b, lo, hi, share) in SEGMENTS.items():
                n = S.length_2d(c(a, "x"), c(a, "y"), c(b, "x"), c(b, "y"))
                found[f"{side}_good_{name}_{i}"] = F.when((c(a, "vis") >= vis) & (c(b, "vis") >= vis * share) & (n > lo) & (n < hi), n)
    return found


def segment_aggs() -> list[Column]:
    """Aggregates over frames with the columns of gated_lengths: median and count of each gated segment, for both sides and each try."""
    aggs = []
    for side in "lr":
        for i, (_, least) in enumerate(LADDER):
            for name in SEGMENTS:
                good = F.col(f"{side}_good_{name}_{i}")
                aggs += [F.when(F.count(good) >= least, F.median(good)).alias(f"{side}_{name}_{i}"), F.count(good).alias(f"{side}_n_{name}_{i}")]
    return aggs


def segment_columns(near: Column) -> list[Column]:
    """From the columns of segment_aggs: tried, the segments of the near side (L or R) by the strictest try that finds all, and the least count n."""
    c = lambda n: F.when(near == "L", F.col("l_" + n)).otherwise(F.col("r_" + n))
    full = [F.greatest(*(c(f"{s}_{i}").isNull().cast("int") for s in SEGMENTS)) == 0 for i in range(len(LADDER))]

    def first(values) -> Column:
        out = F.lit(None)
        for ok, v in reversed(list(zip(full, values))):
            out = F.when(ok, v).otherwise(out)
        return out

    pick = lambda n: first(c(f"{n}_{i}") for i in range(len(LADDER)))
    return [first(F.lit(i) for i in range(len(LADDER))).cast("int").alias("tried"), *(pick(n).alias(n) for n in SEGMENTS), F.least(*(pick("n_" + n) for n in SEGMENTS)).alias("n")]


def measured_segments(pose: DataFrame, sides: DataFrame) -> DataFrame:
    """Per clip: medians of gated lengths of the near side and their counts, from the strictest try that finds all (its number: tried)."""
    m = wide(pose, CALIBRATED, "x", "y", "vis").withColumns(gated_lengths()).groupBy("clip_id").agg(*segment_aggs())
    return m.join(sides.select("clip_id", "calibration_side"), "clip_id").select("clip_id", *segment_columns(F.col("calibration_side")))


def calibration(measured: DataFrame, sides: DataFrame, height_cm: float, sole_cm: float) -> DataFrame:
    """Per clip: pixels_per_cm, the segments with the sole in the foot, warnings, confidence, leg_cm. NULL where a segment is missing."""
    out = calibrated(measured.join(sides.select("clip_id", "confidence"), "clip_id"), height_cm, sole_cm)
    return out.select("clip_id", "tried", "pixels_per_cm", "height_px", "shank", "thigh", "torso", "head", "foot", "warnings", "confidence", "leg_cm")


def calibrated(m: DataFrame, height_cm: float, sole_cm: float) -> DataFrame:
    """calibration of rows that have the measured segments, n and confidence; other columns stay."""
    c = F.col
    m = m.withColumns({"head": c("ear") * num(HEAD_FACTOR), "bare_foot": c("shank") * num(FOOT_TO_SHANK)})
    bare = c("shank") + c("thigh") + c("torso") + c("head") + c("bare_foot")
    m = m.withColumn("foot", c("bare_foot") + num(sole_cm) * bare / num(height_cm - sole_cm))
    m = m.withColumn("height_px", S.total_height_px(c("foot"), c("shank"), c("thigh"), c("torso"), c("head")))
    share = S.proportions(c("foot"), c("shank"), c("thigh"), c("torso"), c("head"))
    warnings = F.array_compact(F.array(*(F.when((share[s] < lo) | (share[s] > hi), F.lit(s)) for s, (lo, hi) in PROPORTIONS.items())))
    m = m.withColumn("warnings", warnings)
    trust = F.least(num(1), c("n") / num(50)) * F.greatest(num(0.5), num(1) - F.size("warnings") * num(0.15)) * F.least(num(1), c("confidence") / num(0.6))
    m = m.withColumns({"pixels_per_cm": c("height_px") / num(height_cm), "confidence": F.when(c("height_px").isNotNull(), trust), "warnings": F.array_join("warnings", "+")})
    return m.withColumn("leg_cm", S.px_to_cm(S.leg_length_px(c("foot"), c("shank"), c("thigh")), c("pixels_per_cm"))).drop("bare_foot")


def combine_two(a: DataFrame, b: DataFrame, height: Column | float | DataFrame, share: float = 0.03) -> DataFrame:
    """Two passes of one clip, frame by frame: their mean where both are and near each other; else the one with the better hips (the first on a tie).

    height: of the body in pixels, or a table of clip_id and height_px; a clip without one has nothing near."""
    longest = lambda d: d.groupBy("clip_id").agg(F.max("frame").alias("last"))
    upto = longest(a).join(longest(b).withColumnRenamed("last", "last_b"), "clip_id").select("clip_id", F.least("last", "last_b").alias("last"))
    pair = a.join(b.select("clip_id", "frame", "lm", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("vis").alias("bvis")), ["clip_id", "frame", "lm"])
    pair = pair.join(upto, "clip_id").where("frame <= last")
    hip = F.col("lm").isin(*HIP)
    f = pair.groupBy("clip_id", "frame").agg(
        F.avg(S.length_2d(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).alias("apart"),
        F.max(F.when(hip, F.col("x").isNotNull())).alias("a_in"),
        F.max(F.when(hip, F.col("bx").isNotNull())).alias("b_in"),
        F.avg(F.when(hip, F.col("vis"))).alias("a_vis"),
        F.avg(F.when(hip, F.col("bvis"))).alias("b_vis"),
    )
    if isinstance(height, DataFrame):
        f, height = f.join(height.select("clip_id", "height_px"), "clip_id", "left"), F.col("height_px")
    near = num(share) * (height if isinstance(height, Column) else num(height))
    chosen = F.when(F.col("a_in") & F.col("b_in"), F.when(F.col("apart") <= near, "avg").when(F.bround("a_vis", 9) >= F.bround("b_vis", 9), "fwd").otherwise("rev")).when(F.col("a_in"), "fwd").when(F.col("b_in"), "rev").otherwise("none")
    f = f.select("clip_id", "frame", chosen.alias("chosen"))
    mix = lambda p, q: F.when(F.col("chosen") == "avg", (F.col(p) + F.col(q)) / num(2)).when(F.col("chosen") == "fwd", F.col(p)).when(F.col("chosen") == "rev", F.col(q))
    return pair.join(f, ["clip_id", "frame"]).select("clip_id", "frame", "lm", "chosen", mix("x", "bx").alias("x"), mix("y", "by").alias("y"), F.coalesce(mix("vis", "bvis"), num(0)).alias("vis"))


def chosen_of_two(a: Column, b: Column, height: Column, share: float = 0.03) -> Column:
    """What combine_two chooses for a frame (avg, fwd, rev, none), from the points of both passes."""
    apart = array_mean(F.zip_with(a, b, lambda p, q: S.length_2d(p["x"], p["y"], q["x"], q["y"])))
    pairs = [(F.get(a, F.lit(lm)), F.get(b, F.lit(lm))) for lm in HIP]
    in_ = lambda n: F.greatest(*(F.when(p[0].isNotNull() & p[1].isNotNull(), p[n]["x"].isNotNull()) for p in pairs))
    vis = lambda n: F.bround(S.midpoint_any(*(F.when(p[0].isNotNull() & p[1].isNotNull(), p[n]["vis"]) for p in pairs)), 9)
    return F.when(in_(0) & in_(1), F.when(apart <= num(share) * height, "avg").when(vis(0) >= vis(1), "fwd").otherwise("rev")).when(in_(0), "fwd").when(in_(1), "rev").otherwise("none")


def mixed(chosen: Column, p: Column, q: Column) -> Column:
    """A point of two passes by what is chosen for its frame; NULL unless both passes have it."""
    mix = lambda f: F.when(chosen == "avg", (p[f] + q[f]) / num(2)).when(chosen == "fwd", p[f]).when(chosen == "rev", q[f])
    return F.when(p.isNotNull() & q.isNotNull(), F.struct(mix("x").alias("x"), mix("y").alias("y"), F.coalesce(mix("vis"), num(0)).alias("vis")))


def choose_three(scores: DataFrame) -> DataFrame:
    """scores: clip_id, frame, pass_no, pass, ok, hip_vis. The pass with the best hips among anatomically right ones; of equals, the first."""
    ok = scores.where(F.col("ok") & F.col("hip_vis").isNotNull())
    return ok.groupBy("clip_id", "frame").agg(F.max_by("pass", F.struct(F.bround("hip_vis", 9), -F.col("pass_no"))).alias("chosen"))


def pass_scores(passes: DataFrame, anchors: DataFrame) -> DataFrame:
    """The scores that choose_three takes. passes: clip_id, frame, pass (fwd, rev, seed_bwd, seed_fwd), ok, hip_vis; anchors: clip_id, anchor.

    Up to the anchor the seed is the pass that ran back from it, after it the one that ran on. A frame of the
    forward pass stays even where no pass is right."""
    rows = passes.join(anchors, "clip_id", "left")
    seed = F.when(F.col("frame") <= F.coalesce("anchor", F.lit(0)), "seed_bwd").otherwise("seed_fwd")
    rows = rows.where(F.col("pass").isin("fwd", "rev") | (F.col("pass") == seed))
    return rows.withColumn("pass_no", F.when(F.col("pass") == "fwd", 1).when(F.col("pass") == "rev", 2).otherwise(3)).drop("anchor")


def combined_pose(landmarks: DataFrame, scores: DataFrame) -> DataFrame:
    """clip_id, frame, lm, chosen, x, y, vis: of each frame the landmarks of the chosen pass; where none is right, chosen is none, and places are unknown with visibility 0.

    landmarks: clip_id, frame, pass, lm, x, y, vis. Frames are those of the scores."""
    pick = choose_three(scores)
    frames = scores.select("clip_id", "frame").distinct().join(pick, ["clip_id", "frame"], "left").withColumn("chosen", F.coalesce("chosen", F.lit("none")))
    rows = landmarks.join(frames, ["clip_id", "frame"])
    mine, none = F.col("pass") == F.col("chosen"), F.col("chosen") == "none"
    take = lambda c: F.max(F.when(mine, F.col(c)))
    out = rows.where(mine | none).groupBy("clip_id", "frame", "lm", "chosen").agg(take("x").alias("x"), take("y").alias("y"), take("vis").alias("vis"))
    return out.withColumn("vis", F.coalesce("vis", num(0)))


def reason_counts(frames: DataFrame, reason: str) -> DataFrame:
    """Frames of each clip by reason: clip_id, reason, n, share of the clip."""
    n = frames.groupBy("clip_id", F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("clip_id")))


def joined_sensors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two sensors by clip and frame; clips whose numbers of frames differ are an error. a and b: clip_id, frame, and columns of their own."""
    length = lambda d, name: d.groupBy("clip_id").agg(F.count_distinct("frame").alias(name))
    both_ = length(a, "na").join(length(b, "nb"), "clip_id", "full")
    text = F.format_string("clip %s: the sensors have %s and %s frames", F.col("clip_id").cast("string"), F.coalesce(F.col("na").cast("string"), F.lit("no")), F.coalesce(F.col("nb").cast("string"), F.lit("no")))
    fine = both_.withColumn("fine_", F.when(F.col("na").eqNullSafe(F.col("nb")), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
    return a.join(b, ["clip_id", "frame"]).join(fine.where("fine_").select("clip_id"), "clip_id")


def direction_of(x: Column, frame: Column) -> Column:
    """Aggregate over frames: LR if the slope of the middle of the hips is positive, of 10 known frames or more; else RL."""
    return F.when((F.count(x) >= 10) & (F.bround(F.regr_slope(x, frame.cast("double")), 9) > 0), "LR").otherwise("RL")


def directions(frames: DataFrame) -> DataFrame:
    """Per clip: slope of the mid hip over the frames; left to right if positive; under 10 frames, right to left."""
    x = S.midpoint_both(F.col("l_hip_x"), F.col("r_hip_x"))
    seen = frames.select("clip_id", "frame", x.alias("x")).where("x is not null")
    return seen.groupBy("clip_id").agg(F.regr_slope("x", F.col("frame").cast("double")).alias("slope"), F.count("*").alias("n"), direction_of(F.col("x"), F.col("frame")).alias("direction"))


def bounding_area(pose: DataFrame) -> DataFrame:
    return pose.groupBy("clip_id", "frame").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))


def windowed_index(df: DataFrame, length: int = 120, least: int = 108) -> DataFrame:
    """Source frame of each of length output frames: too short is rejected, short is padded at both ends, long is cut around the middle."""
    n = df.groupBy("clip_id").agg(F.count("*").cast("int").alias("n"))
    n = n.withColumn("status", F.when(F.col("n") < least, "rejected").when(F.col("n") < length, "padded").otherwise("cropped"))
    out = n.where("status <> 'rejected'").select("clip_id", "n", "status", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    padded = F.least(F.greatest(F.col("i") - F.floor((F.lit(length) - F.col("n")) / 2), F.lit(0)), F.col("n") - 1)
    cropped = F.col("i") + F.floor((F.col("n") - F.lit(length)) / 2)
    return out.select("clip_id", "status", "i", F.when(F.col("status") == "padded", padded).otherwise(cropped).cast("long").alias("frame"))


def brought_to_length(pose: DataFrame, frames: DataFrame, length: int = 120, least: int = 108) -> DataFrame:
    """The rows of pose at the frames of windowed_index, with i (the frame there) and status. frames: a row for each frame of a clip.

    Each row works out where it goes from the number of its clip's frames. The table that is joined has a row a clip; a table of all output
    frames, made from so few rows, Spark would take for small and send through the driver."""
    n = frames.groupBy("clip_id").agg(F.count("*").cast("int").alias("n_")).where(F.col("n_") >= least)
    n = n.withColumn("status", F.when(F.col("n_") < length, "padded").otherwise("cropped"))
    shift = F.floor((F.lit(length) - F.col("n_")) / 2)  # of a long clip below zero
    at, cropped = F.col("frame") + F.when(F.col("status") == "padded", shift).otherwise(-F.floor((F.col("n_") - F.lit(length)) / 2)), F.col("status") == "cropped"
    first = F.when(cropped | (F.col("frame") > 0), at).otherwise(F.lit(0))
    last = F.when(cropped | (F.col("frame") < F.col("n_") - 1), at).otherwise(F.lit(length - 1))
    inside = (F.col("frame") >= 0) & (F.col("frame") < F.col("n_")) & (at >= 0) & (at < length)
    # a hash join leaves the rows of a clip where they lie
    rows = pose.join(n.hint("shuffle_hash"), "clip_id").where(inside)
    return rows.withColumn("i", F.explode(F.sequence(first, last))).drop("n_")


def first_of_windows(df: DataFrame, by: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("rank_", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank_") <= most).drop("rank_")


def likeliest_candidate(candidates: DataFrame, body: int = 17) -> DataFrame:
    """Of each frame's candidates the one with the highest mean score over the body's keypoints; of equals, the first. candidates: clip_id, frame, cand, kp, score."""
    means = candidates.where(F.col("kp") < body).groupBy("clip_id", "frame", "cand").agg(F.avg("score").alias("mean"))
    return means.groupBy("clip_id", "frame").agg(F.max_by("cand", F.struct(F.bround("mean", 9), -F.col("cand"))).alias("cand"))


def anchor_frames(seen: DataFrame, present: float = 0.3, reach: int = 5) -> DataFrame:
    """clip_id, anchor: the frame to seed a clip from. seen: clip_id, frame (from 0), quality of the near hip.

    The middle between the first and last present frame of the clip's middle 60 %, else its best frame. If
    that one is not present: the best frame around the middle of the longest present run."""
    df = seen.withColumn("n", F.count("*").over(W.partitionBy("clip_id")))
    lo, hi = F.floor(num(0.2) * F.col("n")), F.floor(num(0.8) * F.col("n"))
    inside = (F.col("frame") >= lo) & (F.col("frame") < hi)
    found = F.when(inside & (F.col("quality") >= present), F.col("frame"))
    best = lambda where: F.max_by("frame", F.when(where, F.struct("quality", -F.col("frame"))))
    per = df.groupBy("clip_id", "n").agg(F.min(found).alias("a"), F.max(found).alias("b"), best(inside).alias("best"))
    first = F.when(lo >= hi, F.floor(F.col("n") / 2)).when(F.col("a").isNotNull(), lo + F.floor((F.col("a") + F.col("b") - lo - lo) / 2)).otherwise(F.col("best"))
    run = longest_run(seen, ["clip_id"], F.col("quality") >= present).select("clip_id", (F.col("start") + F.floor(F.col("length") / 2)).alias("mid"))
    both_ = seen.join(per.select("clip_id", first.alias("first")), "clip_id").join(run, "clip_id", "left")
    out = both_.groupBy("clip_id", "first", "mid").agg(F.max(F.when(F.col("frame") == F.col("first"), F.col("quality"))).alias("q"), best(F.col("frame").between(F.col("mid") - reach, F.col("mid") + reach)).alias("again"))
    return out.select("clip_id", F.when((F.col("q") < present) & F.col("mid").isNotNull(), F.col("again")).otherwise(F.col("first")).alias("anchor"))
