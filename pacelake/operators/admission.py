"""Which clips and frames are taken: rules over tables of clips, of frame statistics, and of landmarks.

Clips: clip_id, fps, n_frames, width, height, and what a rule names. NULL is an unknown value; it breaks no
rule but those that say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import num
from .body import ANKLE, EAR, HEEL, HIP, NOSE, SHOULDER, TOE, first_of_windows

#: Fixed values of the rules.
EXTENSIONS, MOST_MB, MOST_CLIPS, MOST_FRAMES = ("mp4", "mov", "m4v", "avi", "webm"), 500, 3, 300
LEAST_WIDTH, LEAST_HEIGHT, LEAST_FRAMES, TRAINING_FRAMES = 1280, 720, 90, 108
DARK, BRIGHT, LEAST_SECONDS, LEAST_UPLOAD_SECONDS, LEAST_FPS = 30, 240, 1.5, 1.0, 30
MARGIN_X, MARGIN_Y, CORE_VIS, LIMB_VIS = 0.05, 0.08, 0.5, 0.3
ELBOW, WRIST = (13, 14), (15, 16)


def _issues(**rules: Column) -> Column:
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


# frames -----------------------------------------------------------------------------------------------


def skip_of(fps: Column, target: float = 60) -> Column:
    """Every how manyth frame is read for the target rate."""
    return F.greatest(F.lit(1), F.floor(fps / num(target)).cast("int"))


def long_enough(n_frames: Column, fps: Column, least: float = LEAST_SECONDS) -> Column:
    return F.coalesce((fps > 0) & (n_frames / fps >= least), F.lit(False))


def decimated(frames: DataFrame, clips: DataFrame, target: float = 60) -> DataFrame:
    """The frames that are read at the target rate, numbered anew, with effective_fps. Clips of under 1.5 s, or of unknown length, have none (see rejected_clips)."""
    meta = clips.where(long_enough(F.col("n_frames"), F.col("fps"))).select("clip_id", "fps", skip_of(F.col("fps"), target).alias("skip"))
    out = frames.join(meta, "clip_id").where(F.col("frame") % F.col("skip") == 0)
    return out.withColumn("frame", F.floor(F.col("frame") / F.col("skip")).cast("long")).withColumn("effective_fps", F.col("fps") / F.col("skip")).drop("fps", "skip")


def rejected_clips(clips: DataFrame) -> DataFrame:
    """clip_id, reason, seconds: clips that decimated leaves out."""
    known = F.coalesce(F.col("fps") > 0, F.lit(False))
    reason = F.when(~known, "unknown frame rate").otherwise("too short")
    return clips.where(~long_enough(F.col("n_frames"), F.col("fps"))).select("clip_id", reason.alias("reason"), F.when(known, F.col("n_frames") / F.col("fps")).alias("seconds"))


def frame_window(frames: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Frames from first to before last, numbered from 0. The filter reaches the scan."""
    keep = F.col("frame") >= first
    return frames.where(keep if last is None else keep & (F.col("frame") < last)).withColumn("frame", F.col("frame") - first)


def in_source_order(fed: DataFrame) -> DataFrame:
    """Rows of a pass that was fed backwards, with frame as in the source: the last frame less the place in the feed (frame)."""
    last = F.max("frame").over(W.partitionBy("clip_id"))
    return fed.withColumn("frame", last - F.col("frame"))


def capped(frames: DataFrame, most: int = MOST_FRAMES) -> DataFrame:
    """The first frames of each clip; a filter, as frames are numbered from 0."""
    return frames.where(F.col("frame") < most)


def is_constant_rate(rate: Column, mean_rate: Column, expected: int) -> Column:
    """Whether a converted clip has the expected rate, both nominal and mean, after rounding (halves to even)."""
    return F.coalesce((F.bround(S.fraction(rate), 0) == expected) & (F.bround(S.fraction(mean_rate), 0) == expected), F.lit(False))


# clips ------------------------------------------------------------------------------------------------


def frame_quality(stats: DataFrame) -> DataFrame:
    """Per clip: n_frames, width and height (of its first frame), brightness, issues, valid. stats: clip_id, frame, width, height, brightness."""
    first = lambda c: F.min_by(c, "frame")
    per = stats.groupBy("clip_id").agg(
        F.count("*").alias("n_frames"), first("width").alias("width"), first("height").alias("height"), F.avg("brightness").alias("brightness"),
        ((F.min("width") != F.max("width")) | (F.min("height") != F.max("height"))).alias("changes"),
    )
    c = F.col
    issues = _issues(
        resolution=(c("width") < LEAST_WIDTH) | (c("height") < LEAST_HEIGHT), too_few_frames=c("n_frames") < LEAST_FRAMES, dimensions_change=c("changes"),
        too_dark=c("brightness") < DARK, overexposed=c("brightness") > BRIGHT,
    )
    return per.select("clip_id", "n_frames", "width", "height", "brightness", issues.alias("issues"), (F.size(issues) == 0).alias("valid"))


def clip_check(clips: DataFrame) -> DataFrame:
    """Adds accepted, and warnings: under a second is refused; long, slow or upright clips draw a warning. A clip of unknown rate has no duration, and is taken."""
    c = F.col
    seconds = F.when(c("fps") > 0, c("n_frames") / c("fps")).otherwise(num(0))
    short = F.coalesce((seconds > 0) & (seconds < LEAST_UPLOAD_SECONDS), F.lit(False))
    warnings = _issues(trimmed=c("n_frames") > MOST_FRAMES, low_frame_rate=(c("fps") > 0) & (c("fps") < LEAST_FPS), portrait=c("height") > c("width"))
    return clips.withColumns({"accepted": ~short, "warnings": F.when(short, F.array().cast("array<string>")).otherwise(warnings)})


def eligible(uploads: DataFrame, batch: str, order: str) -> DataFrame:
    """Adds upload_no and refusal (NULL if taken). Of each batch the first three uploads count; then extension and size decide. uploads: name, size_mb."""
    c = F.col
    number = F.row_number().over(W.partitionBy(batch).orderBy(order))
    extension = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"\.([^.]*)$", 1))
    out = uploads.withColumn("upload_no", number)
    return out.withColumn("refusal", F.when(c("upload_no") > MOST_CLIPS, "too_many").when(~extension.isin(*EXTENSIONS), "unsupported_format").when(c("size_mb") > MOST_MB, "too_large"))


def fit_for(usable_frames: Column) -> Column:
    """Struct: training and inference, by the number of usable frames."""
    return F.struct((usable_frames >= TRAINING_FRAMES).alias("training"), (usable_frames >= LEAST_FRAMES).alias("inference"))


# usable frames ----------------------------------------------------------------------------------------


def checked_landmarks(near_side: Column) -> tuple[Column, Column]:
    """Landmark numbers of the near head and trunk, and of the limbs of both sides."""
    side = lambda k: F.array(F.lit(NOSE), *(F.lit(pair[k]) for pair in (EAR, SHOULDER, HIP)))
    limbs = F.array(*(F.lit(x) for pair in (ELBOW, WRIST, ANKLE, HEEL, TOE) for x in pair))
    return F.when(near_side == "left", side(0)).otherwise(side(1)), limbs


def usable_frames(pose: DataFrame, sides: DataFrame, width: float, height: float) -> DataFrame:
    """clip_id, frame, usable: all near core landmarks seen with 0.5 and all limbs with 0.3, known, and inside the margins. sides: clip_id, footage_side.

    A landmark without a row is not seen."""
    core, limbs = checked_landmarks(F.col("footage_side"))
    rows = pose.join(sides.select("clip_id", "footage_side"), "clip_id")
    lm = F.col("lm")
    in_core = F.array_contains(core, lm)
    checked = in_core | F.array_contains(limbs, lm)
    mx, my = MARGIN_X * width, MARGIN_Y * height
    inside = F.col("x").between(mx, width - mx) & F.col("y").between(my, height - my)
    good = F.coalesce((F.col("vis") >= F.when(in_core, num(CORE_VIS)).otherwise(num(LIMB_VIS))) & inside, F.lit(False))
    n = 14  # four of the core and ten of the limbs
    return rows.groupBy("clip_id", "frame").agg((F.count_if(checked & good) == n).alias("usable"))


def first_uploads(uploads: DataFrame, batch: str, order: str, most: int = MOST_CLIPS) -> DataFrame:
    """The first uploads of each batch."""
    return first_of_windows(uploads, [batch], [F.col(order)], most)
