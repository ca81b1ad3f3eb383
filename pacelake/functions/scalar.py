"""Scalar functions over columns: gait arithmetic, clock strings, running models, labels.

Every function takes and returns columns, so it works in any select, filter or aggregate. A missing
value is NULL; NaN never comes in (see sources.series).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published running models: oxygen cost (v in m/min), sustainable share (t in min), threshold share.
VO2_A, VO2_B, VO2_C = 0.000104, 0.182258, -4.60
PCT_BASE, PCT_K1, PCT_E1, PCT_K2, PCT_E2 = 0.8, 0.1894393, -0.012778, 0.2989558, -0.1932605
PCT_THRESHOLD = 0.86
LONG_EVENT_M = 3000.0
PROFILE_ENDURANCE_MAX, PROFILE_SPEED_MIN = 1.04, 1.08

#: Share of the body height of torso, of leg; the position of each pace in the trained range.
TORSO_TO_HEIGHT, TORSO_TO_LEG = 0.26, 0.49
PACE_POSITION = {"threshold": 0.33, "1500m": 0.55, "800m": 0.78}
MIN_STEP_FLOOR = 10.0


def num(x: float) -> Column:
    return F.lit(float(x))


# positions -----------------------------------------------------------------------------------------


def midpoint_any(left: Column, right: Column) -> Column:
    """Mean of what is there: one side suffices."""
    return F.coalesce((left + right) / num(2), left, right)


def midpoint_both(left: Column, right: Column) -> Column:
    return (left + right) / num(2)


def length_2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def longer(a: Column, b: Column) -> Column:
    """The larger of two, NULL unless both are there (greatest alone skips NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def mirrored_x(x: Column, width: Column | float) -> Column:
    return (width if isinstance(width, Column) else num(width)) - x


def swapped_landmark(lm: Column) -> Column:
    """Left for right and back, for the body pairs 11 to 32; the face keeps its numbers."""
    return F.when(lm >= 11, F.when(lm % 2 == 1, lm + 1).otherwise(lm - 1)).otherwise(lm)


def valid_or_null(value: Column, x: Column, y: Column, threshold: float = 1e-6) -> Column:
    """NULL where both coordinates are practically zero, the sentinel of a missing point."""
    return F.when((F.abs(x) < threshold) & (F.abs(y) < threshold), None).otherwise(value)


def visibility_or_zero(vis: Column, x: Column, y: Column, threshold: float = 1e-6) -> Column:
    return F.when((F.abs(x) < threshold) & (F.abs(y) < threshold), num(0)).otherwise(vis)


# units ---------------------------------------------------------------------------------------------


def px_to_cm(px: Column, px_per_cm: Column) -> Column:
    return px / px_per_cm


def px_to_m(px: Column, px_per_cm: Column) -> Column:
    return px / px_per_cm / num(100)


def px_to_leg_ratio(px: Column, leg_px: Column) -> Column:
    return px / leg_px


def total_height_px(foot: Column, shank: Column, thigh: Column, torso: Column, head: Column) -> Column:
    return foot + shank + thigh + torso + head


def leg_length_px(foot: Column, shank: Column, thigh: Column) -> Column:
    """Hip to ground."""
    return foot + shank + thigh


def proportions(foot: Column, shank: Column, thigh: Column, torso: Column, head: Column) -> Column:
    """Map of each segment's share of the whole height."""
    total = total_height_px(foot, shank, thigh, torso, head)
    pairs = {"foot": foot, "shank": shank, "thigh": thigh, "torso": torso, "head": head}
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v / total)))


def scaled(value: Column, ratio: Column | float) -> Column:
    return value * (ratio if isinstance(ratio, Column) else num(ratio))


def torso_to_height(value: Column) -> Column:
    """From units of the torso to units of the body's height."""
    return value * num(TORSO_TO_HEIGHT)


def torso_to_leg(value: Column) -> Column:
    return value * num(TORSO_TO_LEG)


def torso_to_m(value: Column, torso_px: Column, px_per_m: Column) -> Column:
    return value * torso_px / px_per_m


# gait arithmetic -----------------------------------------------------------------------------------


def flight_time_ms(cadence: Column, gct: Column) -> Column:
    """What is left of a step after contact; NULL if negative."""
    flight = num(60000) / cadence - gct
    return F.when(flight >= 0, flight)


def duty_factor(gct: Column, flight: Column) -> Column:
    total = gct + flight
    return F.when(total > 0, gct / total)


def velocity_ms(stride_m: Column, cadence: Column) -> Column:
    return stride_m * cadence / num(2) / num(60)


def pace_min_km(velocity: Column) -> Column:
    """m:ss for a kilometre, seconds cut off."""
    seconds = F.when(velocity > 0, num(1000) / velocity)
    minutes = F.floor(seconds / num(60))
    return F.format_string("%d:%02d", minutes, F.floor(seconds - minutes * num(60)))


def running_economy_index(oscillation_cm: Column, stride_m: Column) -> Column:
    return oscillation_cm / (stride_m * num(100)) * num(100)


def flight_ratio(gct: Column, flight: Column) -> Column:
    return F.when(gct + flight > 0, flight / (gct + flight))


def expected_cadence(velocity: Column, leg_m: Column) -> Column:
    """Steps a minute at a speed for a leg length: 60 v over leg * (1.4 + 0.1 v)."""
    return F.when((velocity > 0) & (leg_m > 0), num(60) * velocity / (leg_m * (num(1.4) + num(0.1) * velocity)))


def cadence_band(velocity: Column, leg_m: Column, band: float = 0.25) -> Column:
    c = expected_cadence(velocity, leg_m)
    return F.struct((c * num(1 - band)).alias("low"), c.alias("mid"), (c * num(1 + band)).alias("high"))


def min_step_frames(velocity: Column, leg_m: Column, fps: Column, band: float = 0.25) -> Column:
    fast = expected_cadence(velocity, leg_m) * num(1 + band)
    return F.when(fast.isNotNull(), F.greatest(num(MIN_STEP_FLOOR), num(60) * fps / fast))


# clocks --------------------------------------------------------------------------------------------


def parse_seconds(text: Column) -> Column:
    """Seconds of s, m:s or h:m:s; NULL for anything else or a negative part."""
    t = F.trim(text)
    parts = F.transform(F.split(t, ":"), lambda p: F.trim(p).try_cast("double"))
    good = (t != "") & (F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0))
    return F.when(good, F.aggregate(parts, num(0), lambda s, p: s * num(60) + p))


def format_clock(seconds: Column) -> Column:
    minutes = F.floor(seconds / num(60))
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%d:%04.1f", minutes, seconds - minutes * num(60)))


def format_pace(seconds: Column) -> Column:
    """m:ss/km; halves go to the even second, and a full minute is carried."""
    whole = F.bround(seconds, 0).cast("long")
    return F.format_string("%d:%02d/km", F.floor(whole / 60), whole % 60)


# running models ------------------------------------------------------------------------------------


def vo2(v: Column) -> Column:
    return num(VO2_C) + num(VO2_B) * v + num(VO2_A) * v * v


def velocity_for_vo2(x: Column) -> Column:
    """Positive root of the oxygen cost."""
    return (num(-VO2_B) + F.sqrt(num(VO2_B * VO2_B) - num(4 * VO2_A) * (num(VO2_C) - x))) / num(2 * VO2_A)


def sustainable_share(minutes: Column) -> Column:
    return num(PCT_BASE) + num(PCT_K1) * F.exp(num(PCT_E1) * minutes) + num(PCT_K2) * F.exp(num(PCT_E2) * minutes)


def vdot(distance_m: Column, seconds: Column) -> Column:
    minutes = seconds / num(60)
    return F.when((distance_m > 0) & (seconds > 0), vo2(distance_m / minutes) / sustainable_share(minutes))


def threshold_velocity(v: Column) -> Column:
    return velocity_for_vo2(v * num(PCT_THRESHOLD))


def riegel_exponent(d1: Column, t1: Column, d2: Column, t2: Column) -> Column:
    """NULL for equal distances."""
    return F.when(d1 != d2, F.ln(t2 / t1) / F.ln(d2 / d1))


def runner_profile(exponent: Column) -> Column:
    return F.when(exponent <= PROFILE_ENDURANCE_MAX, "Endurance-leaning").when(exponent >= PROFILE_SPEED_MIN, "Speed-leaning").when(exponent.isNotNull(), "Balanced")


def predicted_seconds(v: Column, distance_m: Column) -> Column:
    """Race time for a VDOT: a fixed point from 350 m/min, up to 50 steps, still once within 1e-7 minutes."""

    def step(s: Column, _: Column) -> Column:
        t = distance_m / velocity_for_vo2(v * sustainable_share(s["t"]))
        return F.struct(F.when(s["done"], s["t"]).otherwise(t).alias("t"), (s["done"] | (F.abs(t - s["t"]) < 1e-7)).alias("done"))

    seed = F.struct((distance_m / num(350)).alias("t"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), seed, step, lambda s: s["t"] * num(60))


# labels --------------------------------------------------------------------------------------------


def pace_position(level: Column) -> Column:
    """Position of a named pace; an unknown name is an error."""
    out = F.raise_error(F.concat(F.lit("unknown pace level: "), level)).cast("double")
    for name, x in PACE_POSITION.items():
        out = F.when(F.lower(F.trim(level)) == name, num(x)).otherwise(out)
    return out


def band3(value: Column, good: float = 0.7, ok: float = 0.4) -> Column:
    return F.when(value >= good, "good").when(value >= ok, "ok").otherwise("poor")


def shown(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise("N/A")


def fraction(text: Column) -> Column:
    """num/den of "60/1"; 0 if the denominator is 0."""
    parts = F.split(text, "/")
    a, b = F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1).try_cast("double"), num(1))
    return F.when(b == 0, num(0)).otherwise(a / b)


def constant_rate(rate: Column, mean_rate: Column) -> Column:
    return F.when(rate == 0, False).otherwise(F.abs(rate - mean_rate) / rate <= num(0.01))


def stance_frame(contact: Column, toe_off: Column, share: float) -> Column:
    """Frame at a share of the stance, cut to an integer; without toe-off a stance of 12 frames."""
    return (contact + num(share) * (F.coalesce(toe_off, contact + num(12)) - contact)).cast("int")


def shooting_date(text: Column) -> Column:
    """Date of an ISO time; else what stands before a T."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), F.get(F.split(text, "T"), 0))
