"""Ground contacts: detection, refinement, strike patterns, pruning, missing contacts, checks. ground.py joins them to one chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import num
from ..functions.windows import down_crossings, gaussian, gradient, greedy_min_gap, interpolate, let
from .intervals import in_cells

LEG = ["clip_id", "leg"]
#: Fixed word lists of the strike votes.
FOREFOOT_PACES, HEEL_PACES = ("800m", "1500m"), ("steady", "recovery", "easy", "threshold")
FOREFOOT_SHOES, HEEL_SHOES = ("track_spike", "super_shoe", "carbon_plate"), ("trainer", "racing_flat", "spikes_distance", "neutral")
TIE_PX = 5.0


def adaptive_sigma(df: DataFrame, by: list[str], vis: str) -> DataFrame:
    """Adds sigma: 2 for a sequence whose mean visibility is above one half, else 3."""
    return df.withColumn("sigma", F.when(F.avg(vis).over(W.partitionBy(*by)) > 0.5, num(2)).otherwise(num(3)))


def compression_velocity(gait: DataFrame) -> DataFrame:
    """Gaps filled, smoothed, differentiated: full, smooth, v."""
    df = adaptive_sigma(interpolate(gait, LEG, "comp", "full"), LEG, "vis")
    return gradient(gaussian(df, LEG, "full", "smooth", "sigma"), LEG, "smooth", "v")


def _stances(contacts: Column, last: Column, fps: float) -> Column:
    """Contacts of one leg as structs with toe_off and gct_ms: a default stance on, but two frames before the next contact; the last frame when there is no next."""

    def stance(c: Column, i: Column) -> Column:
        after = F.get(contacts, i + 1)["frame"]
        toe_off = F.least(c["frame"] + int(0.18 * fps), F.coalesce(after - 2, last))
        return F.struct(c["frame"].alias("frame"), c["confidence"].alias("confidence"), toe_off.alias("toe_off"), ((toe_off - c["frame"]).cast("double") / num(fps) * num(1000)).alias("gct_ms"))

    return F.transform(contacts, stance)


def coarse_contacts(gait: DataFrame, height: float, fps: float, low_ms: float = 80, high_ms: float = 400, vis: str = "vis") -> DataFrame:
    """clip_id, leg, frame, last, confidence, toe_off, gct_ms: falling crossings of the compression speed, at least a tenth of a second apart.

    Contacts of an impossible duration go, and stances are computed again. vis: the lower visibility of hip
    and ankle. The crossings of a leg are gathered once, and all else is done on that array."""
    v = down_crossings(compression_velocity(gait), LEG, "v", 0.001 * height)
    trust = F.least(num(1), F.greatest(num(0.2), F.col(vis) / num(0.6)))
    hit = F.when(F.col("crossing"), F.struct(F.col("frame").cast("long").alias("frame"), trust.alias("confidence")))
    legs = v.groupBy(*LEG).agg(F.array_sort(F.collect_list(hit)).alias("at"), F.max("frame").alias("last"))
    taken = greedy_min_gap(F.col("at"), int(0.1 * fps), "struct<frame: bigint, confidence: double>", lambda x: x["frame"])
    staged = let(taken, lambda a: _stances(a, F.col("last"), fps))
    kept = F.filter(staged, lambda c: (c["gct_ms"] > low_ms) & (c["gct_ms"] < high_ms))
    return legs.select(*LEG, "last", F.inline(let(kept, lambda a: _stances(a, F.col("last"), fps)))).select(*LEG, "frame", "last", "confidence", "toe_off", "gct_ms")


def numbered(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("contact_no", F.row_number().over(W.partitionBy("clip_id").orderBy("frame", "leg")))


#: Frames of a cell, about as many as a contact's window has.
CELL = 16


def near_frames(contacts: DataFrame, frames: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each contact with the frames of its leg from low to high: an equality join on the cells that its window touches; a frame lies in one cell."""
    f = frames.withColumnRenamed("frame", "t").withColumn("cell_", F.floor(F.col("t") / CELL).cast("bigint"))
    c = in_cells(contacts.withColumns({"low_": low, "high_": high}), F.col("low_"), F.col("high_"), CELL)
    return c.join(f, [*LEG, "cell_"]).where(F.col("t").between(F.col("low_"), F.col("high_"))).drop("cell_", "low_", "high_")


def falls(speeds: DataFrame, **thresholds: float) -> DataFrame:
    """Per leg, for each named threshold the falling crossings of the speed as an array of frame and place. speeds: clip_id, leg, frame, v, and v of the frame before as pv."""

    def hit(th: float) -> Column:
        place = F.col("frame") - num(1) + (num(th) - F.col("pv")) / (F.col("v") - F.col("pv"))
        return F.when((F.col("pv") > th) & (F.col("v") <= th), F.struct(F.col("frame").alias("t"), place.alias("place")))

    return speeds.groupBy(*LEG).agg(*(F.array_sort(F.collect_list(hit(th))).alias(name) for name, th in thresholds.items()))


def refined(contacts: DataFrame, speeds: DataFrame, ic_threshold: float, to_threshold: float, strike: str, fps: float) -> DataFrame:
    """Adds contact_frame, toe_off_frame, refined_ms, detection_method. speeds: clip_id, leg, frame, v (with v at the frame before as pv).

    heel: last crossing of [C-2, C+10], not before C. forefoot: first of [C-5, C+5]. Without one, C stays.
    Toe-off: first crossing of the lift threshold within five frames of contact plus the default stance;
    else the coarse one. A duration outside 80 to 400 ms leaves the coarse values. The crossings of a leg are
    one row, so contacts and speeds are each read once."""
    c = F.col
    df = contacts.join(falls(speeds, hits=ic_threshold, lifts=to_threshold), LEG, "left")
    coarse = c("frame").cast("double")
    lo, hi = (2, 10) if strike == "heel" else (5, 5)
    hits = F.filter("hits", lambda h: (h["t"] >= F.greatest(F.lit(1), c("frame") - lo) + 1) & (h["t"] <= F.least(c("last"), c("frame") + hi)))
    if strike == "heel":
        df = df.withColumn("ic", F.greatest(F.coalesce(F.try_element_at(hits, F.lit(-1))["place"], coarse), coarse))
    else:
        df = df.withColumn("ic", F.coalesce(F.get(hits, 0)["place"], coarse))
    end = c("ic").cast("int") + int(0.18 * fps)
    lifts = F.filter("lifts", lambda h: (h["t"] >= F.greatest(F.lit(1), end - 5)) & (h["t"] <= F.least(c("last"), end + 5) - 1))
    df = df.withColumn("to", F.coalesce(F.get(lifts, 0)["place"], c("toe_off").cast("double")))
    ms = (c("to") - c("ic")) / num(fps) * num(1000)
    good = (ms > 80) & (ms < 400)
    return df.select(
        *contacts.columns,
        F.when(good, c("ic")).otherwise(coarse).alias("contact_frame"),
        F.when(good, c("to")).otherwise(c("toe_off").cast("double")).alias("toe_off_frame"),
        F.when(good, ms).otherwise(c("gct_ms")).alias("refined_ms"),
        F.when(good, "refined").otherwise("coarse").alias("detection_method"),
    )


def toe_off_by_position(contacts: DataFrame, feet: DataFrame, fps: float, drop_px: float, factor: float = 1.5) -> DataFrame:
    """Toe-off where the toe leaves its ground line: the lowest place of the stance window less a tolerance. Adds position_toe_off.

    feet: clip_id, leg, frame, toe_y, seen. The crossing is drawn from the last pinned frame to the next
    valid one; NULL when still pinned at the end, or with under three valid frames."""
    span = int(factor * int(0.18 * fps))
    end = F.least(F.col("frame") + span, F.col("last"))
    around = near_frames(contacts.withColumn("end", end).where("end > frame + 2"), feet.where("seen"), F.col("frame"), F.col("end"))
    s = around.groupBy(*LEG, "frame", "end").agg(F.array_sort(F.collect_list(F.struct("t", F.col("toe_y").alias("y")))).alias("s"), F.max("toe_y").alias("ground"))
    s = s.where(F.size("s") >= 3).withColumn("target", F.col("ground") - num(drop_px))
    pinned = s.withColumn("p", F.element_at(F.filter("s", lambda x: x["y"] >= F.col("target")), -1)).where(F.col("p")["t"] < F.col("end"))
    pinned = pinned.withColumn("q", F.get(F.filter("s", lambda x: x["t"] > F.col("p")["t"]), 0))
    at = F.col("p")["t"] + (F.col("target") - F.col("p")["y"]) / (F.col("q")["y"] - F.col("p")["y"])
    return contacts.join(pinned.select(*LEG, "frame", at.alias("position_toe_off")), [*LEG, "frame"], "left")


def strikes(contacts: DataFrame, feet: DataFrame, tau: float, min_vis: float = 0.5) -> DataFrame:
    """Adds strike. feet: clip_id, leg, frame, delta (heel below toe), vis, and those of the frame before as pdelta, pvis.

    First a crossing from heel-down to toe-down within [C-4, C+1]; else the mean over C-1 to C+1, of which all must be seen."""
    ok, pok = (F.col("vis") >= min_vis) & F.col("delta").isNotNull(), (F.col("pvis") >= min_vis) & F.col("pdelta").isNotNull()
    around = near_frames(contacts.select(*LEG, "frame", "last"), feet, F.greatest(F.lit(0), F.col("frame") - 4), F.least(F.col("last"), F.col("frame") + 1))
    flips = F.coalesce(F.bool_or(ok & pok & (F.col("t") >= 1) & (F.col("pdelta") > 0) & (F.col("delta") < -tau)), F.lit(False))
    inner = F.abs(F.col("t") - F.col("frame")) <= 1
    votes = around.groupBy(*LEG, "frame").agg(
        flips.alias("flips"), F.count_if(inner).alias("n"), F.count_if(inner & ok).alias("n_ok"), F.bround(F.avg(F.when(inner, F.col("delta"))), 9).alias("mean")
    )
    strict = F.when(F.col("n") == F.col("n_ok"), F.col("mean"))
    kind = F.when(F.col("flips"), "forefoot").when(strict > tau, "heel").when(strict < -tau, "forefoot").otherwise("unknown")
    return contacts.join(votes.select(*LEG, "frame", kind.alias("strike")), [*LEG, "frame"], "left").fillna("unknown", ["strike"])


def strike_votes(pace: Column, shoe: Column, fore: Column, heel: Column) -> Column:
    """Struct of speed_signal, shoe_signal, vote_signal, decision, confidence: three votes, of pace, shoe, and the plurality of fore and heel contacts."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    signal = lambda c, f, h: F.when(norm(c).isin(*f), "forefoot").when(norm(c).isin(*h), "heel").otherwise("neutral")
    three = F.array(
        signal(pace, FOREFOOT_PACES, HEEL_PACES), signal(shoe, FOREFOOT_SHOES, HEEL_SHOES), F.when(fore > heel, "forefoot").when(heel > fore, "heel").otherwise("unknown")
    )

    def decide(s: Column) -> Column:
        count = lambda kind: F.size(F.filter(s, lambda x: x == kind))
        f, h, n = count("forefoot"), count("heel"), F.lit(3) - count("neutral")
        agree = F.greatest(f, h)
        return F.struct(
            F.get(s, 0).alias("speed_signal"), F.get(s, 1).alias("shoe_signal"), F.get(s, 2).alias("vote_signal"), F.when(f > h, "forefoot").when(h > f, "heel").otherwise("unknown").alias("decision"),
            F.when(n == 0, "none").when(agree == n, "strong").when(agree >= 2, "moderate").otherwise("weak").alias("confidence"),
        )

    return let(three, decide)


def clip_strike(struck: DataFrame, pace: Column, shoe: Column) -> DataFrame:
    """Decision and confidence of each clip by strike_votes. pace and shoe are made from clip_id."""
    per = struck.groupBy("clip_id").agg(F.count_if(F.col("strike") == "forefoot").alias("fore"), F.count_if(F.col("strike") == "heel").alias("heel"))
    return per.select("clip_id", strike_votes(pace, shoe, F.col("fore"), F.col("heel")).alias("v")).select("clip_id", "v.*")


def pruned(contacts: DataFrame, min_step: float, stride_frames: float) -> DataFrame:
    """Survivors: clip_id, leg, frame, ic. contacts: clip_id, leg, frame, ic, foot_y.

    One fold for each clip, with a stack of survivors: while the current contact is too near to the top,
    one of both goes: the one without a trusted foot, the higher foot, or on a tie the one that fits the
    same leg's stride worse (else the later)."""
    order = F.array_sort(F.collect_list(F.struct("frame", "leg", "ic", "foot_y")))
    kind = "struct<frame: bigint, leg: string, ic: double, foot_y: double>"

    def verdict(stack: Column, c: Column) -> Column:
        """push, drop (the current) or pop (the top)."""
        top = F.element_at(stack, -1)
        gap = F.greatest(c["ic"] - top["ic"], (c["frame"] - top["frame"]).cast("double"))
        below = F.filter(F.slice(stack, F.lit(1), F.size(stack) - 1), lambda x: x["leg"] == top["leg"])
        anchor = F.when(F.size(below) > 0, F.element_at(below, -1)["ic"])
        worse = F.abs(top["ic"] - anchor - num(stride_frames)) > F.abs(c["ic"] - anchor - num(stride_frames))
        tie = F.when((top["leg"] == c["leg"]) & anchor.isNotNull() & worse, "pop").otherwise("drop")
        return (
            F.when((F.size(stack) == 0) | (gap >= min_step), "push")
            .when(top["foot_y"].isNull() & c["foot_y"].isNull(), "drop")
            .when(top["foot_y"].isNull(), "push")
            .when(c["foot_y"].isNull(), "drop")
            .when(F.abs(top["foot_y"] - c["foot_y"]) < TIE_PX, tie)
            .when(top["foot_y"] < c["foot_y"], "pop")
            .otherwise("drop")
        )

    def settle(stack: Column, c: Column) -> Column:
        # each pop is one step; at most as many as the stack is high
        popped = F.aggregate(
            F.sequence(F.lit(0), F.size(stack)),
            F.struct(stack.alias("s"), F.lit("").alias("end")),
            lambda a, _: F.when(a["end"] != "", a).otherwise(
                F.when(verdict(a["s"], c) == "pop", F.struct(F.slice(a["s"], F.lit(1), F.size(a["s"]) - 1).alias("s"), F.lit("").alias("end"))).otherwise(F.struct(a["s"].alias("s"), verdict(a["s"], c).alias("end")))
            ),
        )
        return F.when(popped["end"] == "drop", popped["s"]).otherwise(F.array_append(popped["s"], c))

    kept = contacts.groupBy("clip_id").agg(order.alias("c")).select("clip_id", F.aggregate("c", F.array().cast(f"array<{kind}>"), settle).alias("kept"))
    return kept.select("clip_id", F.inline("kept"))


def missing_contacts(contacts: DataFrame, feet: DataFrame, step_frames: float, threshold: float, within: int = 8, most: int = 3) -> DataFrame:
    """Contacts to add: clip_id, leg, frame, contact_frame. Where a gap is over 1.5 steps, places a step apart, legs in turn; each needs the last toe crossing within some frames, of which three are seen."""
    w = W.partitionBy("clip_id").orderBy("frame", "leg")
    holes = contacts.select("clip_id", "leg", "frame", F.lead("frame").over(w).alias("next")).where(F.col("next") - F.col("frame") > num(1.5 * step_frames))
    n = F.least(F.bround((F.col("next") - F.col("frame")) / num(step_frames), 0).cast("int") - 1, F.lit(most))
    places = holes.withColumn("n", n).where("n >= 1").select("clip_id", "leg", "frame", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    other = F.when(F.col("leg") == "L", "R").otherwise("L")
    places = places.select("clip_id", F.when(F.col("k") % 2 == 1, other).otherwise(F.col("leg")).alias("leg"), (F.col("frame") + F.col("k") * num(step_frames)).alias("want"))
    around = near_frames(places, feet, F.ceil(F.col("want") - within), F.floor(F.col("want") + within))
    hit = (F.col("pv") > threshold) & (F.col("v") <= threshold)
    at = F.col("t") - num(1) + (num(threshold) - F.col("pv")) / (F.col("v") - F.col("pv"))
    found = around.groupBy(*LEG, "want").agg(F.count_if("seen").alias("n_seen"), F.max_by(F.when(hit, at), F.when(hit, F.col("t"))).alias("contact_frame"))
    found = found.where("n_seen >= 3 and contact_frame is not null")
    return found.select(*LEG, F.floor("contact_frame").alias("frame"), "contact_frame").distinct()


def pattern_check(contacts: DataFrame) -> DataFrame:
    """Per clip: counts, same-leg neighbours, mean and variation of the intervals, valid."""
    w = W.partitionBy("clip_id").orderBy("frame", "leg")
    df = contacts.withColumns({"same": F.lag("leg").over(w) == F.col("leg"), "gap": F.col("contact_frame") - F.lag("contact_frame").over(w)})
    out = df.groupBy("clip_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("detection_method") == "refined").alias("n_refined"), F.count_if("same").alias("n_same"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd")
    )
    valid = (F.col("n") >= 3) & (F.col("n_same") <= F.col("n") * num(0.2))
    return out.select("clip_id", "n", "n_refined", "n_same", "mean_gap", (F.col("sd") / F.col("mean_gap")).alias("cv"), valid.alias("valid"))


def detection_summary(contacts: DataFrame) -> DataFrame:
    """Counts and refined share of each clip, in all and by leg."""
    return contacts.cube("clip_id", "leg").agg(F.count("*").alias("n"), F.count_if(F.col("detection_method") == "refined").alias("n_refined"), F.grouping_id().alias("g")).where("g < 2").drop("g")


def toe_off_by_speed(contacts: DataFrame, speeds: DataFrame, threshold: float, fps: float) -> DataFrame:
    """Adds speed_toe_off: the first falling crossing of the toe's speed within six frames of the expected end, else the coarse toe-off.

    contacts: clip_id, leg, frame, last, toe_off, ic (may be NULL). With ic, the end is expected a default
    stance after it, and no toe-off lies within 120 ms of it."""
    ic = F.col("ic").cast("int")
    end = F.coalesce(ic + int(0.18 * fps), F.col("toe_off"), F.col("frame") + 12)
    low, high = F.greatest(F.lit(1), end - 6, ic + int(0.12 * fps)), F.least(F.col("last"), end + 6) - 1
    hits = F.filter("lifts_", lambda h: (h["t"] >= low) & (h["t"] <= high))
    out = contacts.join(falls(speeds, lifts_=threshold), LEG, "left")
    return out.withColumn("speed_toe_off", F.coalesce(F.get(hits, 0)["place"], F.col("toe_off").cast("double"))).drop("lifts_")
