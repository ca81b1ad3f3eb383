"""Race pace prediction from personal bests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import num


def predict_paces(pbs: DataFrame) -> DataFrame:
    """pbs: runner_id, distance, seconds. One row a runner with a usable best.

    Two or more: a power law through the shortest and the longest, VDOT weighted by distance. One: its
    VDOT. Of bests over one distance the fastest counts; with one distance only, times come from VDOT."""
    good = pbs.where("distance > 0 and seconds > 0").groupBy("runner_id", "distance").agg(F.min("seconds").alias("seconds"))
    good = good.withColumn("v", S.vdot(F.col("distance"), F.col("seconds")))
    r = good.groupBy("runner_id").agg(
        F.count("*").alias("n"), F.min("distance").alias("d1"), F.max("distance").alias("d2"), F.min_by("seconds", "distance").alias("t1"), F.max_by("seconds", "distance").alias("t2"),
        F.max("v").alias("vdot"), (F.sum(F.col("v") * F.col("distance")) / F.sum("distance")).alias("vdot_thr"),
    )
    c = F.col
    r = r.withColumn("exponent", S.riegel_exponent(c("d1"), c("t1"), c("d2"), c("t2")))
    race = lambda d: F.when(c("n") >= 2, c("t1") * F.pow(num(d) / c("d1"), c("exponent"))).otherwise(S.predicted_seconds(c("vdot"), num(d)))
    return r.select(
        "runner_id",
        "vdot",
        "exponent",
        S.runner_profile(c("exponent")).alias("profile"),
        F.when(c("n") < 2, "Low").when(c("d2") >= S.LONG_EVENT_M, "High").otherwise("Medium").alias("confidence"),
        race(800).alias("race_800"),
        race(1500).alias("race_1500"),
        (num(60000) / S.threshold_velocity(c("vdot_thr"))).alias("threshold_pace"),
    )


def pace_verdict(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """measured: runner_id, label, pace; targets: runner_id, label, target. Within 3 s a km is on target; an unknown label n/a."""
    d = F.col("pace") - F.col("target")
    out = measured.join(targets, ["runner_id", "label"], "left").withColumn("delta", d)
    return out.withColumn("verdict", F.when(d.isNull(), "n/a").when(F.abs(d) < 3, "on target").when(d < 0, "faster").otherwise("slower"))
