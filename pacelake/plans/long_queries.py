"""Queries of sequences longer than a task, and of the stream of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import long as L
from ..functions.scalar import num
from ..sources.scratch import Scratch
from ..sources.tables import FPS, HEIGHT_PX, gait, pose, table
from ..streaming.contacts import ROCKSDB, stream_contacts
from ..streaming.passes import combined_stream, gathered
from .gait_queries import ANCHORS, COMBINE, CONTACTS, LERP, LEG, WINDOWS, _gauss
from .registry import query, rounded

#: Frames of a chunk: few, so that the tables at hand have many.
SIZE = 512


def _clock() -> Column:
    """When a frame was taken: frames begin on the second day, as a stream takes what is of the first instant of all for late."""
    return F.timestamp_millis((F.col("frame") * 1_000 / int(FPS)).cast("bigint") + 86_400_000)


#: All events as one sequence, in the order of their numbers.
ONE = "one AS (SELECT 0 AS sensor, event_id - (SELECT min(event_id) FROM events) AS frame, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, frame, value: all events as one sequence, every seventh without a value."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    first = e.agg(F.min("event_id").alias("m")).first()["m"]
    return e.select(F.lit(0).alias("sensor"), (F.col("event_id") - F.lit(first)).alias("frame"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


FILLED = f"{ONE}, w AS (SELECT *, {ANCHORS.format(v='value')} FROM one {WINDOWS.format(by='sensor')}), filled AS (SELECT sensor, frame, {LERP} AS fv FROM w)"


@query(f"WITH {FILLED} SELECT frame, round(fv, 6) AS filled FROM filled")
def w1_long_interpolate(spark, sf_dir):
    return rounded(L.interpolate(one(spark, sf_dir), ["sensor"], "value", "filled", SIZE).select("frame", "filled"))


@query(f"WITH {FILLED}, {_gauss('filled', 'sensor', 'fv', 'sm', '2e0')} SELECT frame, round(sm, 6) AS smooth, round(CASE WHEN lag(frame) OVER w IS NULL THEN lead(sm) OVER w - sm WHEN lead(frame) OVER w IS NULL THEN sm - lag(sm) OVER w ELSE (lead(sm) OVER w - lag(sm) OVER w) / 2e0 END, 6) AS v FROM sm_x WINDOW w AS (PARTITION BY sensor ORDER BY frame)")
def w2_long_gaussian_and_slope(spark, sf_dir):
    df = L.interpolate(one(spark, sf_dir), ["sensor"], "value", "full", SIZE)
    df = L.gradient(L.gaussian(df, ["sensor"], "full", "smooth", 2.0, SIZE), ["sensor"], "smooth", "v", SIZE)
    return rounded(df.select("frame", "smooth", "v"))


@query(
    f"""WITH {ONE}, r AS (SELECT *, coalesce(value > 30e0, false) AS flag FROM one), c AS (SELECT *, CASE WHEN lag(flag) OVER w IS DISTINCT FROM flag THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY sensor ORDER BY frame)),
g AS (SELECT *, sum(new) OVER (PARTITION BY sensor ORDER BY frame) AS run FROM c) SELECT flag, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM g GROUP BY run, flag"""
)
def w10_long_runs(spark, sf_dir):
    return L.runs(one(spark, sf_dir), ["sensor"], F.col("value") > 30.0, SIZE).drop("sensor")


@query(
    f"""WITH RECURSIVE {ONE}, h AS (SELECT frame, row_number() OVER (ORDER BY frame) AS i FROM one WHERE value > 40e0),
t AS (SELECT frame, i, frame AS kept FROM h WHERE i = 1 UNION ALL SELECT h.frame, h.i, CASE WHEN h.frame - t.kept >= 6 THEN h.frame ELSE t.kept END FROM t JOIN h ON h.i = t.i + 1) SELECT frame FROM t WHERE frame = kept"""
)
def n1_long_greedy_gaps(spark, sf_dir):
    return L.greedy(one(spark, sf_dir).where("value > 40"), ["sensor"], 6, [], SIZE).select("frame")


@query(
    f"""WITH {ONE}, u AS (SELECT frame FROM one WHERE value > 6e1), n AS (SELECT *, CASE WHEN frame - lag(frame) OVER (ORDER BY frame) > 13 THEN 1 ELSE 0 END AS new FROM u), s AS (SELECT *, sum(new) OVER (ORDER BY frame) AS session FROM n)
SELECT min(frame) AS start, max(frame) AS stop, count(*) AS n_usable, max(frame) - min(frame) + 1 >= 90 AS enough FROM s WHERE session = 0 HAVING count(*) > 0"""
)
def w15_long_first_session(spark, sf_dir):
    return L.first_session(one(spark, sf_dir), ["sensor"], F.col("value") > 60.0, max_gap=12, size=SIZE).drop("sensor")


@query("RECURSIVE " + CONTACTS + " SELECT clip_id, leg, frame, last, toe_off FROM con")
def w23_long_contacts(spark, sf_dir):
    return L.coarse_contacts(gait(spark, sf_dir), HEIGHT_PX, FPS, size=16).select(*LEG, "frame", "last", "toe_off")


@query("RECURSIVE " + CONTACTS + " SELECT clip_id, leg, frame, toe_off FROM con")
def n1_stream_contacts(spark, sf_dir):
    """The frames of all legs as a stream of files, and the contacts that it has written when it ends."""
    scratch = Scratch(spark, "stream")
    at = _clock()
    frames = scratch.save(gait(spark, sf_dir).select(*LEG, "frame", at.alias("at"), "comp", "vis"), "frames")
    # a leg that is not looked at has a frame so late that all others end
    clock = frames.limit(1).select(F.lit(-1).cast(frames.schema["clip_id"].dataType).alias("clip_id"), F.lit("-").alias("leg"), F.lit(0).cast("bigint").alias("frame"), F.expr("timestamp_seconds(1000000000)").alias("at"), F.lit(None).cast("double").alias("comp"), num(0).alias("vis"))
    folder = f"{scratch.folder}/{scratch.saved}-frames"  # the stream reads what was written, and what is added
    kept = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    try:
        for part in (None, clock, clock.withColumn("frame", F.col("frame") + 1)):
            if part is not None:
                part.write.mode("append").parquet(folder)
            stream = spark.readStream.schema(frames.schema).parquet(folder)
            writer = stream_contacts(stream, HEIGHT_PX, FPS).writeStream.format("parquet").option("path", f"{scratch.folder}/out").option("checkpointLocation", f"{scratch.folder}/state")
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKSDB[0], kept)
    return spark.read.parquet(f"{scratch.folder}/out").select(*LEG, "frame", "toe_off")


@query(f"{COMBINE} SELECT p.clip_id, p.frame, lm, chosen, round(CASE chosen WHEN 'avg' THEN (x + bx) / 2e0 WHEN 'fwd' THEN x WHEN 'rev' THEN bx END, 6) AS x, round(CASE chosen WHEN 'avg' THEN (y + by_) / 2e0 WHEN 'fwd' THEN y WHEN 'rev' THEN by_ END, 6) AS y, round(coalesce(CASE chosen WHEN 'avg' THEN (vis + bvis) / 2e0 WHEN 'fwd' THEN vis WHEN 'rev' THEN bvis END, 0e0), 6) AS vis FROM p JOIN c USING (clip_id, frame)")
def c1_j1_stream_combine(spark, sf_dir):
    """The two passes of c1_j1_j3_combine_two as two streams of files; the frames that both have."""
    scratch = Scratch(spark, "stream")
    at = _clock()
    a = pose(spark, sf_dir).withColumn("at", at)
    moved = (F.col("x") + num(10) * (F.col("frame") % 5).cast("double")).alias("x")
    b = a.where("frame % 11 <> 3").select("clip_id", "frame", "at", "lm", moved, "y", F.when(F.col("frame") % 3 == 0, num(0.5)).otherwise(F.col("vis")).alias("vis"))
    streams = []
    for name, df in (("a", a), ("b", b)):
        frames = gathered(df)
        folder = f"{scratch.folder}/{name}"
        frames.repartition(3).write.parquet(folder)
        streams.append(spark.readStream.schema(frames.schema).parquet(folder))
    out = combined_stream(*streams, 500.0)
    writer = out.writeStream.format("parquet").option("path", f"{scratch.folder}/out").option("checkpointLocation", f"{scratch.folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{scratch.folder}/out").where("complete")
    return rounded(got.select("clip_id", "frame", "chosen", F.inline("points")))
