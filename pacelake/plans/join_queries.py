"""Queries of the as-of and interval joins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import contacts
from ..operators.asof import asof_join
from ..operators.intervals import interval_join
from ..sources.scratch import Scratch
from ..sources.tables import FPS, HEIGHT_PX, gait, series, table
from .gait_queries import CONTACTS, LEG
from .registry import query


@query(f"RECURSIVE {CONTACTS} SELECT c.clip_id, c.leg, c.frame, c.frame - p.frame AS since FROM con c ASOF LEFT JOIN con p ON c.clip_id = p.clip_id AND c.leg = p.leg AND c.frame > p.frame")
def j9_asof_previous_contact(spark, sf_dir):
    c = contacts.coarse_contacts(gait(spark, sf_dir), HEIGHT_PX, FPS).select(*LEG, "frame")
    out = asof_join(c, c, LEG, "frame", "frame", exact=False)
    return out.select(*LEG, "frame", (F.col("frame") - F.col("right_frame")).alias("since"))


@query(
    """known AS (SELECT clip_id, frame, value FROM series WHERE value IS NOT NULL), gaps AS (SELECT clip_id, frame FROM series WHERE value IS NULL),
b AS (SELECT g.*, k.frame AS pt, k.value AS pv FROM gaps g ASOF LEFT JOIN known k ON g.clip_id = k.clip_id AND g.frame >= k.frame),
f AS (SELECT b.*, k.frame AS nt, k.value AS nv FROM b ASOF LEFT JOIN known k ON b.clip_id = k.clip_id AND b.frame <= k.frame),
c AS (SELECT *, nt IS NULL OR frame - pt <= nt - frame AS back FROM f)
SELECT clip_id, frame, CASE WHEN back THEN CASE WHEN frame - pt <= 1 THEN pt END WHEN nt - frame <= 1 THEN nt END AS at, CASE WHEN back THEN CASE WHEN frame - pt <= 1 THEN pv END WHEN nt - frame <= 1 THEN nv END AS value FROM c"""
)
def j8_asof_nearest_anchor(spark, sf_dir):
    s = series(spark, sf_dir).select("clip_id", "frame", "value")
    known = s.where("value is not null").withColumnRenamed("frame", "at")
    return asof_join(s.where("value is null").drop("value"), known, ["clip_id"], "frame", "at", "nearest", tolerance=1)


@query(
    """WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), b AS (SELECT user_id, ts, max(event_id) AS other FROM events WHERE event_type <> 'view' GROUP BY ALL),
p AS (SELECT a.*, b.ts AS pt, b.other AS po FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts), n AS (SELECT p.*, b.ts AS nt, b.other AS no FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.ts < b.ts),
c AS (SELECT *, nt IS NULL OR ts - pt <= nt - ts AS back FROM n)
SELECT user_id, event_id, CASE WHEN back THEN CASE WHEN ts - pt <= INTERVAL 90 MINUTE THEN po END WHEN nt - ts <= INTERVAL 90 MINUTE THEN no END AS other FROM c"""
)
def j3_asof_two_sensors(spark, sf_dir):
    """Two sensors with clocks of their own: the events of one, each with the nearest of the other within an hour and a half."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    a, b = e.where("event_type = 'view'").drop("event_type"), e.where("event_type <> 'view'").withColumnRenamed("event_id", "other").drop("event_type")
    return asof_join(a, b, ["user_id"], "ts", "ts", "nearest", tolerance=timedelta(minutes=90), latest=["other"]).select("user_id", "event_id", "other")


@query(
    """SELECT l_orderkey, l_linenumber, last_order, last_date FROM lineitem l ASOF LEFT JOIN (SELECT o_orderstatus, o_orderdate AS last_date, max(o_orderkey) AS last_order FROM orders GROUP BY ALL) o
ON l.l_linestatus = o.o_orderstatus AND l.l_shipdate >= o.last_date"""
)
def j3_asof_hot_keys(spark, sf_dir):
    """Two keys, each with half of all rows: the last order of a line's status before it was sent."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("l_linestatus"), F.col("o_orderdate").alias("last_date"), F.col("o_orderkey").alias("last_order"))
    return asof_join(lines, orders, ["l_linestatus"], "l_shipdate", "last_date", latest=["last_order"]).select("l_orderkey", "l_linenumber", "last_order", "last_date")


@query(f"RECURSIVE {CONTACTS} SELECT c.clip_id, c.leg, c.frame, g.frame AS t, g.comp FROM con c JOIN gait g ON g.clip_id = c.clip_id AND g.leg = c.leg AND g.frame BETWEEN c.frame - 5 AND c.toe_off + 3")
def j4_interval_contact_frames(spark, sf_dir):
    g = gait(spark, sf_dir)
    c = contacts.coarse_contacts(g, HEIGHT_PX, FPS).select(*LEG, "frame", (F.col("frame") - 5).alias("low"), (F.col("toe_off") + 3).alias("high"))
    frames = g.select(*LEG, F.col("frame").alias("t"), "comp")
    return interval_join(c, frames, LEG, ("low", "high"), ("t", "t")).select(*LEG, "frame", "t", "comp")


#: Where a clip's first frame lies on a clock that all clips share.
_CLOCK = "(clip_id * 7919) % 5000"


@query(
    f"""RECURSIVE {CONTACTS}, k AS (SELECT clip_id, leg, {_CLOCK} + frame AS start, {_CLOCK} + toe_off AS stop FROM con)
SELECT a.clip_id, a.leg, a.start, b.clip_id AS other_clip, b.leg AS other_leg, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared FROM k a JOIN k b ON a.start <= b.stop AND b.start <= a.stop AND (a.clip_id <> b.clip_id OR a.leg < b.leg)"""
)
def j5_interval_contacts_of_the_corpus(spark, sf_dir):
    """Contacts of any two clips, or of both legs, that share frames of a common clock."""
    c = contacts.coarse_contacts(gait(spark, sf_dir), HEIGHT_PX, FPS)
    k = c.select(*LEG, (F.expr(_CLOCK) + F.col("frame")).alias("start"), (F.expr(_CLOCK) + F.col("toe_off")).alias("stop"))
    k = Scratch(spark, "contacts").save(k, "contacts")  # both sides of the join
    other = k.select(F.col("clip_id").alias("other_clip"), F.col("leg").alias("other_leg"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    out = interval_join(k, other, [], ("start", "stop"), ("b_start", "b_stop")).where("clip_id <> other_clip or leg < other_leg")
    return out.select(*LEG, "start", "other_clip", "other_leg", (F.least("stop", "b_stop") - F.greatest("start", "b_start")).alias("shared"))


@query(
    """SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared FROM
(SELECT o_custkey, o_orderkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS start, datediff('day', DATE '1970-01-01', max(l_shipdate)::DATE) AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) a JOIN
(SELECT o_custkey, o_orderkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS start, datediff('day', DATE '1970-01-01', max(l_shipdate)::DATE) AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) b
ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.start <= b.stop AND b.start <= a.stop AND a.start <= a.stop AND b.start <= b.stop"""
)
def j5_interval_open_orders(spark, sf_dir):
    """Orders of one customer that are open at the same time: intervals of very unequal lengths."""
    sent = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("sent"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(sent, "o_orderkey")
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    o = o.select("o_custkey", "o_orderkey", day("o_orderdate").alias("start"), day("sent").alias("stop"))
    b = o.withColumnsRenamed({"o_orderkey": "other", "start": "b_start", "stop": "b_stop"})
    out = interval_join(o, b, ["o_custkey"], ("start", "stop"), ("b_start", "b_stop")).where("o_orderkey < other")
    return out.select("o_custkey", "o_orderkey", "other", (F.least("stop", "b_stop") - F.greatest("start", "b_start")).cast("bigint").alias("shared"))
