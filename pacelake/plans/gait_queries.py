"""Queries of the window, body, contact and metric operators, on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import windows as N
from ..functions.scalar import num
from ..operators import body, contacts, metrics, smoothing, tracks
from ..sources.tables import FPS, HEIGHT_PX, STANDING, gait, pose, series, standing, table
from .registry import query, rounded

LEG = contacts.LEG
CLIP = ["clip_id"]

ANCHORS = """last_value({v} IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN {v} IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS pt,
 first_value({v} IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN {v} IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS nt"""
WINDOWS = """WINDOW b AS (PARTITION BY {by} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY {by} ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
LERP = "CASE WHEN pt = nt THEN pv ELSE coalesce(pv + (nv - pv) * ((frame - pt)::DOUBLE / (nt - pt)::DOUBLE), pv, nv) END"


def _reflect(t: str, n: str) -> str:
    m = f"((({t}) % (2 * {n})) + 2 * {n}) % (2 * {n})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - ({m}) END"


def _gauss(src: str, by: str, v: str, out: str, sigma: str) -> str:
    """CTEs that smooth v of src with sigma (an expression of 2e0 or 3e0) by joining the taps to reflected frames."""
    return f"""{out}_n AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n_, {sigma} AS s_ FROM {src}),
{out}_k AS (SELECT s AS s_, k, exp(-k * k / (2e0 * s * s)) / sum(exp(-k * k / (2e0 * s * s))) OVER (PARTITION BY s) AS w FROM (VALUES (2e0), (3e0)) v(s), (SELECT unnest(range(-12, 13)) AS k) WHERE abs(k) <= floor(4 * s + 5e-1)),
{out}_t AS (SELECT x.*, k.w, k.k, {_reflect('x.frame + k.k', 'x.n_')} AS at_ FROM {out}_n x JOIN {out}_k k USING (s_)),
{out}_s AS (SELECT {', '.join('t.' + c.strip() for c in by.split(','))}, t.frame, sum(t.w * y.{v}) AS {out}, count(y.{v}) AS c_, count(*) AS m_ FROM {out}_t t JOIN {out}_n y ON {' AND '.join(f't.{c.strip()} = y.{c.strip()}' for c in by.split(','))} AND y.frame = t.at_ GROUP BY ALL),
{out}_x AS (SELECT * EXCLUDE (c_, m_) REPLACE (CASE WHEN c_ = m_ THEN {out} END AS {out}) FROM {out}_s)"""


W1 = f"w1 AS (SELECT *, {ANCHORS.format(v='comp')} FROM gait {WINDOWS.format(by='clip_id, leg')}), interp AS (SELECT clip_id, frame, leg, vis, avg(vis) OVER (PARTITION BY clip_id, leg) AS mv, {LERP} AS filled FROM w1)"
SPEED = f"""{W1}, {_gauss('interp', 'clip_id, leg', 'filled', 'sm', 'CASE WHEN mv > 5e-1 THEN 2e0 ELSE 3e0 END')},
spd AS (SELECT clip_id, leg, frame, sm, CASE WHEN lag(frame) OVER w IS NULL THEN lead(sm) OVER w - sm WHEN lead(frame) OVER w IS NULL THEN sm - lag(sm) OVER w ELSE (lead(sm) OVER w - lag(sm) OVER w) / 2e0 END AS v FROM sm_x WINDOW w AS (PARTITION BY clip_id, leg ORDER BY frame)),
crs AS (SELECT *, lag(v) OVER w > 216e-2 AND v <= 216e-2 AND lead(frame) OVER w IS NOT NULL AS crossing, lag(v) OVER w AS pv FROM spd WINDOW w AS (PARTITION BY clip_id, leg ORDER BY frame))"""
CONTACTS = f"""{SPEED}, cand AS (SELECT clip_id, leg, frame, row_number() OVER (PARTITION BY clip_id, leg ORDER BY frame) AS i FROM crs WHERE crossing),
greedy AS (SELECT clip_id, leg, frame, i, frame AS kept FROM cand WHERE i = 1 UNION ALL
  SELECT c.clip_id, c.leg, c.frame, c.i, CASE WHEN c.frame - g.kept >= 6 THEN c.frame ELSE g.kept END FROM greedy g JOIN cand c ON c.clip_id = g.clip_id AND c.leg = g.leg AND c.i = g.i + 1),
ends AS (SELECT clip_id, leg, max(frame) AS last FROM gait GROUP BY ALL),
st1 AS (SELECT g.clip_id, g.leg, g.frame, e.last, lead(g.frame) OVER (PARTITION BY g.clip_id, g.leg ORDER BY g.frame) AS nx FROM greedy g JOIN ends e USING (clip_id, leg) WHERE g.kept = g.frame),
st2 AS (SELECT *, CASE WHEN nx IS NULL THEN least(frame + 10, last) ELSE least(frame + 10, nx - 2) END AS t FROM st1),
st3 AS (SELECT clip_id, leg, frame, last, lead(frame) OVER (PARTITION BY clip_id, leg ORDER BY frame) AS nx FROM st2 WHERE (t - frame) / 60e0 * 1000e0 > 80 AND (t - frame) / 60e0 * 1000e0 < 400),
con AS (SELECT clip_id, leg, frame, last, CASE WHEN nx IS NULL THEN least(frame + 10, last) ELSE least(frame + 10, nx - 2) END AS toe_off FROM st3)"""


@query(f"{W1} SELECT clip_id, frame, leg, round(filled, 6) AS filled FROM interp")
def w1_j8_interpolate(spark, sf_dir):
    return rounded(N.interpolate(gait(spark, sf_dir), LEG, "comp", "filled").select("clip_id", "frame", "leg", "filled"))


@query(f"{SPEED} SELECT clip_id, leg, frame, round(sm, 6) AS smooth, round(v, 6) AS v FROM spd")
def w2_w3_p3_p33_smoothed_speed(spark, sf_dir):
    return rounded(contacts.compression_velocity(gait(spark, sf_dir)).select("clip_id", "leg", "frame", "smooth", "v"))


@query(f"{SPEED} SELECT clip_id, leg, frame, round(frame - 1e0 + (216e-2 - pv) / (v - pv), 6) AS place FROM crs WHERE crossing")
def w7_w8_down_crossings(spark, sf_dir):
    v = N.down_crossings(contacts.compression_velocity(gait(spark, sf_dir)), LEG, "v", 0.001 * HEIGHT_PX)
    return rounded(v.where("crossing").select("clip_id", "leg", "frame", "place"))


SAVGOL = """CASE WHEN n < 5 THEN {v} WHEN frame = 0 THEN (31 * {v} + 9 * {l1} - 3 * {l2} - 5 * {l3} + 3 * {l4}) / 35e0 WHEN frame = 1 THEN (9 * {p1} + 13 * {v} + 12 * {l1} + 6 * {l2} - 5 * {l3}) / 35e0
WHEN frame = n - 1 THEN (3 * {p4} - 5 * {p3} - 3 * {p2} + 9 * {p1} + 31 * {v}) / 35e0 WHEN frame = n - 2 THEN (-5 * {p3} + 6 * {p2} + 12 * {p1} + 13 * {v} + 9 * {l1}) / 35e0
ELSE (-3 * {p2} + 12 * {p1} + 17 * {v} + 12 * {l1} - 3 * {l2}) / 35e0 END"""


def _savgol(v: str) -> str:
    return SAVGOL.format(v=v, **{f"p{k}": f"lag({v}, {k}) OVER w" for k in range(1, 5)}, **{f"l{k}": f"lead({v}, {k}) OVER w" for k in range(1, 5)})


@query(f"s AS (SELECT *, count(*) OVER (PARTITION BY clip_id, leg) AS n FROM gait) SELECT clip_id, leg, frame, round({_savgol('toe_y')}, 6) AS smooth FROM s WINDOW w AS (PARTITION BY clip_id, leg ORDER BY frame)")
def w4_savgol(spark, sf_dir):
    return rounded(N.savgol5(gait(spark, sf_dir), LEG, "toe_y", "smooth").select("clip_id", "leg", "frame", "smooth"))


@query(
    """r AS (SELECT *, value IS NOT NULL AS flag FROM series), c AS (SELECT *, CASE WHEN lag(flag) OVER w IS DISTINCT FROM flag THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
g AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM c), q AS (SELECT clip_id, run, flag, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM g GROUP BY ALL)
SELECT clip_id, flag, start, stop, length, row_number() OVER (PARTITION BY clip_id ORDER BY flag DESC, length DESC, start) = 1 AND flag AS longest FROM q"""
)
def w10_w11_runs(spark, sf_dir):
    s = series(spark, sf_dir)
    r = N.runs(s, CLIP, F.col("value").isNotNull())
    best = N.longest_run(s, CLIP, F.col("value").isNotNull()).select("clip_id", "start", F.lit(True).alias("flag"), F.lit(True).alias("longest"))
    return r.join(best, ["clip_id", "start", "flag"], "left").select("clip_id", "flag", "start", "stop", "length", F.coalesce("longest", F.lit(False)).alias("longest"))


@query(
    """v AS (SELECT clip_id, frame, coalesce(value, 0e0) / 1000e0 AS s, count(*) OVER (PARTITION BY clip_id) AS n FROM series),
t AS (SELECT *, round_even(sum(s) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), 6) AS total FROM v),
b AS (SELECT * FROM t WHERE frame <= n - 20 OR (n <= 20 AND frame = 0) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY total DESC, frame) = 1)
SELECT clip_id, frame AS start, least(frame + 20, n) AS stop FROM b"""
)
def w12_best_window(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("s", F.coalesce("value", num(0)) / num(1000))
    return N.best_window(s, CLIP, "s", 20)


@query(
    """v AS (SELECT clip_id, frame, CASE WHEN clip_id % 5 = 0 THEN 0e0 ELSE coalesce(value, 0e0) / 1000e0 END AS s FROM series), m AS (SELECT *, sum(s) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / 21e0 AS m FROM v),
h AS (SELECT *, m > round_even(avg(m) OVER p + 5e-1 * stddev_pop(m) OVER p, 9) AS high FROM m WINDOW p AS (PARTITION BY clip_id)),
c AS (SELECT *, CASE WHEN lag(high) OVER w IS DISTINCT FROM high THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY clip_id ORDER BY frame)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM c),
q AS (SELECT clip_id, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM g WHERE high GROUP BY clip_id, run QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY length DESC, start) = 1),
n AS (SELECT clip_id, count(*) AS n FROM v GROUP BY 1)
SELECT clip_id, greatest(coalesce(start - 15, 0), 0) AS start, least(coalesce(stop + 15, n - 1), n - 1) AS stop, start IS NULL AS fallback FROM n LEFT JOIN q USING (clip_id)"""
)
def w13_active_window(spark, sf_dir):
    silent = F.col("clip_id") % 5 == 0
    s = series(spark, sf_dir).withColumn("s", F.when(silent, num(0)).otherwise(F.coalesce("value", num(0)) / num(1000)))
    return N.active_window(s, CLIP, "s")


@query(
    """u AS (SELECT clip_id, frame FROM series WHERE value IS NOT NULL), n AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 2 THEN 1 ELSE 0 END AS new FROM u WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
s AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS session FROM n)
SELECT clip_id, min(frame) AS start, max(frame) AS stop, count(*) AS n_usable, max(frame) - min(frame) + 1 >= 20 AS enough FROM s WHERE session = 0 GROUP BY 1"""
)
def w15_first_session(spark, sf_dir):
    return N.first_session(series(spark, sf_dir), CLIP, F.col("value").isNotNull(), max_gap=1, least=20)


@query(
    """s AS (SELECT clip_id, frame, value AS x, lag(value) OVER w AS p, lead(value) OVER w AS n FROM series WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
f AS (SELECT *, coalesce(abs(x - p) > 60 AND abs(n - x) > 60 AND abs(n - p) <= 60, false) AS spike FROM s)
SELECT clip_id, frame, spike, round(CASE WHEN spike THEN (p + n) / 2e0 ELSE x END, 6) AS fixed FROM f"""
)
def w16_replace_spikes(spark, sf_dir):
    return rounded(N.replace_spikes(series(spark, sf_dir), CLIP, "value", "fixed", 60.0).select("clip_id", "frame", "spike", "fixed"))


FILL = f"s AS (SELECT clip_id, frame, value, 3e-1 + (frame % 7) / 1e1 AS vis, CASE WHEN value IS NOT NULL THEN 3e-1 + (frame % 7) / 1e1 END AS kv FROM series), q AS (SELECT *, {ANCHORS.format(v='value')}, last_value(kv IGNORE NULLS) OVER b AS pvis, first_value(kv IGNORE NULLS) OVER a AS nvis FROM s {WINDOWS.format(by='clip_id')})"


def _seen_series(spark, sf_dir):
    return series(spark, sf_dir).withColumn("vis", num(0.3) + (F.col("frame") % 7).cast("double") / num(10))


@query(
    f"""{FILL}, f AS (SELECT *, coalesce(value IS NULL AND nt - pt - 1 <= 4 AND pvis >= 5e-1 AND nvis >= 5e-1, false) AS filled FROM q)
SELECT clip_id, frame, filled, round(CASE WHEN filled THEN {LERP} ELSE value END, 6) AS out, round(CASE WHEN filled THEN least(1e0, greatest(0e0, pvis + (nvis - pvis) * ((frame - pt)::DOUBLE / (nt - pt)::DOUBLE))) ELSE vis END, 6) AS out_vis FROM f"""
)
def w17_fill_gaps_linear(spark, sf_dir):
    return rounded(N.fill_gaps_linear(_seen_series(spark, sf_dir), CLIP, "value", "vis", "out").select("clip_id", "frame", "filled", "out", "out_vis"))


@query(
    f"""{FILL}, c AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM q),
f AS (SELECT *, CASE WHEN value IS NOT NULL THEN 0 WHEN coalesce(nt, n) - coalesce(pt, -1) - 1 <= 3 AND (pt IS NOT NULL OR nt IS NOT NULL) THEN 1 ELSE 2 END AS status FROM c)
SELECT clip_id, frame, status, round(CASE status WHEN 1 THEN {LERP} WHEN 2 THEN 0e0 ELSE value END, 6) AS out, round(CASE status WHEN 1 THEN 8e-1 * least(pvis, nvis) WHEN 2 THEN 0e0 ELSE vis END, 6) AS out_vis FROM f"""
)
def w19_w20_fill_for_network(spark, sf_dir):
    f = N.fill_short_gaps(_seen_series(spark, sf_dir), CLIP, "value", "vis", "out")
    missing = F.col("status") == 2
    return rounded(f.select("clip_id", "frame", "status", F.when(missing, num(0)).otherwise(F.col("out")).alias("out"), F.when(missing, num(0)).otherwise(F.col("out_vis")).alias("out_vis")))


def w17_w18_fill_gaps_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seen_series(spark, sf_dir)
    parts = [smoothing.fill_gaps(s, CLIP, "value", "vis", m).withColumn("method", F.lit(m)) for m in ("pchip", "cubic", "linear")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


query()(w17_w18_fill_gaps_spline)


@query()
def n4_kalman_outliers(spark, sf_dir):
    return rounded(smoothing.replace_outliers(series(spark, sf_dir), CLIP, "value", 60.0))


@query()
def n5_j11_j13_longest_track(spark, sf_dir):
    return tracks.longest_track(candidates(spark, sf_dir), tracks.Band(0.0, 60.0, 3, 0.3)).select("clip_id", "frame", "cand")


def candidates(spark, sf_dir):
    """Two candidates a frame, from neighbouring frames of series."""
    k = F.col("frame")
    e = series(spark, sf_dir).select("clip_id", F.floor(k / 2).alias("frame"), (k % 2).cast("int").alias("cand"), F.col("value").alias("x"), (num(0.2) + (k % 9).cast("double") / num(10)).alias("vis"), (num(100) + F.coalesce("value", num(0)) * num(3)).alias("area"))
    return e


@query()
def n5_composite_selection(spark, sf_dir):
    return rounded(tracks.selection(candidates(spark, sf_dir), tracks.Band(5.0, 60.0, 3, 0.3), "composite", (0.5, 0.3, 0.2)))


@query(
    """s AS (SELECT clip_id, frame, round_even(hip_y, 9) AS v FROM gait WHERE leg = 'L'), c AS (SELECT *, CASE WHEN lag(v) OVER w IS DISTINCT FROM v THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
f AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS flat FROM c), g AS (SELECT clip_id, flat, min(frame) AS a, max(frame) AS b, any_value(v) AS v FROM f GROUP BY ALL),
t AS (SELECT *, v > lag(v) OVER w AND v > lead(v) OVER w AS top FROM g WINDOW w AS (PARTITION BY clip_id ORDER BY flat))
SELECT clip_id, ((a + b) // 2)::BIGINT AS frame, v AS height FROM t WHERE top"""
)
def w24_peaks(spark, sf_dir):
    return N.peaks(gait(spark, sf_dir).where("leg = 'L'"), CLIP, "hip_y")


# contacts ------------------------------------------------------------------------------------------


@query(f"RECURSIVE {CONTACTS} SELECT c.clip_id, c.leg, c.frame, toe_off, round((toe_off - c.frame) / 60e0 * 1000e0, 6) AS gct_ms, round(least(1e0, greatest(2e-1, g.vis / 6e-1)), 6) AS confidence, row_number() OVER (PARTITION BY c.clip_id ORDER BY c.frame, c.leg) AS contact_no FROM con c JOIN gait g USING (clip_id, leg, frame)")
def n1_w21_w23_f4_contacts(spark, sf_dir):
    c = contacts.numbered(contacts.coarse_contacts(gait(spark, sf_dir), HEIGHT_PX, FPS))
    return rounded(c.select("clip_id", "leg", "frame", "toe_off", "gct_ms", "confidence", F.col("contact_no").cast("long").alias("contact_no")))


TOE = f"tn AS (SELECT clip_id, leg, frame, toe_y, vis, count(*) OVER (PARTITION BY clip_id, leg) AS n FROM gait), ts AS (SELECT *, {_savgol('toe_y')} AS ty FROM tn WINDOW w AS (PARTITION BY clip_id, leg ORDER BY frame)), tv AS (SELECT clip_id, leg, frame AS t, CASE WHEN lag(frame) OVER w IS NULL THEN lead(ty) OVER w - ty WHEN lead(frame) OVER w IS NULL THEN ty - lag(ty) OVER w ELSE (lead(ty) OVER w - lag(ty) OVER w) / 2e0 END AS v FROM ts WINDOW w AS (PARTITION BY clip_id, leg ORDER BY frame)), tp AS (SELECT *, lag(v) OVER (PARTITION BY clip_id, leg ORDER BY t) AS pv FROM tv)"
REFINED = f"""{CONTACTS}, {TOE},
hit AS (SELECT c.clip_id, c.leg, c.frame, arg_max(t - 1e0 + (2e0 - pv) / (v - pv), t) AS hit FROM con c JOIN tp USING (clip_id, leg) WHERE t BETWEEN greatest(1, c.frame - 2) + 1 AND least(c.last, c.frame + 10) AND pv > 2e0 AND v <= 2e0 GROUP BY ALL),
ic AS (SELECT c.*, greatest(coalesce(hit, c.frame), c.frame)::DOUBLE AS ic FROM con c LEFT JOIN hit USING (clip_id, leg, frame)), ie AS (SELECT *, trunc(ic)::BIGINT + 10 AS e FROM ic),
lift AS (SELECT c.clip_id, c.leg, c.frame, arg_min(t - 1e0 + (-4e0 - pv) / (v - pv), t) AS lift FROM ie c JOIN tp USING (clip_id, leg) WHERE t BETWEEN greatest(1, e - 5) AND least(c.last, e + 5) - 1 AND pv > -4e0 AND v <= -4e0 GROUP BY ALL),
ro AS (SELECT c.*, coalesce(lift, toe_off)::DOUBLE AS too FROM ie c LEFT JOIN lift USING (clip_id, leg, frame)), rm AS (SELECT *, (too - ic) / 60e0 * 1000e0 AS ms FROM ro),
ref AS (SELECT clip_id, leg, frame, CASE WHEN ms > 80 AND ms < 400 THEN ic ELSE frame::DOUBLE END AS contact_frame, CASE WHEN ms > 80 AND ms < 400 THEN too ELSE toe_off::DOUBLE END AS toe_off_frame,
  CASE WHEN ms > 80 AND ms < 400 THEN ms ELSE (toe_off - frame) / 60e0 * 1000e0 END AS refined_ms, CASE WHEN ms > 80 AND ms < 400 THEN 'refined' ELSE 'coarse' END AS detection_method FROM rm)"""


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gait(spark, sf_dir)
    v = N.gradient(N.savgol5(g, LEG, "toe_y", "ty"), LEG, "ty", "v")
    v = v.select(*LEG, "frame", "v", F.lag("v").over(W.partitionBy(*LEG).orderBy("frame")).alias("pv"))
    return contacts.refined(contacts.coarse_contacts(g, HEIGHT_PX, FPS), v, 2.0, -4.0, "heel", FPS)


@query(f"RECURSIVE {REFINED} SELECT clip_id, leg, frame, round(contact_frame, 6) AS contact_frame, round(toe_off_frame, 6) AS toe_off_frame, round(refined_ms, 6) AS refined_ms, detection_method FROM ref")
def x1_x2_w9_j4_f5_refined(spark, sf_dir):
    return rounded(_refined(spark, sf_dir).select(*LEG, "frame", "contact_frame", "toe_off_frame", "refined_ms", "detection_method"))


@query(f"RECURSIVE {REFINED} SELECT clip_id, CASE WHEN grouping(leg) = 0 THEN leg END AS leg, count(*) AS n, count(*) FILTER (detection_method = 'refined') AS n_refined FROM ref GROUP BY GROUPING SETS ((clip_id), (clip_id, leg))")
def a23_detection_summary(spark, sf_dir):
    return contacts.detection_summary(_refined(spark, sf_dir))


@query(
    f"""RECURSIVE {REFINED}, o AS (SELECT *, lag(leg) OVER w = leg AS same, contact_frame - lag(contact_frame) OVER w AS gap FROM ref WINDOW w AS (PARTITION BY clip_id ORDER BY frame, leg)),
a AS (SELECT clip_id, count(*) AS n, count(*) FILTER (detection_method = 'refined') AS n_refined, count(*) FILTER (same) AS n_same, avg(gap) AS mean_gap, stddev_pop(gap) AS sd FROM o GROUP BY 1)
SELECT clip_id, n, n_refined, n_same, round(mean_gap, 6) AS mean_gap, round(sd / mean_gap, 6) AS cv, n >= 3 AND n_same <= n * 2e-1 AS valid FROM a"""
)
def a18_w22_j9_pattern_check(spark, sf_dir):
    return rounded(contacts.pattern_check(_refined(spark, sf_dir)))


@query(
    f"""RECURSIVE {REFINED}, o AS (SELECT clip_id, lead(contact_frame) OVER (PARTITION BY clip_id ORDER BY frame, leg) - contact_frame AS gap FROM ref), v AS (SELECT * FROM o WHERE gap > 9 AND gap < 30),
m AS (SELECT *, median(gap) OVER p AS m, count(*) OVER p AS n FROM v WINDOW p AS (PARTITION BY clip_id)), k AS (SELECT * FROM m WHERE n < 3 OR gap BETWEEN m / 15e-1 AND m * 15e-1),
c AS (SELECT clip_id, avg(3600e0 / gap) AS cadence_spm, stddev_pop(3600e0 / gap) AS cadence_sd FROM k GROUP BY 1),
t AS (SELECT clip_id, coalesce(avg(refined_ms) FILTER (detection_method = 'refined'), avg(refined_ms)) AS gct_ms FROM ref GROUP BY 1)
SELECT clip_id, round(cadence_spm, 6) AS cadence_spm, round(cadence_sd, 6) AS cadence_sd, round(gct_ms, 6) AS gct_ms FROM t LEFT JOIN c USING (clip_id)"""
)
def a10_a11_cadence_and_contact_time(spark, sf_dir):
    c = F.col("c")
    r = metrics.contact_arrays(_refined(spark, sf_dir)).select("clip_id", metrics.cadence_of(c, FPS).alias("cad"), metrics.contact_time_of(c).alias("gct"))
    return rounded(r.select("clip_id", F.col("cad.spm").alias("cadence_spm"), F.col("cad.sd").alias("cadence_sd"), F.col("gct.ms").alias("gct_ms")))


@query(f"RECURSIVE {REFINED} SELECT clip_id, leg, round(coalesce(avg(refined_ms) FILTER (detection_method = 'refined'), avg(refined_ms)), 6) AS gct_ms, round(CASE WHEN count(*) FILTER (detection_method = 'refined') > 0 THEN stddev_pop(refined_ms) FILTER (detection_method = 'refined') ELSE stddev_pop(refined_ms) END, 6) AS gct_sd FROM ref GROUP BY ALL")
def a12_contact_time_by_leg(spark, sf_dir):
    return rounded(metrics.contact_time(_refined(spark, sf_dir), LEG))


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gait(spark, sf_dir).where("leg = 'L'").select("clip_id", "frame", "hip_x", "hip_y")


HIP = f"hp AS (SELECT clip_id, frame, coalesce(hip_x, avg(hip_x) OVER (PARTITION BY clip_id)) AS hf FROM gait WHERE leg = 'L'), {_gauss('hp', 'clip_id', 'hf', 'hs', '2e0')}"


@query(
    f"""RECURSIVE {REFINED}, {HIP}, pr AS (SELECT clip_id, leg, frame, lead(frame, 2) OVER w AS f2, lead(leg, 2) OVER w AS l2, lead(frame, 1) OVER w AS f1 FROM ref WINDOW w AS (PARTITION BY clip_id ORDER BY frame, leg)),
s AS (SELECT p.clip_id, f2 - p.frame AS gap, abs(b.hs - a.hs) / 500e0 AS m FROM pr p JOIN hs_x a ON a.clip_id = p.clip_id AND a.frame = p.frame JOIN hs_x b ON b.clip_id = p.clip_id AND b.frame = f2 WHERE leg = l2),
k AS (SELECT *, median(gap) OVER (PARTITION BY clip_id) AS md FROM s), a AS (SELECT clip_id, avg(m) AS stride_length_m, stddev_pop(m) AS stride_sd, count(*) AS n_strides FROM k WHERE gap <= 15e-1 * md GROUP BY 1),
t AS (SELECT p.clip_id, avg(abs(b.hs - a.hs) / 500e0) AS step_length_m FROM pr p JOIN hs_x a ON a.clip_id = p.clip_id AND a.frame = p.frame JOIN hs_x b ON b.clip_id = p.clip_id AND b.frame = f1 GROUP BY 1)
SELECT clip_id, round(stride_length_m, 6) AS stride_length_m, round(stride_sd, 6) AS stride_sd, n_strides, round(step_length_m, 6) AS step_length_m FROM t LEFT JOIN a USING (clip_id)"""
)
def a13_a14_j7_stride_and_step(spark, sf_dir):
    out = metrics.stride_and_step(_refined(spark, sf_dir), _path(spark, sf_dir), 500.0)
    return rounded(out.select("clip_id", "stride_length_m", "stride_sd", "n_strides", "step_length_m"))


@query()
def a15_a21_all_metrics(spark, sf_dir):
    return rounded(metrics.all_metrics(_refined(spark, sf_dir), _path(spark, sf_dir), FPS, 5.0, 90.0))


def _flat_metrics(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("clip_id"), (num(150) + (c("c_custkey") % 80).cast("double")).alias("cadence_spm"), F.when(c("c_custkey") % 7 != 0, num(100) + (c("c_custkey") % 200).cast("double")).alias("gct_ms"),
        (num(2) + (c("c_custkey") % 40).cast("double") / num(10)).alias("stride_length_m"), ((c("c_custkey") % 20).cast("double")).alias("oscillation_cm"),
    )


FLAT = "m AS (SELECT c_custkey AS clip_id, 150e0 + c_custkey % 80 AS cadence_spm, CASE WHEN c_custkey % 7 <> 0 THEN 100e0 + c_custkey % 200 END AS gct_ms, 2e0 + (c_custkey % 40) / 1e1 AS stride_length_m, (c_custkey % 20)::DOUBLE AS oscillation_cm FROM customer)"


def _warn(name: str) -> str:
    lo, hi = metrics.METRIC_RANGES[name]
    return f"CASE WHEN {name} IS NULL THEN '{name}: could not be calculated' WHEN {name} < {lo}e0 THEN printf('{name}: %.2f below expected range [{lo}, {hi}]', {name}) WHEN {name} > {hi}e0 THEN printf('{name}: %.2f above expected range [{lo}, {hi}]', {name}) END"


@query(
    f"WITH {FLAT}, w AS (SELECT clip_id, list_filter([{', '.join(_warn(k) for k in ('cadence_spm', 'gct_ms', 'stride_length_m', 'oscillation_cm'))}], lambda x: x IS NOT NULL) AS w FROM m) SELECT clip_id, coalesce(array_to_string(w, '; '), '') AS warnings, len(w) = 0 AS valid, round(25e-2 + 2e-1 + 25e-2 * 8e-1 + 15e-2 * greatest(0e0, 1e0 - len(w) / 1e1) + 15e-2 * least(1e0, (clip_id % 9) / 6e0), 6) AS score FROM w"
)
def f8_a19_validation(spark, sf_dir):
    m = _flat_metrics(spark, sf_dir)
    w = m.withColumn("w", metrics.warnings(m))
    score = metrics.quality_score(num(1), num(0.9), num(0.8), F.size("w").cast("double"), (F.col("clip_id") % 9).cast("double"))
    return rounded(w.select("clip_id", F.array_join("w", "; ").alias("warnings"), (F.size("w") == 0).alias("valid"), score.alias("score")))


def _elite(k: str) -> str:
    lo, hi = metrics.ELITE[k]
    pad = 0.15 * (hi - lo)
    return f"SELECT clip_id, '{k}' AS metric, round({k}, 6) AS value, CASE WHEN {k} IS NULL THEN 'n/a' WHEN {k} < {lo}::DOUBLE THEN 'below' WHEN {k} > {hi}::DOUBLE THEN 'above' ELSE 'in range' END AS verdict, CASE WHEN {k} IS NOT NULL THEN round(least(100e0, greatest(0e0, ({k} - {lo - pad!r}::DOUBLE) / {hi - lo + 2 * pad!r}::DOUBLE * 100e0)), 6) END AS marker FROM m"


@query(f"WITH {FLAT} " + " UNION ALL ".join(_elite(k) for k in metrics.ELITE))
def f12_r1_r2_r6_elite_report(spark, sf_dir):
    return rounded(metrics.elite_report(_flat_metrics(spark, sf_dir)))


@query()
def n2_pruned_contacts(spark, sf_dir):
    g = gait(spark, sf_dir)
    c = contacts.coarse_contacts(g, HEIGHT_PX, FPS)
    extra = c.where("frame % 3 = 0").withColumns({"leg": F.when(F.col("leg") == "L", "R").otherwise("L"), "frame": F.col("frame") + 4})
    both = c.unionByName(extra).dropDuplicates([*LEG, "frame"])
    foot = g.select(*LEG, "frame", F.when(F.col("vis") >= 0.5, F.col("toe_y")).alias("foot_y"))
    return rounded(contacts.pruned(both.join(foot, [*LEG, "frame"], "left").select(*LEG, "frame", F.col("frame").cast("double").alias("ic"), "foot_y"), 12.0, 36.0))


@query()
def n3_missing_contacts(spark, sf_dir):
    g = gait(spark, sf_dir)
    v = N.gradient(N.savgol5(g, LEG, "toe_y", "ty"), LEG, "ty", "v")
    feet = v.select(*LEG, "frame", "v", F.lag("v").over(W.partitionBy(*LEG).orderBy("frame")).alias("pv"), (F.col("vis") >= 0.5).alias("seen"))
    c = contacts.coarse_contacts(g, HEIGHT_PX, FPS).where("frame % 5 <> 0")
    return rounded(contacts.missing_contacts(c, feet, 18.0, 2.0))


@query()
def x4_toe_off_by_position(spark, sf_dir):
    g = gait(spark, sf_dir)
    feet = g.select(*LEG, "frame", "toe_y", (F.col("vis") >= 0.5).alias("seen"))
    out = contacts.toe_off_by_position(contacts.coarse_contacts(g, HEIGHT_PX, FPS), feet, FPS, 10.0)
    return rounded(out.select(*LEG, "frame", "position_toe_off"))


@query()
def a16_a17_strike_pattern(spark, sf_dir):
    g = gait(spark, sf_dir)
    w = W.partitionBy(*LEG).orderBy("frame")
    delta = F.col("toe_y") - num(1740)
    feet = g.select(*LEG, "frame", delta.alias("delta"), "vis", F.lag(delta).over(w).alias("pdelta"), F.lag("vis").over(w).alias("pvis"))
    s = contacts.strikes(contacts.coarse_contacts(g, HEIGHT_PX, FPS), feet, 0.01 * HEIGHT_PX)
    k = F.col("clip_id")
    return contacts.clip_strike(s, F.when(k % 2 == 0, "800m").otherwise("steady"), F.when(k % 3 == 0, "track_spike").when(k % 3 == 1, "neutral"))


@query("""q AS (SELECT *, value IS NOT NULL AS f FROM series), c AS (SELECT *, CASE WHEN lag(f) OVER w IS DISTINCT FROM f THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY clip_id ORDER BY frame)), g AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM c),
r AS (SELECT clip_id, min(frame) AS a, max(frame) AS b, count(*) AS n FROM g WHERE f GROUP BY clip_id, run QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, a) = 1)
SELECT clip_id, round(abs(regr_slope(hip_x, g.frame)) * 12e-2, 5) AS velocity_ms FROM gait g JOIN r USING (clip_id) WHERE leg = 'L' AND g.frame BETWEEN a AND b AND n >= 10 GROUP BY 1""")
def a8_hip_velocity(spark, sf_dir):
    return rounded(metrics.hip_velocity(_path(spark, sf_dir), FPS, 500.0), 5)


@query(
    f"""RECURSIVE {REFINED}, ee AS (SELECT clip_id, leg, frame, last, toe_off, trunc(CASE WHEN ms > 80 AND ms < 400 THEN ic ELSE frame::DOUBLE END)::BIGINT AS i FROM rm)
SELECT e.clip_id, e.leg, e.frame, round(coalesce(arg_min(t - 1e0 + (-2e0 - pv) / (v - pv), t) FILTER (t BETWEEN greatest(1, i + 4, i + 7) AND least(e.last, i + 16) - 1 AND pv > -2e0 AND v <= -2e0), e.toe_off)::DOUBLE, 6) AS speed_toe_off
FROM ee e JOIN tp ON tp.clip_id = e.clip_id AND tp.leg = e.leg GROUP BY e.clip_id, e.leg, e.frame, e.toe_off"""
)
def x3_toe_off_by_speed(spark, sf_dir):
    v = N.gradient(N.savgol5(gait(spark, sf_dir), LEG, "toe_y", "ty"), LEG, "ty", "v")
    v = v.select(*LEG, "frame", "v", F.lag("v").over(W.partitionBy(*LEG).orderBy("frame")).alias("pv"))
    c = _refined(spark, sf_dir).select(*LEG, "frame", "last", "toe_off", F.col("contact_frame").alias("ic"))
    return rounded(contacts.toe_off_by_speed(c, v, -2.0, FPS).select(*LEG, "frame", "speed_toe_off"))


@query(
    f"WITH {FLAT}, r AS (SELECT clip_id % 50 AS batch, row_number() OVER (PARTITION BY clip_id % 50 ORDER BY clip_id) AS run, count(*) OVER (PARTITION BY clip_id % 50) AS k, clip_id, cadence_spm, gct_ms, stride_length_m, oscillation_cm FROM m) SELECT * EXCLUDE (k) FROM r WHERE k > 1"
)
def r3_compare_runs(spark, sf_dir):
    m = _flat_metrics(spark, sf_dir).withColumn("batch", F.col("clip_id") % 50)
    return metrics.compare_runs(m, "batch", ["cadence_spm", "gct_ms", "stride_length_m", "oscillation_cm"])


# body ----------------------------------------------------------------------------------------------


def _sql_wide(names: dict[str, int], fields: str = "xy") -> str:
    keys = {"x": "x", "y": "y", "v": "vis"}
    return "SELECT clip_id, frame, " + ", ".join(f"max({keys[f]}) FILTER (lm = {lm}) AS {n}_{keys[f]}" for n, lm in names.items() for f in fields) + " FROM pose GROUP BY ALL"


def _dist(a: str, b: str) -> str:
    return f"sqrt(({a}_x - {b}_x) * ({a}_x - {b}_x) + ({a}_y - {b}_y) * ({a}_y - {b}_y))"


def _both(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END"


SEG = f"""wd AS ({_sql_wide({'nose': 0, **body.JOINTS})}), ms AS (SELECT *, (l_shoulder_x + r_shoulder_x) / 2e0 AS s_x, (l_shoulder_y + r_shoulder_y) / 2e0 AS s_y, (l_hip_x + r_hip_x) / 2e0 AS h_x, (l_hip_y + r_hip_y) / 2e0 AS h_y, (l_knee_y + r_knee_y) / 2e0 AS k_y FROM wd),
sg AS (SELECT *, {_dist('s', 'h')} AS torso, {_both(_dist('l_hip', 'l_knee'), _dist('r_hip', 'r_knee'))} AS thigh, {_both(_dist('l_knee', 'l_ankle'), _dist('r_knee', 'r_ankle'))} AS shank FROM ms)"""


@query(f"{SEG} SELECT clip_id, frame, round(coalesce((l_hip_x + r_hip_x) / 2e0, l_hip_x, r_hip_x), 6) AS hip_any, round(h_x, 6) AS hip_both, round(torso, 6) AS torso, round(thigh, 6) AS thigh, round(shank, 6) AS shank FROM sg")
def p1_p2_p4_segments(spark, sf_dir):
    f = body.segments(body.wide(pose(spark, sf_dir), {"nose": 0, **body.JOINTS}, "x", "y"))
    a, b = F.col("l_hip_x"), F.col("r_hip_x")
    return rounded(f.select("clip_id", "frame", S.midpoint_any(a, b).alias("hip_any"), S.midpoint_both(a, b).alias("hip_both"), "torso", "thigh", "shank"))


STANDING_SQL = f"""st AS (SELECT clip_id, frame, lm, 960e0 + (x - 960e0) * 4e-2 AS x, {' '.join(['CASE lm', *(f'WHEN {k} THEN {v}e0' for k, v in STANDING.items()), 'END'])} + (y - 200e0 - 50e0 * lm) * 4e-1 AS y, vis FROM pose WHERE lm IN {tuple(STANDING)}),
stood AS (SELECT clip_id, frame, lm, x, CASE WHEN frame % 9 = 4 THEN 1000e0 - y ELSE y END AS y, vis FROM st)"""


@query(
    f"""{STANDING_SQL}, {SEG.replace('FROM pose', 'FROM stood')}, g AS (SELECT clip_id, frame, nose_y < s_y AND s_y < h_y AND h_y < k_y AS ord, torso IS NOT NULL AND thigh IS NOT NULL AND shank IS NOT NULL AS known,
 array_to_string(list_filter([CASE WHEN abs(torso / 500e0 - 3e-1) > 3e-1 * 2e-1 THEN 'torso' END, CASE WHEN abs(thigh / 500e0 - 245e-3) > 245e-3 * 3e-1 THEN 'thigh' END, CASE WHEN abs(shank / 500e0 - 246e-3) > 246e-3 * 3e-1 THEN 'shank' END], lambda x: x IS NOT NULL), '+') AS off FROM sg)
SELECT clip_id, frame, CASE WHEN ord IS NULL OR NOT known THEN 'missing' WHEN NOT ord THEN 'order' WHEN off <> '' THEN 'ratios:' || off ELSE 'ok' END AS anatomy_reason FROM g"""
)
def f1_anatomy_gate(spark, sf_dir):
    f = body.segments(body.wide(standing(spark, sf_dir), {"nose": 0, **body.JOINTS}, "x", "y"))
    return body.anatomy_gate(f, num(500)).select("clip_id", "frame", "anatomy_reason")


@query(
    f"""wd AS ({_sql_wide(body.both(hip=body.HIP), 'x')}), h AS (SELECT clip_id, frame, CASE WHEN clip_id % 3 <> 1 OR frame % 7 = 3 THEN coalesce((l_hip_x + r_hip_x) / 2e0, l_hip_x, r_hip_x) END AS x FROM wd),
m AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY clip_id ORDER BY frame)) AS moved FROM h), p AS (SELECT *, max(moved) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peak FROM m)
SELECT clip_id, frame, round(peak, 6) AS peak, CASE WHEN x IS NULL THEN 'no_detection' WHEN peak IS NULL THEN 'no_velocity_context' WHEN peak < 150e0 THEN 'below_velocity_threshold' ELSE 'moving' END AS reason FROM p"""
)
def f2_w5_w6_a25_motion_filter(spark, sf_dir):
    lone = (F.col("clip_id") % 3 == 1) & (F.col("frame") % 7 != 3)
    f = body.wide(pose(spark, sf_dir).withColumn("x", F.when(~lone, F.col("x"))), body.both(hip=body.HIP), "x")
    return rounded(body.motion_filter(f, num(180), FPS).select("clip_id", "frame", "peak", "reason"))


@query(
    """f AS (SELECT clip_id, frame, avg(vis) FILTER (lm IN (23, 24)) AS hip, avg(vis) FILTER (lm IN (27, 28)) AS ankle, bool_or(x IS NOT NULL) FILTER (lm IN (23, 24)) AS seen FROM pose GROUP BY ALL)
SELECT clip_id, count(*) AS n_frames, count(*) FILTER (seen) AS n_detected, round(count(*) FILTER (seen) / count(*)::DOUBLE, 6) AS detection_rate, count(*) FILTER (hip < 5e-1) AS n_low, round(avg(hip), 6) AS hip_vis, round(avg(ankle), 6) AS ankle_vis FROM f GROUP BY 1"""
)
def a1_pose_quality(spark, sf_dir):
    return rounded(body.quality(pose(spark, sf_dir)))


SIDES = """mv AS (SELECT clip_id, lm, avg(vis) AS m FROM pose WHERE lm IN (11, 12, 23, 24, 25, 26, 27, 28) GROUP BY ALL),
s4 AS (SELECT clip_id, round_even(sum(m) FILTER (lm % 2 = 1), 9) AS l, round_even(sum(m) FILTER (lm % 2 = 0), 9) AS r, round_even(sum(m) FILTER (lm % 2 = 1 AND lm <> 25), 9) AS l3, round_even(sum(m) FILTER (lm % 2 = 0 AND lm <> 26), 9) AS r3 FROM mv GROUP BY 1),
sides AS (SELECT clip_id, CASE WHEN l >= r THEN 'L' ELSE 'R' END AS calibration_side, CASE WHEN l + r > 0 THEN greatest(l, r) / (l + r) ELSE 5e-1 END AS confidence, CASE WHEN l >= r THEN 'left' ELSE 'right' END AS camera_side, CASE WHEN l3 > r3 THEN 'left' ELSE 'right' END AS footage_side FROM s4)"""


@query(f"{SIDES} SELECT clip_id, calibration_side, round(confidence, 6) AS confidence, camera_side, footage_side FROM sides")
def a2_a3_a4_near_sides(spark, sf_dir):
    return rounded(body.near_sides(pose(spark, sf_dir)))


@query(
    f"""{SIDES}, nq AS (SELECT clip_id, frame, vis AS vq, count(*) OVER (PARTITION BY clip_id) AS n FROM pose JOIN sides USING (clip_id) WHERE lm = CASE footage_side WHEN 'left' THEN 23 ELSE 24 END),
nw AS (SELECT *, floor(2e-1 * n)::BIGINT AS lo, floor(8e-1 * n)::BIGINT AS hi FROM nq),
na AS (SELECT clip_id, n, lo, hi, min(frame) FILTER (frame >= lo AND frame < hi AND vq >= 3e-1) AS f, max(frame) FILTER (frame >= lo AND frame < hi AND vq >= 3e-1) AS l, first(frame ORDER BY vq DESC, frame) FILTER (frame >= lo AND frame < hi) AS b FROM nw GROUP BY ALL),
nc AS (SELECT *, CASE WHEN lo >= hi THEN n // 2 WHEN f IS NOT NULL THEN lo + (f + l - 2 * lo) // 2 ELSE b END AS anchor FROM na),
ng AS (SELECT clip_id, frame, vq >= 3e-1 AS p, frame - row_number() OVER (PARTITION BY clip_id, vq >= 3e-1 ORDER BY frame) AS g FROM nq),
nr AS (SELECT clip_id, g, min(frame) AS s, count(*) AS k FROM ng WHERE p GROUP BY clip_id, g QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY k DESC, s) = 1),
nd AS (SELECT nc.clip_id, anchor, s + k // 2 AS mid FROM nc LEFT JOIN nr USING (clip_id)),
nz AS (SELECT nd.clip_id, anchor, mid, max(vq) FILTER (nq.frame = anchor) AS qa, first(nq.frame ORDER BY vq DESC, nq.frame) FILTER (nq.frame BETWEEN mid - 5 AND mid + 5) AS again FROM nd JOIN nq USING (clip_id) GROUP BY ALL)
SELECT clip_id, CASE WHEN qa < 3e-1 AND mid IS NOT NULL THEN again ELSE anchor END AS anchor FROM nz"""
)
def n6_anchor_frames(spark, sf_dir):
    p = pose(spark, sf_dir)
    near = p.where("lm in (23, 24)").join(body.near_sides(p), "clip_id").where(F.col("lm") == F.when(F.col("footage_side") == "left", 23).otherwise(24))
    return body.anchor_frames(near.select("clip_id", "frame", F.col("vis").alias("quality")))


@query(
    """s AS (SELECT clip_id, frame, k AS cand, avg(vis * (1e0 - (frame + k) % 3 / 1e1)) AS m FROM pose, (SELECT unnest([0, 1, 2]) AS k) WHERE lm < 17 GROUP BY ALL)
SELECT clip_id, frame, cand FROM s QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY round_even(m, 9) DESC, cand) = 1"""
)
def s6_likeliest_candidate(spark, sf_dir):
    c = pose(spark, sf_dir).select("clip_id", "frame", F.col("lm").alias("kp"), "vis", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cand"))
    score = F.col("vis") * (num(1) - ((F.col("frame") + F.col("cand")) % 3).cast("double") / num(10))
    return body.likeliest_candidate(c.select("clip_id", "frame", "cand", "kp", score.alias("score")))


@query()
def a5_a6_a7_f9_calibration(spark, sf_dir):
    p = pose(spark, sf_dir)
    sides = body.near_sides(p)
    return rounded(body.calibration(body.measured_segments(p, sides), sides, 175.0, 2.5))


@query(f"wd AS ({_sql_wide(body.both(hip=body.HIP), 'x')}), a AS (SELECT clip_id, regr_slope((l_hip_x + r_hip_x) / 2e0, frame::DOUBLE) AS slope, count(l_hip_x + r_hip_x) AS n FROM wd GROUP BY 1) SELECT clip_id, round(slope, 6) AS slope, n, CASE WHEN n >= 10 AND round_even(slope, 9) > 0 THEN 'LR' ELSE 'RL' END AS direction FROM a")
def a9_direction(spark, sf_dir):
    return rounded(body.directions(body.wide(pose(spark, sf_dir), body.both(hip=body.HIP), "x")))


@query("SELECT clip_id, frame, round((max(x) - min(x)) * (max(y) - min(y)), 4) AS area FROM pose GROUP BY ALL")
def a24_bounding_area(spark, sf_dir):
    return rounded(body.bounding_area(pose(spark, sf_dir)), 4)


COMBINE = """b AS (SELECT clip_id, frame, lm, x + 10e0 * (frame % 5) AS bx, y AS by_, CASE WHEN frame % 3 = 0 THEN 5e-1 ELSE vis END AS bvis FROM pose WHERE frame % 11 <> 3),
p AS (SELECT * FROM pose JOIN b USING (clip_id, frame, lm)), f AS (SELECT clip_id, frame, avg(sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_))) AS apart, bool_or(x IS NOT NULL) FILTER (lm IN (23, 24)) AS a_in, bool_or(bx IS NOT NULL) FILTER (lm IN (23, 24)) AS b_in,
 avg(vis) FILTER (lm IN (23, 24)) AS av, avg(bvis) FILTER (lm IN (23, 24)) AS bv FROM p GROUP BY ALL),
c AS (SELECT clip_id, frame, CASE WHEN a_in AND b_in THEN CASE WHEN apart <= 3e-2 * 500e0 THEN 'avg' WHEN round_even(av, 9) >= round_even(bv, 9) THEN 'fwd' ELSE 'rev' END WHEN a_in THEN 'fwd' WHEN b_in THEN 'rev' ELSE 'none' END AS chosen FROM f)"""


@query(f"{COMBINE} SELECT p.clip_id, p.frame, lm, chosen, round(CASE chosen WHEN 'avg' THEN (x + bx) / 2e0 WHEN 'fwd' THEN x WHEN 'rev' THEN bx END, 6) AS x, round(CASE chosen WHEN 'avg' THEN (y + by_) / 2e0 WHEN 'fwd' THEN y WHEN 'rev' THEN by_ END, 6) AS y, round(coalesce(CASE chosen WHEN 'avg' THEN (vis + bvis) / 2e0 WHEN 'fwd' THEN vis WHEN 'rev' THEN bvis END, 0e0), 6) AS vis FROM p JOIN c USING (clip_id, frame)")
def c1_j1_j3_combine_two(spark, sf_dir):
    p = pose(spark, sf_dir)
    b = p.where("frame % 11 <> 3").select("clip_id", "frame", "lm", (F.col("x") + num(10) * (F.col("frame") % 5).cast("double")).alias("x"), "y", F.when(F.col("frame") % 3 == 0, num(0.5)).otherwise(F.col("vis")).alias("vis"))
    return rounded(body.combine_two(p, b, 500.0))


@query(
    """f AS (SELECT clip_id, frame, avg(vis) FILTER (lm IN (23, 24)) AS v FROM pose GROUP BY ALL), s AS (SELECT clip_id, frame, k, ['fwd', 'rev', 'seed'][k] AS pass, v * (1e0 - (frame + k) % 3 / 1e1) AS v, (frame + k) % 4 <> 0 AS ok FROM f, (SELECT unnest([1, 2, 3]) AS k))
SELECT clip_id, frame, pass AS chosen FROM s WHERE ok QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY round_even(v, 9) DESC, k) = 1"""
)
def c2_j2_o2_choose_three(spark, sf_dir):
    f = pose(spark, sf_dir).groupBy("clip_id", "frame").agg(F.avg(F.when(F.col("lm").isin(23, 24), F.col("vis"))).alias("v"))
    s = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pass_no"))
    k = F.col("frame") + F.col("pass_no")
    name = F.element_at(F.array(F.lit("fwd"), F.lit("rev"), F.lit("seed")), F.col("pass_no"))
    return body.choose_three(s.select("clip_id", "frame", "pass_no", name.alias("pass"), (k % 4 != 0).alias("ok"), (F.col("v") * (num(1) - (k % 3).cast("double") / num(10))).alias("hip_vis")))


@query(
    """n AS (SELECT clip_id, count(*)::INTEGER AS n FROM series GROUP BY 1), s AS (SELECT *, CASE WHEN n < 60 THEN 'rejected' WHEN n < 70 THEN 'padded' ELSE 'cropped' END AS status FROM n)
SELECT clip_id, status, i::INTEGER AS i, CASE status WHEN 'padded' THEN least(greatest(i - (70 - n) // 2, 0), n - 1) ELSE i + (n - 70) // 2 END::BIGINT AS frame FROM s, (SELECT unnest(range(70)) AS i) WHERE status <> 'rejected'"""
)
def x9_window_index(spark, sf_dir):
    return body.windowed_index(series(spark, sf_dir), 70, 60)


@query("""RECURSIVE """ + CONTACTS + """ SELECT g.clip_id, g.frame, g.leg FROM gait g JOIN con c ON c.clip_id = g.clip_id AND c.leg = g.leg AND g.frame BETWEEN c.frame AND c.toe_off""")
def j5_active_contacts(spark, sf_dir):
    g = gait(spark, sf_dir)
    c = contacts.coarse_contacts(g, HEIGHT_PX, FPS)
    return contacts.near_frames(c.select(*LEG, "frame", "toe_off"), g.select(*LEG, "frame"), F.col("frame"), F.col("toe_off")).select("clip_id", F.col("t").alias("frame"), "leg")


@query("SELECT a.clip_id, a.frame, a.lm AS i, b.lm AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS length FROM (VALUES (11, 13), (23, 25), (25, 27)) e(i, j) JOIN pose a ON a.lm = i JOIN pose b ON b.lm = j AND b.clip_id = a.clip_id AND b.frame = a.frame WHERE least(a.vis, b.vis) >= 2e-1")
def j6_bones(spark, sf_dir):
    p = pose(spark, sf_dir)
    bones = spark.createDataFrame([(11, 13), (23, 25), (25, 27)], "i int, j int")
    a = p.join(F.broadcast(bones), p.lm == F.col("i")).select("clip_id", "frame", "i", "j", "x", "y", "vis")  # three fixed rows
    b = p.select("clip_id", "frame", F.col("lm").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("vis").alias("bvis"))
    out = a.join(b, ["clip_id", "frame", "j"]).where(F.least("vis", "bvis") >= 0.2)
    return rounded(out.select("clip_id", "frame", "i", "j", S.length_2d(F.col("x"), F.col("y"), F.col("bx"), F.col("by")).alias("length")))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events GROUP BY user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts)".replace("user_id, event_type, count", "event_type, count").replace("GROUP BY user_id, event_type", "GROUP BY event_type"))
def ext_tumbling_windows(spark, sf_dir):
    from ..streaming.sessions import tumbling

    out = tumbling(table(spark, sf_dir, "events"))
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.col("start").cast("timestamp_ntz").alias("start"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def ext_sessions(spark, sf_dir):
    from ..streaming.sessions import sessions

    out = sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))
