"""Queries of the scalar functions, predicates, sources and pace prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import num
from ..operators import pace
from ..sources import metadata
from ..sources.tables import FPS, pose, table
from .registry import query, rounded

LINE = "SELECT l_orderkey, l_linenumber, 160e0 + l_quantity AS cad, 100e0 + 1500e0 * l_tax AS gct, 2e0 + 20e0 * l_discount AS stride, l_extendedprice / 9999e0 AS osc FROM lineitem"


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (num(160) + c("l_quantity")).alias("cad"), (num(100) + num(1500) * c("l_tax")).alias("gct"), (num(2) + num(20) * c("l_discount")).alias("stride"), (c("l_extendedprice") / num(9999)).alias("osc")
    )


@query(
    f"""WITH l AS ({LINE}), f AS (SELECT *, CASE WHEN 60000e0 / cad - gct >= 0 THEN 60000e0 / cad - gct END AS flight, stride * cad / 2e0 / 60e0 AS v FROM l)
SELECT l_orderkey, l_linenumber, round(flight, 6) AS flight, round(gct / (gct + flight), 6) AS duty, round(v, 6) AS velocity,
  CAST(CAST(floor(1000e0 / v / 60e0) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(1000e0 / v - 60e0 * floor(1000e0 / v / 60e0)) AS BIGINT) AS VARCHAR), 2, '0') AS pace,
  round(osc / (stride * 100e0) * 100e0, 6) AS rei, round(stride / 9e-1, 6) AS leg_ratio, round(flight / (gct + flight), 6) AS flight_share, round(v * 36e-1, 6) AS kmh FROM f"""
)
def p15_p19_stride_scalars(spark, sf_dir):
    c = F.col
    f = line(spark, sf_dir).withColumn("f", S.flight_time_ms(c("cad"), c("gct"))).withColumn("v", S.velocity_ms(c("stride"), c("cad")))
    return rounded(
        f.select(
            "l_orderkey", "l_linenumber", c("f").alias("flight"), S.duty_factor(c("gct"), c("f")).alias("duty"), c("v").alias("velocity"), S.pace_min_km(c("v")).alias("pace"),
            S.running_economy_index(c("osc"), c("stride")).alias("rei"), (c("stride") / num(0.9)).alias("leg_ratio"), S.flight_ratio(c("gct"), c("f")).alias("flight_share"), (c("v") * num(3.6)).alias("kmh"),
        )
    )


@query(
    f"""WITH l AS ({LINE}), c AS (SELECT *, 60e0 * stride / (9e-1 * (14e-1 + 1e-1 * stride)) AS m FROM l)
SELECT l_orderkey, l_linenumber, round(m * 75e-2, 6) AS low, round(m, 6) AS mid, round(m * 125e-2, 6) AS high, round(greatest(10e0, 3600e0 / (m * 125e-2)), 6) AS min_step FROM c"""
)
def p20_p21_cadence_band(spark, sf_dir):
    v, leg = F.col("stride"), num(0.9)
    b = S.cadence_band(v, leg)
    return rounded(line(spark, sf_dir).select("l_orderkey", "l_linenumber", b["low"].alias("low"), b["mid"].alias("mid"), b["high"].alias("high"), S.min_step_frames(v, leg, num(FPS)).alias("min_step")))


CLOCKS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '58.5' WHEN 1 THEN '1:' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || '.5' WHEN 2 THEN '1:02:30'
  WHEN 3 THEN 'x:' || o_orderkey::VARCHAR WHEN 4 THEN '1:2:3:4' ELSE '' END AS t FROM orders"""


@query(
    f"""WITH c AS ({CLOCKS}), p AS (SELECT *, list_transform(string_split(t, ':'), lambda x: try_cast(x AS DOUBLE)) AS a FROM c),
s AS (SELECT o_orderkey, t, CASE WHEN t <> '' AND len(a) <= 3 AND len(list_filter(a, lambda x: x IS NULL OR x < 0)) = 0
  THEN CASE len(a) WHEN 1 THEN a[1] WHEN 2 THEN a[1] * 60e0 + a[2] ELSE a[1] * 3600e0 + a[2] * 60e0 + a[3] END END AS sec FROM p)
SELECT o_orderkey, t, sec, CASE WHEN sec < 60 THEN printf('%.1fs', sec) ELSE floor(sec / 60)::BIGINT::VARCHAR || ':' || lpad(printf('%.1f', sec - 60e0 * floor(sec / 60)), 4, '0') END AS clock,
  (round_even(sec, 0)::BIGINT // 60)::VARCHAR || ':' || lpad((round_even(sec, 0)::BIGINT % 60)::VARCHAR, 2, '0') || '/km' AS pace FROM s"""
)
def p22_p23_clocks(spark, sf_dir):
    k = F.col("o_orderkey")
    t = (
        F.when(k % 6 == 0, "58.5")
        .when(k % 6 == 1, F.concat(F.lit("1:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(".5")))
        .when(k % 6 == 2, "1:02:30")
        .when(k % 6 == 3, F.concat(F.lit("x:"), k.cast("string")))
        .when(k % 6 == 4, "1:2:3:4")
        .otherwise("")
    )
    s = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).withColumn("sec", S.parse_seconds(F.col("t")))
    known = lambda c: F.when(F.col("sec").isNotNull(), c)
    return s.select("o_orderkey", "t", "sec", known(S.format_clock(F.col("sec"))).alias("clock"), known(S.format_pace(F.col("sec"))).alias("pace"))


BESTS = """SELECT o_custkey AS runner_id, CASE o_orderkey % 4 WHEN 0 THEN 800e0 WHEN 1 THEN 1500e0 WHEN 2 THEN 3000e0 ELSE 5000e0 END AS distance,
  CASE o_orderkey % 4 WHEN 0 THEN 800e0 WHEN 1 THEN 1500e0 WHEN 2 THEN 3000e0 ELSE 5000e0 END * (15e-2 + (o_totalprice::BIGINT % 1000) / 1e4) AS seconds FROM orders"""
MODEL = """-4.6e0 + 0.182258e0 * v + 0.000104e0 * v * v"""


def bests(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    d = F.when(k == 0, num(800)).when(k == 1, num(1500)).when(k == 2, num(3000)).otherwise(num(5000))
    share = num(0.15) + F.pmod(F.bround("o_totalprice", 0).cast("long"), F.lit(1000)).cast("double") / num(1e4)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("runner_id"), d.alias("distance"), (d * share).alias("seconds"), "o_orderkey")


def _share(m: str) -> str:
    return f"(8e-1 + 0.1894393e0 * exp(-0.012778e0 * ({m})) + 0.2989558e0 * exp(-0.1932605e0 * ({m})))"


def _speed(x: str) -> str:
    return f"((-0.182258e0 + sqrt(0.182258e0 * 0.182258e0 - 4e0 * 0.000104e0 * (-4.6e0 - ({x})))) / (2e0 * 0.000104e0))"


BESTS_SQL = BESTS.replace("o_totalprice::BIGINT", "round_even(o_totalprice, 0)::BIGINT")


@query(
    f"""WITH b AS (SELECT o_orderkey, distance, seconds, distance / (seconds / 60e0) AS v FROM ({BESTS_SQL.replace('SELECT o_custkey', 'SELECT o_orderkey, o_custkey')})),
d AS (SELECT *, ({MODEL}) / {_share('seconds / 60e0')} AS vdot FROM b)
SELECT o_orderkey, round({MODEL}, 6) AS vo2, round(vdot, 6) AS vdot, round({_speed('vdot * 86e-2')}, 6) AS threshold_v, round(seconds / (distance / 1000e0), 6) AS pace FROM d"""
)
def p24_p26_vdot(spark, sf_dir):
    b = bests(spark, sf_dir)
    c = F.col
    v = S.vdot(c("distance"), c("seconds"))
    return rounded(b.select("o_orderkey", S.vo2(c("distance") / (c("seconds") / num(60))).alias("vo2"), v.alias("vdot"), S.threshold_velocity(v).alias("threshold_v"), (c("seconds") / (c("distance") / num(1000))).alias("pace")))


@query(
    """SELECT c_custkey, round(ln((200e0 + c_custkey % 30) / 110e0) / ln(1500e0 / 800e0), 6) AS exponent,
CASE WHEN ln((200e0 + c_custkey % 30) / 110e0) / ln(1500e0 / 800e0) <= 104e-2 THEN 'Endurance-leaning' WHEN ln((200e0 + c_custkey % 30) / 110e0) / ln(1500e0 / 800e0) >= 108e-2 THEN 'Speed-leaning' ELSE 'Balanced' END AS profile FROM customer"""
)
def p27_riegel_profile(spark, sf_dir):
    t2 = num(200) + (F.col("c_custkey") % 30).cast("double")
    e = S.riegel_exponent(num(800), num(110), num(1500), t2)
    # the shorter race is given; a shift of t2 spreads the runners over the three profiles
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", e.alias("exponent"), S.runner_profile(e).alias("profile")))


def _predict(v: str, d: str) -> str:
    m = "t"
    return f"(60e0 * list_reduce(list_prepend({d} / 350e0, range(50)::DOUBLE[]), lambda t, i: {d} / {_speed(f'{v} * {_share(m)}')}))"


@query(f"""WITH c AS (SELECT c_custkey, 40e0 + c_custkey % 40 AS v FROM customer) SELECT c_custkey, round({_predict('v', '800e0')}, 4) AS race_800, round({_predict('v', '5000e0')}, 4) AS race_5000 FROM c""")
def p28_predict_time(spark, sf_dir):
    v = num(40) + (F.col("c_custkey") % 40).cast("double")
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", S.predicted_seconds(v, num(800)).alias("race_800"), S.predicted_seconds(v, num(5000)).alias("race_5000")), 4)


@query(
    f"""WITH b AS (SELECT runner_id, distance, min(seconds) AS seconds FROM ({BESTS_SQL}) GROUP BY ALL),
w AS (SELECT *, distance / (seconds / 60e0) AS v FROM b), d AS (SELECT *, ({MODEL}) / {_share('seconds / 60e0')} AS vd FROM w),
r AS (SELECT runner_id, count(*) AS n, min(distance) AS d1, max(distance) AS d2, arg_min(seconds, distance) AS t1, arg_max(seconds, distance) AS t2, max(vd) AS vdot, sum(vd * distance) / sum(distance) AS thr FROM d GROUP BY 1),
e AS (SELECT *, CASE WHEN d1 <> d2 THEN ln(t2 / t1) / ln(d2 / d1) END AS ex FROM r)
SELECT runner_id, round(vdot, 6) AS vdot, round(ex, 6) AS exponent, CASE WHEN ex <= 104e-2 THEN 'Endurance-leaning' WHEN ex >= 108e-2 THEN 'Speed-leaning' WHEN ex IS NOT NULL THEN 'Balanced' END AS profile,
  CASE WHEN n < 2 THEN 'Low' WHEN d2 >= 3000 THEN 'High' ELSE 'Medium' END AS confidence,
  round(CASE WHEN n >= 2 THEN t1 * pow(800e0 / d1, ex) ELSE {_predict('vdot', '800e0')} END, 4) AS race_800,
  round(CASE WHEN n >= 2 THEN t1 * pow(1500e0 / d1, ex) ELSE {_predict('vdot', '1500e0')} END, 4) AS race_1500, round(60000e0 / {_speed('thr * 86e-2')}, 6) AS threshold_pace FROM e"""
)
def a22_predict_paces(spark, sf_dir):
    p = pace.predict_paces(bests(spark, sf_dir))
    return rounded(p.withColumns({c: F.round(c, 4) for c in ("race_800", "race_1500")}))


@query(
    f"""WITH b AS (SELECT runner_id, distance, min(seconds / (distance / 1000e0)) AS pace FROM ({BESTS_SQL}) GROUP BY ALL), m AS (SELECT runner_id, CASE distance WHEN 800 THEN '800m' WHEN 1500 THEN '1500m' ELSE 'other' END AS label, pace FROM b),
t AS (SELECT DISTINCT runner_id, label, CASE label WHEN '800m' THEN 200e0 ELSE 210e0 END AS target FROM m WHERE label <> 'other')
SELECT m.runner_id, m.label, round(m.pace, 6) AS pace, target, round(m.pace - target, 6) AS delta, CASE WHEN target IS NULL THEN 'n/a' WHEN abs(m.pace - target) < 3 THEN 'on target' WHEN m.pace < target THEN 'faster' ELSE 'slower' END AS verdict
FROM m LEFT JOIN t USING (runner_id, label)"""
)
def j12_r5_pace_verdict(spark, sf_dir):
    b = bests(spark, sf_dir).groupBy("runner_id", "distance").agg(F.min(F.col("seconds") / (F.col("distance") / num(1000))).alias("pace"))
    m = b.select("runner_id", F.when(F.col("distance") == 800, "800m").when(F.col("distance") == 1500, "1500m").otherwise("other").alias("label"), "pace")
    t = m.where("label <> 'other'").select("runner_id", "label").distinct().withColumn("target", F.when(F.col("label") == "800m", num(200)).otherwise(num(210)))
    return rounded(pace.pace_verdict(m, t))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 33e-2 WHEN 1 THEN 55e-2 ELSE 78e-2 END AS position,
CASE WHEN p_size / 50e0 >= 7e-1 THEN 'good' WHEN p_size / 50e0 >= 4e-1 THEN 'ok' ELSE 'poor' END AS band, CASE WHEN p_partkey % 5 = 0 THEN 'N/A' ELSE printf('%.1f', p_size / 7e0) END AS shown FROM part"""
)
def p13_p14_p29_labels(spark, sf_dir):
    k = F.col("p_partkey")
    level = F.when(k % 3 == 0, " Threshold").when(k % 3 == 1, "1500m").otherwise("800M ")
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", S.pace_position(level).alias("position"), S.band3(size / num(50)).alias("band"), S.shown(F.when(k % 5 != 0, size / num(7))).alias("shown"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0e0 ELSE (30000e0 + s_suppkey) / (s_suppkey % 4) END AS rate,
CASE WHEN s_suppkey % 4 = 0 THEN false ELSE abs((30000e0 + s_suppkey) / (s_suppkey % 4) - 15000e0) / ((30000e0 + s_suppkey) / (s_suppkey % 4)) <= 1e-2 END AS cfr,
trunc(s_suppkey + 3e-1 * (CASE WHEN s_suppkey % 3 = 0 THEN 12e0 ELSE 7e0 END))::INTEGER AS stance,
CASE WHEN s_suppkey % 2 = 0 THEN '2024-03-05' ELSE 'May' END AS day FROM supplier"""
)
def s9_s10_p30_p34_rates_and_dates(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat((30000 + k).cast("string"), F.lit("/"), (k % 4).cast("string"))
    kd = k.cast("double")
    date = F.when(k % 2 == 0, "2024-03-05T10:11:12Z").otherwise("May")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", S.fraction(text).alias("rate"), S.constant_rate(S.fraction(text), num(15000)).alias("cfr"), S.stance_frame(kd, F.when(k % 3 != 0, kd + num(7)), 0.3).alias("stance"), S.shooting_date(date).alias("day")
    )


@query(
    """SELECT clip_id, frame, CASE WHEN lm >= 11 THEN CASE WHEN lm % 2 = 1 THEN lm + 1 ELSE lm - 1 END ELSE lm END::INTEGER AS lm, round(1920e0 - x * 5e-1, 6) AS x,
CASE WHEN vis > 0 AND NOT (abs(x - 960e0) < 10 AND abs(y - 200e0 - 50e0 * lm) < 10) THEN round(y * 5e-1, 6) END AS y,
CASE WHEN abs(x - 960e0) < 10 AND abs(y - 200e0 - 50e0 * lm) < 10 THEN 0e0 ELSE round(vis, 6) END AS vis FROM pose"""
)
def p7_p8_p9_p11_landmark_maps(spark, sf_dir):
    c = F.col
    zx, zy = c("x") - num(960), c("y") - num(200) - num(50) * c("lm").cast("double")
    return rounded(
        pose(spark, sf_dir).select(
            "clip_id", "frame", S.swapped_landmark(c("lm")).cast("int").alias("lm"), S.mirrored_x(S.scaled(c("x"), 0.5), 1920).alias("x"), S.valid_or_null(S.scaled(c("y"), 0.5), zx, zy, 10).alias("y"),
            S.visibility_or_zero(c("vis"), zx, zy, 10).alias("vis"),
        )
    )


@query(
    """WITH d AS (SELECT user_id, event_id, ['A', 'B', 'C', 'D', 'AB', ''][event_id % 6 + 1] AS stratum, ['M', 'F', 'X', 'm'][event_id % 4 + 1] AS sex,
 CASE WHEN event_id % 3 = 0 THEN 'box' || event_id WHEN event_id % 3 = 1 THEN '' END AS box, CASE WHEN event_id % 5 <> 0 THEN 'stream' || event_id END AS stream FROM events)
SELECT user_id, event_id, stratum, stratum IN ('A', 'B', 'C') AND sex IN ('M', 'F') AS valid, coalesce(nullif(box, ''), stream) AS created, (event_id % 7)::INTEGER AS width,
 CASE WHEN event_id % 9 <> 0 THEN round((event_id % 9) * 6000e0 / 1001e0, 6) END AS fps, 150e0 + event_id % 50 AS height_cm FROM d"""
)
def s12_s16_f14_documents(spark, sf_dir):
    """Runner and probe documents, made as JSON from events and read back."""
    k = F.col("event_id")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k % n + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    runner = F.struct(F.col("user_id").cast("string").alias("id"), pick(6, "A", "B", "C", "D", "AB", "").alias("stratum"), pick(4, "M", "F", "X", "m").alias("sex"), (num(150) + (k % 50).cast("double")).alias("height_cm"))
    doc = F.to_json(F.struct(F.array(runner).alias("runners")))
    box = F.when(k % 3 == 0, F.concat(F.lit("box"), k.cast("string"))).when(k % 3 == 1, "")
    stream = F.when(k % 5 != 0, F.concat(F.lit("stream"), k.cast("string")))
    rate = F.concat(((k % 9) * 6000).cast("string"), F.lit("/1001"))
    probe = F.to_json(
        F.struct(
            F.struct(F.struct(box.alias("creation_time")).alias("tags")).alias("format"),
            F.array(F.struct(F.struct(stream.alias("creation_time")).alias("tags"), (k % 7).cast("int").alias("width"), rate.alias("avg_frame_rate"))).alias("streams"),
        )
    )
    r = e.select("user_id", "event_id", F.explode(metadata.runners(doc)).alias("r"), metadata.probed(probe).alias("p"))
    r = r.select("user_id", "event_id", "p", metadata.runner_info(F.col("r")).alias("i"), metadata.valid_runner(F.col("r")).alias("valid"))
    return rounded(r.select("user_id", "event_id", F.col("i.stratum").alias("stratum"), "valid", F.col("p.creation_time").alias("created"), "p.width", "p.fps", F.col("i.height_cm").alias("height_cm")))


@query(
    """WITH d AS (SELECT c_custkey::VARCHAR AS id, 150e0 + c_custkey % 40 AS h FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey AS clip, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 180e0 END, d.h, CASE WHEN c_custkey % 3 = 0 THEN 170e0 END) AS height_cm,
CASE WHEN c_custkey % 10 = 0 THEN 'explicit' WHEN d.h IS NOT NULL THEN 'store' WHEN c_custkey % 3 = 0 THEN 'stub' ELSE 'error' END AS source FROM customer LEFT JOIN d ON d.id = c_custkey::VARCHAR"""
)
def s15_s17_resolve_metadata(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    clips = c.select(k.alias("clip"), F.when(k % 10 == 0, num(180)).alias("explicit_height"), F.concat(F.lit("/in/"), k.cast("string"), F.lit("_cfr.mp4")).alias("path"), F.when(k % 3 == 0, num(170)).alias("given_height"))
    # each document twice; the later file wins
    docs = c.where(k % 2 == 0).select(k.cast("string").alias("video_id"), F.struct((num(150) + (k % 40).cast("double")).alias("height_cm")).alias("runner"), F.lit("b.json").alias("_file"))
    old = docs.select("video_id", F.struct(num(1).alias("height_cm")).alias("runner"), F.lit("a.json").alias("_file"))
    return metadata.resolve(clips, metadata.store(docs.unionByName(old)))
