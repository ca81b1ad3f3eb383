"""Window operators over sequences: gap filling, filters, crossings, runs, sessions.

Each takes a DataFrame with partition columns and an order column (a dense frame number) and adds
columns. All windows of a sequence share one partitioning, so Spark shuffles it once. Functions named array_
take one sequence as an array; a sequence is a clip, some thousand frames at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalar import num


def _w(by: list[str], order: str):
    return W.partitionBy(*by).orderBy(order)


def neighbours(df: DataFrame, by: list[str], values: list[tuple[str, str, Column]], order: str = "frame") -> DataFrame:
    """Adds for each column, given as (before, after, column), under these names the last known one at or before a row and the first one at or behind it.

    One window for each direction, whatever the number of columns. The one that looks ahead runs from the end back, as
    Spark goes through all rows that remain for each row of a frame that ends at the last one."""
    back, ahead = _w(by, order), W.partitionBy(*by).orderBy(F.col(order).desc())
    seen = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    df = df.select("*", *(F.last(c, True).over(seen(back)).alias(before) for before, _, c in values))
    return df.select("*", *(F.last(c, True).over(seen(ahead)).alias(after) for _, after, c in values))


def _anchors_of(value: str, order: str = "frame", end: str = "") -> list[tuple[str, str, Column]]:
    return [("pv" + end, "nv" + end, F.col(value)), ("pt" + end, "nt" + end, F.when(F.col(value).isNotNull(), F.col(order)))]


def anchors(df: DataFrame, by: list[str], value: str, order: str = "frame") -> DataFrame:
    """Adds the nearest known value and its place on either side (an as-of join of a series with itself): pv, pt, nv, nt."""
    return neighbours(df, by, _anchors_of(value, order), order)


def lerp(end: str = "") -> Column:
    pv, pt, nv, nt = (F.col(c + end) for c in ("pv", "pt", "nv", "nt"))
    t = (F.col("frame") - pt).cast("double") / (nt - pt).cast("double")
    return F.when(pt == nt, pv).otherwise(F.coalesce(pv + (nv - pv) * t, pv, nv))


def interpolate(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Linear between neighbours, constant at the ends; a series without values stays so."""
    return interpolate_all(df, by, {value: out})


def interpolate_all(df: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """interpolate of several columns (each with the name of its result) by the same two windows."""
    ends = {v: f"_{i}_" for i, v in enumerate(values)}
    found = neighbours(df, by, [n for v, end in ends.items() for n in _anchors_of(v, end=end)])
    return found.withColumns({out: lerp(ends[v]) for v, out in values.items()}).drop(*(c + end for end in ends.values() for c in ("pv", "pt", "nv", "nt")))


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_at(values: Column, t: Column, sigma: float) -> Column:
    """The Gaussian filter of an array at a place: over 4 sigma either side, reflected at the ends (d c b a | a b c d | d c b a)."""
    w = gaussian_weights(sigma)
    r, n = len(w) // 2, F.size(values)

    def tap(total: Column, k: Column) -> Column:
        m = F.pmod(t + k - r, 2 * n)
        return total + F.element_at(F.array(*map(num, w)), k + 1) * F.get(values, F.when(m < n, m).otherwise(2 * n - 1 - m))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * r)), num(0), tap)


def gaussian(df: DataFrame, by: list[str], value: str, out: str, sigma: float | str) -> DataFrame:
    """Normalised Gaussian filter over the rows of a sequence; see gaussian_all."""
    return gaussian_all(df, by, {value: out}, sigma)


def gaussian_all(df: DataFrame, by: list[str], values: dict[str, str], sigma: float | str) -> DataFrame:
    """Normalised Gaussian filter of several columns (each with the name of its result) over the rows of a sequence.

    The rows of a sequence are gathered into one array, each column is continued by reflection once, and the rows are dealt out
    again: one shuffle. sigma may name a column of 2.0 and 3.0."""
    rest = [c for c in df.columns if c not in by]
    weights = {s: gaussian_weights(s) for s in ((sigma,) if isinstance(sigma, float) else (2.0, 3.0))}
    reach = max(len(w) for w in weights.values()) // 2
    df = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("frame", *(c for c in rest if c != "frame")))).alias("rows_"))
    df = df.withColumns({f"all_{i}_": F.col("rows_")[v] for i, v in enumerate(values)})
    df = df.withColumns({f"all_{i}_": _reflected(F.col(f"all_{i}_"), reach) for i in range(len(values))})

    def at(all_: Column, t: Column, s: float) -> Column:
        w = weights[s]
        first = t + (reach - len(w) // 2)
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(w) - 1)), num(0), lambda total, k: total + F.get(F.array(*map(num, w)), k) * F.get(all_, first + k))

    def row(r: Column, t: Column) -> Column:
        of = lambda all_: at(all_, t, sigma) if isinstance(sigma, float) else F.when(r[sigma] == 2.0, at(all_, t, 2.0)).otherwise(at(all_, t, 3.0))
        return F.struct(*(r[c].alias(c) for c in rest), *(of(F.col(f"all_{i}_")).alias(out) for i, out in enumerate(values.values())))

    return df.select(*by, F.inline(F.transform("rows_", row)))


def _reflected(values: Column, reach: int) -> Column:
    """An array with reach more values at either end (d c b a | a b c d | d c b a)."""
    n = F.size(values)

    def place(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.get(values, F.when(m < n, m).otherwise(2 * n - 1 - m))

    return F.transform(F.sequence(F.lit(-reach), n - 1 + reach), place)


def dense(df: DataFrame, by: list[str]) -> DataFrame:
    """The table, with an error if the frames of a sequence are not 0, 1, 2, ...: filters over rows need that."""
    w = W.partitionBy(*by).orderBy("frame")
    fine = F.col("frame") == F.row_number().over(w) - 1
    text = F.concat(F.lit("frames of a sequence must run from 0 without gap or repeat, at frame "), F.col("frame").cast("string"))
    return df.withColumn("frame", F.when(fine, F.col("frame")).otherwise(F.raise_error(text).cast("bigint")))


# arrays --------------------------------------------------------------------------------------------


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def array_mean(a: Column) -> Column:
    """Mean of the known values; NULL without any."""
    known = F.filter(a, lambda x: x.isNotNull())
    return let(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, num(0), lambda s, x: s + x) / F.size(k)))


def array_stddev(a: Column) -> Column:
    """Population deviation of the known values."""
    return let(F.struct(a.alias("a"), array_mean(a).alias("m")), lambda s: F.sqrt(array_mean(F.transform(s["a"], lambda x: (x - s["m"]) * (x - s["m"])))))


def array_median(a: Column) -> Column:
    """Median of the known values; of an even number, the mean of the middle two."""
    known = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    return let(known, lambda k: (F.get(k, F.floor((F.size(k) - 1) / 2).cast("int")) + F.get(k, F.floor(F.size(k) / 2).cast("int"))) / num(2))


def array_longest_run(a: Column) -> Column:
    """Struct of start and length of the longest run of known values; of equals, the earliest."""
    kind = "struct<start: int, length: int, now: int>"

    def step(s: Column, i: Column) -> Column:
        now = F.when(F.get(a, i).isNotNull(), s["now"] + 1).otherwise(0)
        longer = now > s["length"]
        return F.struct(F.when(longer, i - now + 1).otherwise(s["start"]).alias("start"), F.when(longer, now).otherwise(s["length"]).alias("length"), now.alias("now")).cast(kind)

    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("now")).cast(kind)
    return F.aggregate(between(F.lit(0), F.size(a) - 1), zero, step, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))


def array_slope(a: Column) -> Column:
    """Slope of the values over their places."""
    t = F.transform(a, lambda _, i: i.cast("double"))
    return let(
        F.struct(a.alias("x"), t.alias("t"), array_mean(a).alias("mx"), array_mean(t).alias("mt")),
        lambda s: F.aggregate(F.zip_with(s["x"], s["t"], lambda x, t: (x - s["mx"]) * (t - s["mt"])), num(0), lambda p, q: p + q)
        / F.nullif(F.aggregate(F.transform(s["t"], lambda t: (t - s["mt"]) * (t - s["mt"])), num(0), lambda p, q: p + q), num(0)),
    )


def between(first: Column, last: Column) -> Column:
    """The whole numbers from first to last; none where last is below first."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def array_peaks(values: Column, distance: int = 10) -> Column:
    """Strict local maxima of an array, the middle of a plateau: structs of height and frame. From the highest down (the later of equals first) each removes others nearer than distance."""

    def tops(v: Column) -> Column:
        n = F.size(v)
        rises = F.filter(between(F.lit(1), n - 2), lambda i: (F.get(v, i) > F.get(v, i - 1)) & (F.get(v, i + 1) <= F.get(v, i)))
        ends = F.transform(rises, lambda i: F.struct(i.alias("a"), F.get(F.filter(between(i + 1, n - 1), lambda j: F.get(v, j) != F.get(v, i)), 0).alias("b")))
        high = F.filter(ends, lambda e: F.get(v, e["b"]) < F.get(v, e["a"]))
        return F.transform(high, lambda e: F.struct(F.get(v, e["a"]).alias("height"), F.floor((e["a"] + e["b"] - 1) / 2).cast("bigint").alias("frame")))

    return _far_apart(F.sort_array(let(F.transform(values, lambda x: F.bround(x, 9)), tops), False), distance)


def _far_apart(tops: Column, distance: int) -> Column:
    none = F.array().cast("array<struct<height: double, frame: bigint>>")
    step = lambda s, x: F.when(F.exists(s, lambda y: F.abs(y["frame"] - x["frame"]) < distance), s).otherwise(F.array_append(s, x))
    return F.aggregate(tops, none, step)


# windows -------------------------------------------------------------------------------------------


def savgol5(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Savitzky-Golay, window 5 and order 2, with fitted ends; a series of under 5 stays as it is."""
    w = _w(by, "frame")
    x = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    everything = W.partitionBy(*by)
    t, n = F.col("frame"), F.count("*").over(everything)
    dot = lambda weights, at: sum((num(c / 35) * x(k) for c, k in zip(weights, at)), num(0))
    interior = dot((-3, 12, 17, 12, -3), range(-2, 3))
    first, second = dot((31, 9, -3, -5, 3), range(0, 5)), dot((9, 13, 12, 6, -5), range(-1, 4))
    last, before_last = dot((3, -5, -3, 9, 31), range(-4, 1)), dot((-5, 6, 12, 13, 9), range(-3, 2))
    return df.withColumn(out, F.when(n < 5, F.col(value)).when(t == 0, first).when(t == 1, second).when(t == n - 1, last).when(t == n - 2, before_last).otherwise(interior))


def gradient(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Half the difference of the neighbours; one-sided at the ends."""
    w = _w(by, "frame")
    p, n, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    first, last = F.lag("frame").over(w).isNull(), F.lead("frame").over(w).isNull()
    return df.withColumn(out, F.when(first, n - x).when(last, x - p).otherwise((n - p) / num(2)))


def rolling_max(df: DataFrame, by: list[str], value: str, out: str, half: int = 2) -> DataFrame:
    return df.withColumn(out, F.max(value).over(_w(by, "frame").rowsBetween(-half, half)))


def velocity(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.abs(F.col(value) - F.lag(value).over(_w(by, "frame"))))


def down_crossings(df: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Adds crossing (from above the threshold to it or below, inside the series) and its place between frames."""
    w = _w(by, "frame")
    p, x = F.lag(value).over(w), F.col(value)
    inside = F.lead("frame").over(w).isNotNull()
    df = df.withColumn("crossing", F.coalesce((p > threshold) & (x <= threshold) & inside, F.lit(False)))
    return df.withColumn("place", F.when(F.col("crossing"), F.col("frame") - num(1) + (num(threshold) - p) / (x - p)))


def runs(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """A row for each run of equal flags: by, flag, start, stop, length."""
    w = _w(by, "frame")
    df = df.select(*by, "frame", F.coalesce(flag, F.lit(False)).alias("flag"))
    df = df.withColumn("new", (F.col("flag") != F.coalesce(F.lag("flag").over(w), ~F.col("flag"))).cast("int"))
    df = df.withColumn("run", F.sum("new").over(w))
    return df.groupBy(*by, "run", "flag").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count("*").alias("length")).drop("run")


def longest_run(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """The longest run of true; of equals, the earliest."""
    best = runs(df, by, flag).where("flag").groupBy(*by).agg(F.max_by(F.struct("start", "stop", "length"), F.struct("length", -F.col("start"))).alias("r"))
    return best.select(*by, "r.start", "r.stop", "r.length")


def best_window(df: DataFrame, by: list[str], score: str, size: int) -> DataFrame:
    """Start and stop of the window with the largest sum; of equals, the earliest; a short series whole."""
    w = _w(by, "frame").rowsBetween(0, size - 1)
    n = F.count("*").over(W.partitionBy(*by))
    sums = df.select(*by, "frame", n.alias("n"), F.bround(F.sum(score).over(w), 6).alias("total"))
    sums = sums.where((F.col("frame") <= F.col("n") - size) | ((F.col("n") <= size) & (F.col("frame") == 0)))
    best = sums.groupBy(*by).agg(F.max_by(F.struct("frame", "n"), F.struct("total", -F.col("frame"))).alias("b"))
    return best.select(*by, F.col("b.frame").alias("start"), F.least(F.col("b.frame") + size, F.col("b.n")).alias("stop"))


def active_window(df: DataFrame, by: list[str], signal: str, taps: int = 21, k: float = 0.5, pad: int = 15) -> DataFrame:
    """The longest run where the moving mean (zeros outside) is above mean + k deviations, with a margin; the whole series if there is none."""
    half = taps // 2
    df = df.withColumn("mean_", F.sum(signal).over(_w(by, "frame").rowsBetween(-half, half)) / num(taps))
    everything = W.partitionBy(*by)
    high = F.col("mean_") > F.bround(F.avg("mean_").over(everything) + num(k) * F.stddev_pop("mean_").over(everything), 9)
    df = df.withColumn("high", high)
    whole = df.groupBy(*by).agg(F.count("*").alias("n"))
    best = whole.join(longest_run(df, by, F.col("high")), by, "left")
    start = F.greatest(F.coalesce(F.col("start") - pad, F.lit(0)), F.lit(0))
    return best.select(*by, start.alias("start"), F.least(F.coalesce(F.col("stop") + pad, F.col("n") - 1), F.col("n") - 1).alias("stop"), F.col("start").isNull().alias("fallback"))


def first_session(df: DataFrame, by: list[str], usable: Column, max_gap: int = 2, least: int = 90) -> DataFrame:
    """The first stretch of usable frames that gaps of at most max_gap do not end; with its usable count."""
    w = _w(by, "frame")
    seen = df.where(usable).select(*by, "frame")
    seen = seen.withColumn("new", (F.col("frame") - F.lag("frame").over(w) > max_gap + 1).cast("int"))
    seen = seen.withColumn("session", F.sum(F.coalesce("new", F.lit(0))).over(w)).where("session = 0")
    out = seen.groupBy(*by).agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count("*").alias("n_usable"))
    return out.withColumn("enough", F.col("stop") - F.col("start") + 1 >= least)


def replace_spikes(df: DataFrame, by: list[str], value: str, out: str, ceiling: float = 80.0) -> DataFrame:
    """A value that leaps from both neighbours while they agree becomes their midpoint; neighbours are the original ones."""
    w = _w(by, "frame")
    p, n, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    spike = F.coalesce((F.abs(x - p) > ceiling) & (F.abs(n - x) > ceiling) & (F.abs(n - p) <= ceiling), F.lit(False))
    return df.withColumn("spike", spike).withColumn(out, F.when(spike, (p + n) / num(2)).otherwise(x))


def replace_spikes_xy(df: DataFrame, by: list[str], x: str, y: str, ceiling: float = 80.0) -> DataFrame:
    """replace_spikes on both axes: x and y become fixed_x and fixed_y, each judged by its own neighbours; spike_x, spike_y, spike (either)."""
    df = replace_spikes(df, by, x, "fixed_x", ceiling).withColumnRenamed("spike", "spike_x")
    df = replace_spikes(df, by, y, "fixed_y", ceiling).withColumnRenamed("spike", "spike_y")
    return df.withColumn("spike", F.col("spike_x") | F.col("spike_y"))


def fill_gaps_xy(df: DataFrame, by: list[str], x: str, y: str, vis: str, world: tuple[str, ...] = (), max_gap: int = 4, min_vis: float = 0.5) -> DataFrame:
    """fill_gaps_linear of places: a gap is where x or y is missing. x, y, vis and the columns of world are filled in place; filled says where.

    World columns are filled only between anchors that have all of them."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    df = df.withColumns({x: F.when(known, F.col(x)), y: F.when(known, F.col(y))})
    sides = [(f"p_{c}", f"n_{c}", F.when(known, F.struct(F.col(c).alias("v")))) for c in world]
    df = neighbours(df, by, sides + _anchors_of(x) + _anchors_of(y, end="_y_") + [_seen(x, vis)])
    t = (F.col("frame") - F.col("pt")).cast("double") / (F.col("nt") - F.col("pt")).cast("double")
    whole = F.lit(True)
    for c in world:
        whole = whole & F.col(f"p_{c}")["v"].isNotNull() & F.col(f"n_{c}")["v"].isNotNull()
    df = df.withColumn("filled", _short_gap(x, max_gap, min_vis))
    made = {c: F.when(F.col("filled"), F.when(whole & (F.col("nt") > F.col("pt")), F.col(f"p_{c}")["v"] + (F.col(f"n_{c}")["v"] - F.col(f"p_{c}")["v"]) * t)).otherwise(F.col(c)) for c in world}
    places = {x: F.when(F.col("filled"), lerp()).otherwise(F.col(x)), y: F.when(F.col("filled"), lerp("_y_")).otherwise(F.col(y))}
    df = df.withColumns(places | {vis: _filled_vis(vis)} | made)
    return df.drop(*_FOUND, "pv_y_", "pt_y_", "nv_y_", "nt_y_", *(f"{k}_{c}" for c in world for k in "pn"))


_FOUND = ("pv", "pt", "nv", "nt", "pvis", "nvis")


def _seen(value: str, vis: str) -> tuple[str, str, Column]:
    return "pvis", "nvis", F.when(F.col(value).isNotNull(), F.col(vis))


def _short_gap(value: str, max_gap: int, min_vis: float) -> Column:
    c = F.col
    return F.coalesce(c(value).isNull() & (c("nt") - c("pt") - 1 <= max_gap) & (c("pvis") >= min_vis) & (c("nvis") >= min_vis), F.lit(False))


def _filled_vis(vis: str) -> Column:
    t = (F.col("frame") - F.col("pt")).cast("double") / (F.col("nt") - F.col("pt")).cast("double")
    return F.when(F.col("filled"), F.least(num(1), F.greatest(num(0), F.col("pvis") + (F.col("nvis") - F.col("pvis")) * t))).otherwise(F.col(vis))


def nearest_points(df: DataFrame, by: list[str], points: str, reach: int):
    """For points (an array of structs of x, y, vis in each row): df with the rows up to reach before and after, the names of these columns, and ends(i), a struct of the nearest known point i on either side among them.

    a and b, each frame and p; NULL without one. As frames of a sequence rise, a gap that is no longer than reach ends within so many rows."""
    w, one = _w(by, "frame"), F.struct(F.col("frame").alias("frame"), F.col(points).alias("points"))
    near = {f"{end}_{k}_": of(one, k).over(w) for end, of in (("before", F.lag), ("after", F.lead)) for k in range(1, reach + 1)}

    def end(side: str, i: Column) -> Column:
        at = lambda k: F.get(F.col(f"{side}_{k}_")["points"], i)
        return F.coalesce(*(F.when(at(k)["x"].isNotNull() & at(k)["y"].isNotNull(), F.struct(F.col(f"{side}_{k}_")["frame"].alias("frame"), at(k).alias("p"))) for k in range(1, reach + 1)))

    return df.withColumns(near), list(near), lambda i: F.struct(end("before", i).alias("a"), end("after", i).alias("b"))


def fill_gaps_points(df: DataFrame, by: list[str], points: str, max_gap: int = 4, min_vis: float = 0.5) -> DataFrame:
    """fill_gaps_xy of each landmark of points, in place; frames need not be dense. An anchor without a visibility is no good one."""
    df, found, ends = nearest_points(df, by, points, max_gap)
    unknown = lambda p: p.isNotNull() & (p["x"].isNull() | p["y"].isNull())
    none = F.lit(None).cast("double")

    def made(p: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (F.col("frame") - a["frame"]).cast("double") / (b["frame"] - a["frame"]).cast("double")
        at = lambda f: a["p"][f] + (b["p"][f] - a["p"][f]) * t
        short = (b["frame"] - a["frame"] - 1 <= max_gap) & (a["p"]["vis"] >= min_vis) & (b["p"]["vis"] >= min_vis)
        new = F.struct(at("x").alias("x"), at("y").alias("y"), F.least(num(1), F.greatest(num(0), at("vis"))).alias("vis"))
        return F.when(short, new).otherwise(F.struct(none.alias("x"), none.alias("y"), p["vis"].alias("vis")))

    filled = F.transform(points, lambda p, i: F.when(unknown(p), let(ends(i), lambda e: made(p, e))).otherwise(p))
    return df.withColumn(points, F.when(F.exists(points, unknown), filled).otherwise(F.col(points))).drop(*found)


def fill_gaps_linear(df: DataFrame, by: list[str], value: str, vis: str, out: str, max_gap: int = 4, min_vis: float = 0.5) -> DataFrame:
    """Inner gaps of at most max_gap between visible anchors, linearly; visibility likewise, within 0 and 1."""
    df = neighbours(df, by, _anchors_of(value) + [_seen(value, vis)])
    df = df.withColumn("filled", _short_gap(value, max_gap, min_vis))
    df = df.withColumns({out: F.when(F.col("filled"), lerp()).otherwise(F.col(value)), out + "_vis": _filled_vis(vis)})
    return df.drop(*_FOUND)


def fill_short_gaps(df: DataFrame, by: list[str], value: str, vis: str, out: str, max_gap: int = 3, discount: float = 0.8, beside: dict[str, str] = {}) -> DataFrame:
    """Gaps of at most max_gap, at the ends too (held constant); status 0 measured, 1 filled, 2 missing.

    beside: columns known where value is, each with the name of its result, filled likewise."""
    more = {v: f"_{i}_" for i, v in enumerate(beside)}
    sides = [n for v, end in more.items() for n in _anchors_of(v, end=end)]
    df = neighbours(df, by, _anchors_of(value) + sides + [_seen(value, vis)])
    n = F.count("*").over(W.partitionBy(*by))
    gap = F.coalesce("nt", n) - F.coalesce("pt", F.lit(-1)) - 1
    fills = F.col(value).isNull() & (gap <= max_gap) & (F.col("pt").isNotNull() | F.col("nt").isNotNull())
    df = df.withColumn("status", F.when(F.col(value).isNotNull(), 0).when(fills, 1).otherwise(2))
    made = {o: F.when(F.col("status") == 1, lerp(more[v])).otherwise(F.col(v)) for v, o in beside.items()}
    df = df.withColumns({out: F.when(F.col("status") == 1, lerp()).otherwise(F.col(value)), **made})
    df = df.withColumn(out + "_vis", F.when(F.col("status") == 1, num(discount) * F.least("pvis", "nvis")).otherwise(F.col(vis)))
    return df.drop(*_FOUND, *(c + end for end in more.values() for c in ("pv", "pt", "nv", "nt")))


def greedy_min_gap(at: Column, gap: int, kind: str = "bigint", place=lambda x: x) -> Column:
    """Of sorted elements, those whose place is at least gap after that of the last one taken. kind: type of the elements."""
    step = lambda s, x: F.when((F.size(s) == 0) | (place(x) - place(F.element_at(s, -1)) >= gap), F.array_append(s, x)).otherwise(s)
    return F.aggregate(at, F.array().cast(f"array<{kind}>"), step)


def peaks(df: DataFrame, by: list[str], value: str, distance: int = 10) -> DataFrame:
    """Strict local maxima, the middle of a plateau; from the highest down (the later of equals first) each removes others nearer than distance. by, frame, height."""
    w = _w(by, "frame")
    df = df.select(*by, "frame", F.bround(value, 9).alias("v"))
    df = df.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(w)).cast("int"), F.lit(1))).withColumn("flat", F.sum("new").over(w))
    flats = df.groupBy(*by, "flat").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.first("v").alias("v"))
    f = W.partitionBy(*by).orderBy("flat")
    flats = flats.withColumn("up", F.col("v") > F.lag("v").over(f)).withColumn("down", F.col("v") > F.lead("v").over(f))
    tops = flats.where("up and down").select(*by, F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("frame"), F.col("v").alias("height"))
    sorted_ = tops.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("height", "frame")), False).alias("tops"))
    kept = sorted_.select(*by, F.explode(_far_apart(F.col("tops"), distance)).alias("p"))
    return kept.select(*by, "p.frame", "p.height")
