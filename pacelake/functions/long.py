"""The window operators for sequences longer than a task: chunks of frames, halos for filters, carries for what goes on.

A chunk is SIZE frames of a sequence (frames 0, 1, 2, ...), so a sequence is spread over as many tasks as it has chunks, and all windows
here are within a chunk. A filter gets a halo: the frames next to a chunk's ends are sent to it too, and
at a sequence's ends the reflected ones. What reaches further is done in two passes: a row for each chunk says what it has
at its ends, windows over these rows (one for SIZE frames) carry it on, and the chunks are put right by what they are given. Results are
those of the functions of the same names in windows.py and contacts.py, but for the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalar import num
from .windows import gaussian_weights, greedy_min_gap, lerp

#: Frames of a chunk.
SIZE = 65_536


def chunked(df: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds chunk."""
    return df.withColumn("chunk", F.expr(f"frame div {size}"))


def _in_chunk(by: list[str]):
    return W.partitionBy(*by, "chunk").orderBy("frame")


def _chunks(by: list[str]):
    """Over a row for each chunk."""
    return W.partitionBy(*by).orderBy("chunk")


def _given(df: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """The rows with what their chunk is given: both sides are shuffled by chunk, as the windows need them, so no sequence meets in one task."""
    return df.join(chunks.hint("merge"), [*by, "chunk"])


def of_sequence(df: DataFrame, by: list[str], **parts: tuple[Column, Column]) -> DataFrame:
    """by, chunk and, for each name, what holds of the whole sequence: a chunk's own aggregate, and how those of its chunks are made one (an aggregate of a column of that name)."""
    own = df.groupBy(*by, "chunk").agg(*(a.alias(name) for name, (a, _) in parts.items()))
    return own.select(*by, "chunk", *(over.over(W.partitionBy(*by)).alias(name) for name, (_, over) in parts.items()))


def lengths(df: DataFrame, by: list[str]) -> DataFrame:
    """by, chunk, n: one past the last frame, and an error if the frames are not 0, 1, 2, ..."""
    n = of_sequence(df, by, n=(F.max("frame") + 1, F.max("n")), rows_=(F.count("*"), F.sum("rows_")), first_=(F.min("frame"), F.min("first_")))
    fine = (F.col("n") == F.col("rows_")) & (F.col("first_") == 0)
    return n.select(*by, "chunk", F.when(fine, F.col("n")).otherwise(F.raise_error(F.lit("frames of a sequence must run from 0 without gap or repeat")).cast("bigint")).alias("n"))


def anchors(df: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """windows.anchors: pv, pt, nv, nt, the nearest known value and its frame on either side."""
    w = _in_chunk(by)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("frame").alias("t")))
    df = chunked(df, size)
    ends = df.groupBy(*by, "chunk").agg(F.min_by(known, F.when(known.isNotNull(), F.col("frame"))).alias("first_"), F.max_by(known, F.when(known.isNotNull(), F.col("frame"))).alias("last_"))
    c = _chunks(by)
    carried = ends.select(*by, "chunk", F.last("last_", True).over(c.rowsBetween(W.unboundedPreceding, -1)).alias("in_"), F.first("first_", True).over(c.rowsBetween(1, W.unboundedFollowing)).alias("out_"))
    df = _given(df, carried, by)
    p = F.coalesce(F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("in_"))
    n = F.coalesce(F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("out_"))
    df = df.withColumns({"p_": p, "n_": n})
    return df.withColumns({"pv": F.col("p_.v"), "pt": F.col("p_.t"), "nv": F.col("n_.v"), "nt": F.col("n_.t")}).drop("in_", "out_", "p_", "n_", "chunk")


def interpolate(df: DataFrame, by: list[str], value: str, out: str, size: int = SIZE) -> DataFrame:
    """windows.interpolate: linear between neighbours, constant at the ends."""
    return anchors(df, by, value, size).withColumn(out, lerp()).drop("pv", "pt", "nv", "nt")


def with_halo(df: DataFrame, by: list[str], reach: int, size: int = SIZE, reflect: bool = False) -> DataFrame:
    """The rows with chunk and place, and halo true for the copies that a chunk gets of frames within reach of its ends.

    place counts as frame does; with reflect, frames are mirrored beyond a sequence's ends (d c b a | a b c d | d c b a), again and
    again where the sequence is shorter than reach, and without it there are none."""
    if reach > size:
        raise ValueError(f"a halo of {reach} frames needs chunks of as many; they have {size}")
    if reflect:
        df = chunked(df, size)
        df = _given(df, lengths(df, by), by)
        # all places that a frame is mirrored to: its own, and those beyond either end that are within reach of it
        f, n = F.col("frame"), F.col("n")
        turns = F.ceil(F.lit(reach).cast("double") / n).cast("bigint")
        near = (f < reach) | (f >= n - reach)
        places = F.transform(F.sequence(-turns, turns), lambda k: F.when(F.pmod(k, F.lit(2)) == 0, k * n + f).otherwise(k * n + n - 1 - f))
        df = df.withColumn("place", F.explode(F.when(near, F.filter(places, lambda p: (p >= -reach) & (p < n + reach))).otherwise(F.array(f))))
        last = F.expr(f"(n - 1) div {size}")
    else:
        df = df.withColumn("place", F.col("frame"))
        last = F.lit(None).cast("bigint")
    low, high = F.floor((F.col("place") - reach) / size).cast("bigint"), F.floor((F.col("place") + reach) / size).cast("bigint")
    df = df.withColumn("chunk", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("bigint")), F.least(F.greatest(high, F.lit(0).cast("bigint")), F.coalesce(last, high)))))
    # a chunk of another sequence's end has only copies, and goes
    own = (F.col("place") == F.col("frame")) & (F.expr(f"frame div {size}") == F.col("chunk"))
    return df.withColumn("halo", ~own).drop("n") if reflect else df.withColumn("halo", ~own)


def gaussian(df: DataFrame, by: list[str], value: str, out: str, sigma: float | str, size: int = SIZE) -> DataFrame:
    """windows.gaussian: 4 sigma either side, reflected at the ends. sigma may name a column of 2.0 and 3.0."""
    sigmas = [sigma] if isinstance(sigma, float) else [2.0, 3.0]
    reach = max(len(gaussian_weights(s)) // 2 for s in sigmas)
    df = with_halo(df, by, reach, size, reflect=True)
    w = W.partitionBy(*by, "chunk").orderBy("place")

    def filtered(s: float) -> Column:
        weights = gaussian_weights(s)
        r = len(weights) // 2
        at = lambda k: F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k else F.col(value)
        return sum((num(x) * at(k) for x, k in zip(weights[1:], range(1 - r, r + 1))), num(weights[0]) * at(-r))

    made = filtered(sigma) if isinstance(sigma, float) else F.when(F.col(sigma) == 2.0, filtered(2.0)).otherwise(filtered(3.0))
    return df.withColumn(out, made).where("not halo").drop("halo", "place", "chunk")


def _beside(df: DataFrame, by: list[str], size: int) -> tuple[DataFrame, object]:
    """The rows with the frame before and after each chunk, and a window over them."""
    return with_halo(df, by, 1, size), W.partitionBy(*by, "chunk").orderBy("place")


def _own(df: DataFrame) -> DataFrame:
    return df.where("not halo").drop("halo", "place", "chunk")


def gradient(df: DataFrame, by: list[str], value: str, out: str, size: int = SIZE) -> DataFrame:
    """windows.gradient: half the difference of the neighbours; one-sided at the ends."""
    df, w = _beside(df, by, size)
    p, n, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    first, last = F.lag("frame").over(w).isNull(), F.lead("frame").over(w).isNull()
    return _own(df.withColumn(out, F.when(first, n - x).when(last, x - p).otherwise((n - p) / num(2))))


def down_crossings(df: DataFrame, by: list[str], value: str, threshold: float, size: int = SIZE) -> DataFrame:
    """windows.down_crossings: crossing, and its place between frames as place."""
    df, w = _beside(df, by, size)
    p, x = F.lag(value).over(w), F.col(value)
    inside = F.lead("frame").over(w).isNotNull()
    df = df.withColumn("crossing", F.coalesce((p > threshold) & (x <= threshold) & inside, F.lit(False)))
    df = df.withColumn("at_", F.when(F.col("crossing"), F.col("frame") - num(1) + (num(threshold) - p) / (x - p)))
    return _own(df).withColumnRenamed("at_", "place")


def runs(df: DataFrame, by: list[str], flag: Column, size: int = SIZE) -> DataFrame:
    """windows.runs: by, flag, start, stop, length of each run of equal flags."""
    w = _in_chunk(by)
    df = chunked(df.select(*by, "frame", F.coalesce(flag, F.lit(False)).alias("flag")), size)
    df = df.withColumn("new", (F.col("flag") != F.coalesce(F.lag("flag").over(w), ~F.col("flag"))).cast("int"))
    df = df.withColumn("run", F.sum("new").over(w))
    own = df.groupBy(*by, "chunk", "run", "flag").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count("*").alias("length"))
    top = F.max("run").over(W.partitionBy(*by, "chunk"))
    own = own.withColumn("edge", (F.col("run") == 1) | (F.col("run") == top))
    # at most two runs of a chunk may go on beyond it
    edge = own.where("edge")
    c = W.partitionBy(*by).orderBy("chunk", "run")
    goes_on = (F.col("run") == 1) & (F.lag("flag").over(c) == F.col("flag")) & (F.lag("chunk").over(c) < F.col("chunk"))
    edge = edge.withColumn("group", F.sum(F.when(goes_on, 0).otherwise(1)).over(c))
    edge = edge.groupBy(*by, "group", "flag").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length"))
    shown = [*by, "flag", "start", "stop", "length"]
    return own.where("not edge").select(*shown).unionByName(edge.select(*shown))


def longest_run(df: DataFrame, by: list[str], flag: Column, size: int = SIZE) -> DataFrame:
    """windows.longest_run: the longest run of true; of equals, the earliest."""
    best = runs(df, by, flag, size).where("flag").groupBy(*by).agg(F.max_by(F.struct("start", "stop", "length"), F.struct("length", -F.col("start"))).alias("r"))
    return best.select(*by, "r.start", "r.stop", "r.length")


def first_session(df: DataFrame, by: list[str], usable: Column, max_gap: int = 2, least: int = 90, size: int = SIZE) -> DataFrame:
    """windows.first_session: the first stretch of usable frames that gaps of at most max_gap do not end."""
    seen = chunked(df.where(usable).select(*by, "frame"), size)
    c = _chunks(by)
    ends = seen.groupBy(*by, "chunk").agg(F.min("frame").alias("first_"), F.max("frame").alias("last_"))
    ends = ends.select(*by, "chunk", F.lag("last_").over(c).alias("before_"))
    w = _in_chunk(by)
    seen = _given(seen, ends, by).withColumn("gap", F.col("frame") - F.coalesce(F.lag("frame").over(w), F.col("before_")))
    seen = seen.withColumn("break_", F.when(F.col("gap") > max_gap + 1, F.col("frame")))
    # the first frame behind too long a gap ends the session
    seen = _given(seen, of_sequence(seen, by, end_=(F.min("break_"), F.min("end_"))), by).where("end_ is null or frame < end_")
    out = seen.groupBy(*by).agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count("*").alias("n_usable"))
    return out.withColumn("enough", F.col("stop") - F.col("start") + 1 >= least)


def greedy(df: DataFrame, by: list[str], gap: int, rest: list[str], size: int = SIZE) -> DataFrame:
    """The rows taken by windows.greedy_min_gap: each at least gap frames after the last one taken. by, frame and the columns of rest.

    What a chunk takes depends only on the first row that it may take, one of its first gap frames. So a chunk sums up, for each of
    these, from which frame on the next one may take; a fold over the chunks of a sequence finds where each begins."""
    if gap > size:
        raise ValueError(f"a gap of {gap} frames needs chunks of as many; they have {size}")
    item = F.struct("frame", *rest)
    df = chunked(df.select(*by, "frame", *rest), size)
    held = df.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(item)).alias("rows_"))
    last_from = lambda a, first: F.aggregate(a, F.lit(None).cast("bigint"), lambda s, t: F.when((t >= first) & (s.isNull() | (t - s >= gap)), t).otherwise(s))
    frames = F.transform("rows_", lambda x: x["frame"].cast("bigint"))
    # entries: from which frame on the chunk may take; beyond its first gap frames, as where the one before took nothing near
    base = F.col("chunk") * size
    entries = F.transform(F.sequence(F.lit(0), F.lit(gap - 1)), lambda k: last_from(frames, base + k) + gap)
    summed = held.select(*by, "chunk", entries.alias("next_"))
    kind = "struct<free: bigint, out: array<struct<chunk: bigint, free: bigint>>>"

    def step(s: Column, x: Column) -> Column:
        start = F.greatest(s["free"], x["chunk"] * size)
        after = F.coalesce(F.get(x["next_"], (start - x["chunk"] * size).cast("int")), s["free"])
        return F.struct(after.alias("free"), F.array_append(s["out"], F.struct(x["chunk"].alias("chunk"), start.alias("free"))).alias("out")).cast(kind)

    zero = F.struct(F.lit(0).cast("bigint").alias("free"), F.array().cast("array<struct<chunk: bigint, free: bigint>>").alias("out")).cast(kind)
    folded = summed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", "next_"))).alias("c_")).select(*by, F.inline(F.aggregate("c_", zero, step, lambda s: s["out"])))
    fits = _given(held, folded, by)
    items = F.filter("rows_", lambda x: x["frame"] >= F.col("free"))
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.select("frame", *rest).schema)
    return fits.select(*by, F.inline(greedy_min_gap(items, gap, f"struct<{types}>", lambda x: x["frame"])))


def stances(contacts: DataFrame, by: list[str], fps: float, size: int = SIZE) -> DataFrame:
    """Adds toe_off and gct_ms: a default stance on, but two frames before the next contact, or the last frame when there is none. contacts: by, frame, last."""
    c = chunked(contacts, size)
    w = _in_chunk(by)
    firsts = c.groupBy(*by, "chunk").agg(F.min("frame").alias("first_"))
    firsts = firsts.select(*by, "chunk", F.lead("first_").over(_chunks(by)).alias("beyond_"))
    after = F.coalesce(F.lead("frame").over(w), F.col("beyond_"))
    c = _given(c, firsts, by).withColumn("toe_off", F.least(F.col("frame") + int(0.18 * fps), F.coalesce(after - 2, F.col("last"))))
    return c.withColumn("gct_ms", (F.col("toe_off") - F.col("frame")).cast("double") / num(fps) * num(1000)).drop("beyond_", "chunk")


def coarse_contacts(gait: DataFrame, height: float, fps: float, low_ms: float = 80, high_ms: float = 400, vis: str = "vis", size: int = SIZE) -> DataFrame:
    """contacts.coarse_contacts of legs of any length: clip_id, leg, frame, last, confidence, toe_off, gct_ms."""
    leg = ["clip_id", "leg"]
    rows = chunked(gait.select(*leg, "frame", "comp", vis), size)
    whole = of_sequence(rows, leg, seen_=(F.sum(vis), F.sum("seen_")), n_=(F.count(vis), F.sum("n_")), last=(F.max("frame"), F.max("last")))
    sigma = F.when(F.col("seen_") / F.col("n_") > 0.5, num(2)).otherwise(num(3))
    rows = _given(rows, whole.select(*leg, "chunk", sigma.alias("sigma"), "last"), leg).drop("chunk")
    df = interpolate(rows, leg, "comp", "full", size)
    v = down_crossings(gradient(gaussian(df, leg, "full", "smooth", "sigma", size), leg, "smooth", "v", size), leg, "v", 0.001 * height, size)
    trust = F.least(num(1), F.greatest(num(0.2), F.col(vis) / num(0.6)))
    hits = v.where("crossing").select(*leg, F.col("frame").cast("bigint").alias("frame"), trust.alias("confidence"), "last")
    taken = greedy(hits, leg, int(0.1 * fps), ["confidence", "last"], size)
    staged = stances(taken, leg, fps, size).where((F.col("gct_ms") > low_ms) & (F.col("gct_ms") < high_ms)).drop("toe_off", "gct_ms")
    return stances(staged, leg, fps, size).select(*leg, "frame", "last", "confidence", "toe_off", "gct_ms")
