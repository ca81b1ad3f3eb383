"""As-of joins of two tables: for each row of one the nearest row of the other, in time and with the same keys.

Both tables are stacked and range-sorted once, by key and time. A task finds for each left row the last right row before
it and the next one behind it in chunks of its range, so that it holds one chunk, however long the range; what a chunk has at its ends is carried to the chunks
beside it, also into other ranges, so a key of any size is spread over as many tasks as it fills. The driver gets the keys at the ends of each chunk, never
rows; what is carried is at most one row a chunk.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.scratch import Scratch

#: Rows that a task holds at a time, at least (the last batch of a chunk comes on top).
CHUNK = 50_000


def as_number(df: DataFrame, column: str) -> Column:
    """The column's times as bigint (days or microseconds for dates and timestamps) or double; NULL and NaN are NULL."""
    kind, c = dict(df.dtypes)[column], F.col(f"`{column}`")
    if kind == "date":
        return F.unix_date(c).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        micros = lambda n: F.lit(n * 1_000_000).cast("bigint")
        seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return F.unix_date(c.cast("date")) * micros(86_400) + F.hour(c) * micros(3_600) + F.minute(c) * micros(60) + seconds
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("bigint")
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _nearest_rows(rows: DataFrame, back: bool, ahead: bool, right: StructType):
    """Rows of the left table with b_ and f_, the right rows before and behind; and rows for each chunk with what its ends hold. part_ ascends over the chunks of all ranges."""
    kind = rows.schema["at_"].dataType
    out = StructType(
        [
            *rows.select("key_", "at_", "left_").schema.fields,
            *(StructField(c, StructType([StructField("at", kind), StructField("row", right)])) for c in ("b_", "f_")),
            *StructType.fromDDL("part_ bigint, first_run_ boolean, last_run_ boolean, edge_ boolean, n_runs_ long").fields,
        ]
    )
    names = [f.name for f in out.fields]

    def run(batches):
        held, n, part = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= CHUNK:
                yield from of_chunk(held, n, part)
                held, n, part = [], 0, part + 1
        if n:
            yield from of_chunk(held, n, part)

    def of_chunk(held, n, part):
        t = pa.Table.from_batches(held).combine_chunks()
        key, at, is_right, right_rows = (t.column(c).combine_chunks() for c in ("key_", "at_", "is_right_", "right_"))
        side = is_right.to_numpy(zero_copy_only=False)
        new = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]
        run_no = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        place = np.arange(n)
        before = np.maximum.accumulate(np.where(side, place, -1))
        before = np.where(before >= starts[run_no], before, -1)
        ends = np.r_[starts[1:], n]
        behind = np.minimum.accumulate(np.where(side, place, n)[::-1])[::-1]
        behind = np.where(behind < ends[run_no], behind, -1)
        pair = pa.StructArray.from_arrays([at, right_rows], ["at", "row"])

        def at_places(index: np.ndarray, wanted: bool) -> pa.Array:
            mask = (index < 0) if wanted else np.ones(len(index), bool)
            return pair.take(pa.array(np.where(mask, 0, index), pa.int64(), mask=mask))

        def emit(rows_: np.ndarray, b, f, edge: bool) -> pa.Table:
            m = len(rows_)
            flags = [pa.array(np.full(m, part, np.int64)), pa.array(run_no[rows_] == 0), pa.array(run_no[rows_] == run_no[-1]), pa.array(np.full(m, edge)), pa.array(np.full(m, run_no[-1] + 1, np.int64))]
            taken = t.select(["key_", "at_", "left_"]).take(pa.array(rows_))
            return pa.table([*taken.columns, b, f, *flags], names)

        left = np.flatnonzero(~side)
        yield from emit(left, at_places(before[left], back), at_places(behind[left], ahead), False).combine_chunks().to_batches(max_chunksize=10_000)
        # the ends of this chunk: the first right row of its first key, the last one of its last
        for row, b, f in ((np.array([0]), np.array([-1]), behind[:1]), (np.array([n - 1]), before[-1:], np.array([-1]))):
            yield from emit(row, at_places(b, back), at_places(f, ahead), True).combine_chunks().to_batches()

    return rows.mapInArrow(run, out)


def _carried(ends: list, ahead: bool) -> list[tuple[int, int]]:
    """For each chunk whose rows may look beyond it: the chunk whose end has what they find there."""
    by_part: dict[int, dict[str, tuple]] = {}
    for e in ends:
        own = by_part.setdefault(e["part_"], {"n": e["n_runs_"]})
        # the first row has f_ and the last one b_; a chunk of one row has both kinds, told apart by what they have
        if e["first"]:
            own["first"] = (e["key_"], own.get("first", (None, False))[1] or e["has_f"])
        if e["last"]:
            own["last"] = (e["key_"], own.get("last", (None, False))[1] or e["has_b"])
    out, key, source = [], None, None
    near, far = ("last", "first") if ahead else ("first", "last")
    for part in sorted(by_part, reverse=ahead):
        own = by_part[part]
        if source is not None and own[near][0] == key:
            out.append((part, source))
        else:
            source = None
        if own[far][1]:
            source = part
        elif own["n"] > 1:
            source = None
        key = own[far][0]
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    direction: str = "backward",
    tolerance: float | timedelta | None = None,
    exact: bool = True,
    nearest_tie: str = "backward",
    latest: list[str] | None = None,
    prefix: str = "right_",
) -> DataFrame:
    """The left table with the columns of the right row that is nearest in time, NULL where there is none.

    direction: backward (the last right row at or before the left one), forward (the first at or behind it) or nearest (by
    distance; nearest_tie says which of two equally near). exact: whether a right row of the same time counts. tolerance: the
    greatest distance that counts, a timedelta for timestamps. Of right rows with one key and time the greatest by the columns
    of latest counts (without latest, by a hash). Right columns other than by keep their names, or get the prefix where the
    left table has them too. Rows whose keys or time are NULL or NaN meet nothing. Both tables are read once."""
    if direction not in ("backward", "forward", "nearest") or nearest_tie not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}, {nearest_tie}")
    if direction == "nearest" and not exact:
        raise ValueError("the nearest row may be of the same time")
    spark = left.sparkSession
    scratch = Scratch(spark, "asof")
    kinds = {df.select(as_number(df, c)).dtypes[0][1] for df, c in ((left, left_on), (right, right_on))}
    kind = "double" if "double" in kinds else "bigint"
    own = [c for c in right.columns if c not in by]
    renamed = {c: c if c not in left.columns else prefix + c for c in own}
    order = [F.col(f"`{c}`") for c in latest] if latest else [F.xxhash64(*(F.col(f"`{c}`") for c in own))]
    keys = F.to_json(F.struct(*(F.col(f"`{c}`") for c in by)), {"ignoreNullFields": "false"}) if by else F.lit("")
    known = F.lit(True)
    for c in by:
        known = known & F.col(f"`{c}`").isNotNull()

    r = right.withColumn("at_", as_number(right, right_on).cast(kind)).where(known & F.col("at_").isNotNull())
    packed = F.struct(*(F.col(f"`{c}`").alias(renamed[c]) for c in own))
    # one right row for a key and time
    r = r.select(keys.alias("key_"), "at_", packed.alias("right_"), F.struct(*order).alias("order_")).groupBy("key_", "at_").agg(F.max_by("right_", "order_").alias("right_"))
    fields = r.schema["right_"].dataType
    l_ = left.withColumn("at_", as_number(left, left_on).cast(kind))
    whole = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    meets = known & F.col("at_").isNotNull()
    alone = l_.where(~F.coalesce(meets, F.lit(False))).select(*(F.col(f"`{c}`") for c in left.columns), *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields))
    l_ = l_.where(meets).select(keys.alias("key_"), "at_", whole.alias("left_"))

    # of one time, a right row that counts stands where the left one looks
    right_first = exact if direction != "forward" else not exact
    rows = l_.select("key_", "at_", F.lit(False).alias("is_right_"), "left_", F.lit(None).cast(fields).alias("right_")).unionByName(
        r.select("key_", "at_", F.lit(True).alias("is_right_"), F.lit(None).cast(l_.schema["left_"].dataType).alias("left_"), "right_")
    )
    rows = rows.withColumns({"side_": F.col("is_right_") != F.lit(right_first), "salt_": F.xxhash64("left_")})
    by_time = ["key_", "at_", "side_", "salt_"]
    rows = rows.repartitionByRange(*by_time).sortWithinPartitions(*by_time).drop("side_", "salt_")
    back, ahead = direction != "forward", direction != "backward"
    found = scratch.save(_nearest_rows(rows, back, ahead, fields), "found")
    edges = found.where("edge_").select("part_", "key_", F.col("first_run_").alias("first"), F.col("last_run_").alias("last"), "n_runs_", F.col("b_").isNotNull().alias("has_b"), F.col("f_").isNotNull().alias("has_f")).collect()
    found_left = found.where("not edge_")
    for wanted, column, look, run in ((back, "b_", False, "first_run_"), (ahead, "f_", True, "last_run_")):
        pairs = _carried(edges, look) if wanted else []
        if pairs:
            # at most one row a chunk
            sources = spark.createDataFrame(pairs, "part_ bigint, source_ bigint")
            ends = found.where(F.col("edge_") & F.col(column).isNotNull()).select(F.col("part_").alias("source_"), F.col(column).alias("carried_"))
            found_left = found_left.join(F.broadcast(sources.join(ends, "source_").select("part_", "carried_")), "part_", "left")
            found_left = found_left.withColumn(column, F.coalesce(column, F.when(F.col(run), F.col("carried_")))).drop("carried_")

    gap = lambda c: F.abs(F.col("at_") - F.col(f"{c}.at"))
    if direction == "nearest":
        nearer = (gap("b_") <= gap("f_")) if nearest_tie == "backward" else (gap("b_") < gap("f_"))
        chosen = F.when(F.col("f_").isNull() | nearer, F.col("b_")).otherwise(F.col("f_"))
    else:
        chosen = F.col("b_" if back else "f_")
    out = found_left.select("left_", "at_", chosen.alias("chosen_"))
    if tolerance is not None:
        most = tolerance // timedelta(microseconds=1) if isinstance(tolerance, timedelta) else tolerance
        out = out.withColumn("chosen_", F.when(F.abs(F.col("at_") - F.col("chosen_.at")) <= F.lit(most), F.col("chosen_")))
    return out.select("left_.*", *(F.col(f"chosen_.row.`{f.name}`").alias(f.name) for f in fields.fields)).unionByName(alone)
