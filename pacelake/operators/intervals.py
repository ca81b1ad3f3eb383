"""Joins of intervals that overlap, by cells: an equality join, whatever the intervals' lengths.

An interval has a level by its length (cells of that level are about as long as it) and lies in the few cells there that it touches. Two intervals
meet at the higher one of their levels: the longer one in its own cells, the shorter one in the cell or two that it touches
there. So a short interval never pays for the length of a long one, nor a long one for being cut into short cells. A
pair may share several cells; it counts in the one where the later of both begins, and in no other.

Cells with many intervals on both sides are dealt as a grid of blocks, each a task's work of its own. Where far more pairs
than rows lie in cells, the shorter intervals of a block are one row with an array, which each of the longer ones opens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, if_few

#: Intervals of one side that a block of a crowded cell holds.
BLOCK = 2_048
#: Pairs that share a cell for each row in the cells, above which blocks are arrays.
MANY_PAIRS = 32


def _levels(start: Column, stop: Column, unit: float) -> Column:
    """The least level whose cells are at least as long as the interval."""
    return F.ceil(F.log2(F.greatest((stop - start).cast("double") / unit, F.lit(1.0)))).cast("int")


def _cell(place: Column, level: Column, unit: float) -> Column:
    return F.floor(place.cast("double") / (F.lit(float(unit)) * F.pow(F.lit(2.0), level))).cast("bigint")


def _cells(df: DataFrame, level: Column, unit: float) -> DataFrame:
    """A row for each cell of a level that the interval touches."""
    df = df.withColumn("level_", level)
    return df.withColumn("cell_", F.explode(F.sequence(_cell(F.col("start_"), F.col("level_"), unit), _cell(F.col("stop_"), F.col("level_"), unit))))


def _met(longer: DataFrame, shorter: DataFrame, by: list[str], unit: float, block: int, scratch: Scratch) -> DataFrame:
    """Pairs (struct a of longer, b of shorter) that overlap; each in one cell of level_."""
    keys = [*by, "level_", "cell_"]
    longer, shorter = scratch.save(longer, "longer"), scratch.save(shorter, "shorter")
    # cells with more of both sides than a block holds
    n = longer.groupBy(*keys).agg(F.count("*").alias("n_a")).join(shorter.groupBy(*keys).agg(F.count("*").alias("n_b")), keys)
    seen, n_a, n_b = Observation(), F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n.observe(seen, F.sum(n_a * n_b).alias("pairs"), F.sum(n_a + n_b).alias("rows"))
    crowded = n.where((F.col("n_a") > block) | (F.col("n_b") > block)).select(*keys, F.ceil(F.col("n_a") / block).cast("int").alias("rows_"), F.ceil(F.col("n_b") / block).cast("int").alias("columns_"))
    crowded = if_few(scratch.save(crowded, "crowded"))

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        df = df.join(crowded, keys, "left").withColumns({"rows_": F.coalesce("rows_", F.lit(1)), "columns_": F.coalesce("columns_", F.lit(1))})
        # by the row's own number, so that equal rows go to all blocks too
        df = df.withColumn(mine, F.pmod(F.xxhash64("no_"), F.col(own)).cast("int"))
        df = df.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("rows_", "columns_")
        return df.withColumn("here_", F.col("cell_") == _cell(F.col("start_"), F.col("level_"), unit))

    places = ("start_", "stop_", "here_", "row_")
    a = dealt(longer, "rows_", "columns_", "i_", "j_").select(*keys, "i_", "j_", *(F.col(c).alias("a_" + c) for c in places))
    b = dealt(shorter, "columns_", "rows_", "j_", "i_").select(*keys, "i_", "j_", F.struct(*(F.col(c).alias("b_" + c) for c in places)).alias("b"))
    block_of = [*keys, "i_", "j_"]
    if (seen.get["pairs"] or 0) > MANY_PAIRS * (seen.get["rows"] or 0):
        # a pair costs no more than its own row; the number of partitions is named, as their bytes say nothing of their pairs
        parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a, b = a.repartition(parts, *block_of), b.repartition(parts, *block_of).groupBy(*block_of).agg(F.collect_list("b").alias("b"))
        pairs = a.join(b, block_of).select(*by, *(f"a_{c}" for c in places), F.inline("b"))
    else:
        pairs = a.join(b, block_of).select(*by, *(f"a_{c}" for c in places), "b.*")
    # the later one begins in this cell, so that no other cell has the pair
    met = pairs.where((F.col("a_start_") <= F.col("b_stop_")) & (F.col("b_start_") <= F.col("a_stop_")) & (F.col("a_here_") | F.col("b_here_")))
    return met.select(*by, F.col("a_row_").alias("a"), F.col("b_row_").alias("b"))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_on: tuple[str, str], right_on: tuple[str, str], unit: float = 1, prefix: str = "right_", block: int = BLOCK) -> DataFrame:
    """Each left row with each right row of the same keys whose interval, both ends counted, overlaps its own.

    left_on and right_on name the first and the last place of an interval (numbers of one kind; for points, the same
    column twice). unit: about the length of the shortest interval. Right columns other than by keep their names, or get the
    prefix where the left table has them too. Rows with a NULL key or end, or whose interval ends before it begins, meet nothing."""
    scratch = Scratch(left.sparkSession, "intervals")
    own = [c for c in right.columns if c not in by]

    def side(df: DataFrame, columns: list[str], on: tuple[str, str]) -> DataFrame:
        start, stop = (F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) if dict(df.dtypes)[c] in ("float", "double") else F.col(f"`{c}`") for c in on)
        row = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("none"))
        df = df.select(*(F.col(f"`{c}`") for c in by), row.alias("row_"), start.alias("start_"), stop.alias("stop_"))
        fine = (F.col("start_") <= F.col("stop_")) & (F.abs("start_") < float("inf")) & (F.abs("stop_") < float("inf"))
        for c in by:
            fine = fine & F.col(f"`{c}`").isNotNull()
        return df.where(fine).withColumns({"own_": _levels(F.col("start_"), F.col("stop_"), unit), "no_": F.monotonically_increasing_id()})

    # each side is written once, as its levels are asked for before its cells, and both are needed in all cells
    l_ = scratch.save(side(left, [c for c in left.columns if c not in by], left_on), "left")
    r = scratch.save(side(right, own, right_on), "right")
    # the levels of each side: as many as doublings between the shortest and the longest interval
    levels = lambda df: sorted(x["own_"] for x in df.select("own_").distinct().collect())
    of_left, of_right = levels(l_), levels(r)

    def above(df: DataFrame, others: list[int], own_too: bool) -> DataFrame:
        """The rows in the cells of all levels of the other side above their own (and of their own, if the other side has it)."""
        at = F.explode(F.array(*map(F.lit, others))) if others else F.explode(F.array().cast("array<int>"))
        df = df.withColumn("at_", at).where(F.col("at_") >= F.col("own_") if own_too else F.col("at_") > F.col("own_"))
        return _cells(df, F.col("at_"), unit).drop("own_", "at_")

    at_own = lambda df: _cells(df, F.col("own_"), unit).drop("own_")
    first = _met(at_own(l_), above(r, of_left, True), by, unit, block, scratch).select(*by, "a", "b")
    second = _met(at_own(r), above(l_, of_right, False), by, unit, block, scratch).select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    both = first.unionByName(second) if any(x > y for x in of_right for y in of_left) else first
    names = {c: c if c not in left.columns else prefix + c for c in own}
    return both.select(*(F.col(f"`{c}`") if c in by else F.col(f"a.`{c}`") for c in left.columns), *(F.col(f"b.`{c}`").alias(names[c]) for c in own))


def in_cells(df: DataFrame, low: Column, high: Column, width: int, name: str = "cell_") -> DataFrame:
    """The rows once for each cell of one width that low to high touches; none where high is below low."""
    return df.withColumn(name, F.explode(F.when(low <= high, F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))
