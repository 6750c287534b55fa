"""Order-dependent operators over a whole table, without a one-task window.

A window ordered over the whole table (or over one hot key) runs in a single
task. Here the rows are range-partitioned and sorted once, numbered, and cut
into blocks of equal length. Frames of bounded length then run per block, with
the few rows before and after a block copied into it; unbounded fills run per
block and carry the block ends over a table of one row per block. Results are
the same as those of the plain window and do not depend on the block length.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.calendar import micros
from gridloom.session import SMALL_ROWS, materialize

MIN_BLOCK_ROWS = 25_000
MAX_BLOCKS = 100_000
_LOW_BITS = 33  # monotonically_increasing_id: partition above, position below


def number_rows(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Sort by ``order`` and number the rows from 0; ``order`` must be unique.

    The range partitioning spreads rows by their full key, so many equal
    timestamps still split on the tie-breaker. Partition and position are
    written out once: they stay the same however often the result is read.
    """
    laid = (
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    laid = materialize(laid, "ordered")
    part, place = F.shiftright("_mid", _LOW_BITS), F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    laid = laid.withColumns({"_part": part, "_place": place})
    # One row per sorted partition, a few thousand at most.
    ends = laid.groupBy("_part").agg(F.max("_place").alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_start"))
    return laid.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_place")).drop(
        "_part", "_place", "_start", "_mid"
    )


def _positions(df: DataFrame, order: list[str], index: str | None) -> DataFrame:
    """Rows with ``_idx``: an existing position column, or a fresh numbering."""
    return df.withColumn("_idx", F.col(index)) if index else number_rows(df, order, "_idx")


def _block_rows(df: DataFrame, least: int, block_rows: int | None) -> int:
    """Block length: long enough for the frame and for at most MAX_BLOCKS blocks."""
    if block_rows is None:
        block_rows = max(MIN_BLOCK_ROWS, math.ceil(df.count() / MAX_BLOCKS))
    return max(block_rows, least, 1)


def bounded_windows(
    df: DataFrame,
    order: list[str],
    columns: Callable[[WindowSpec], dict[str, Column]],
    by: list[str] = (),
    before: int = 24,
    after: int = 0,
    block_rows: int | None = None,
    index: str | None = None,
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` ahead.

    ``columns`` receives the window specification (partitioned by block and
    ``by``, ordered by position) and returns the new columns. With ``by`` the
    frames stay within the key, and a hot key is spread over its blocks.
    ``index`` names a column that already holds the position in (by, order),
    as ``number_rows`` makes it; the sort is then skipped.
    """
    by = list(by)
    numbered = _positions(df, by + list(order), index)
    size = _block_rows(numbered, before + after + 1, block_rows)
    home = (F.col("_idx") / F.lit(size)).cast("long")
    place = F.col("_idx") % F.lit(size)
    visits = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(place >= size - before, F.col("_home") + 1) if before else F.lit(None).cast("long"),
            F.when((place < after) & (F.col("_home") > 0), F.col("_home") - 1) if after else F.lit(None).cast("long"),
        )
    )
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(visits))
    window = Window.partitionBy("_block", *by).orderBy("_idx")
    out = spread.withColumns(columns(window)).filter(F.col("_block") == F.col("_home"))
    return out.drop("_block", "_home", "_idx")


def _anchor(ts: str | None, column: str) -> Column:
    """Struct (t, v) of a non-null value, null otherwise."""
    t = F.col(ts) if ts else F.lit(0)
    return F.when(F.col(column).isNotNull(), F.struct(t.alias("t"), F.col(column).alias("v")))


def _neighbours(
    df: DataFrame, order: list[str], columns: list[str], ts: str | None, by: list[str],
    block_rows: int | None, backward: bool, index: str | None,
) -> DataFrame:
    """Add ``_next_c`` (and ``_prev_c``): nearest non-null (t, v) at or after (before) the row."""
    numbered = _positions(df, by + order, index)
    size = _block_rows(numbered, 1, block_rows)
    blocked = numbered.withColumn("_block", (F.col("_idx") / F.lit(size)).cast("long"))
    # Value and time apart: buffers of fixed width are kept in a hash table, structs would be sorted.
    known = {c: F.when(F.col(c).isNotNull(), F.col("_idx")) for c in columns}
    parts = {c: {"v": F.col(c), "t": F.col(ts) if ts else F.lit(0)} for c in columns}
    edges = {"first": F.min_by} | ({"last": F.max_by} if backward else {})
    ends = blocked.groupBy("_block", *by).agg(
        *[pick(x, known[c]).alias(f"_{edge}_{p}_{c}") for c in columns for edge, pick in edges.items() for p, x in parts[c].items()])
    ends = ends.select("_block", *by, *[
        F.when(F.col(f"_{edge}_v_{c}").isNotNull(), F.struct(F.col(f"_{edge}_t_{c}").alias("t"), F.col(f"_{edge}_v_{c}").alias("v"))).alias(f"_{edge}_{c}")
        for c in columns for edge in edges])
    # One row per block and key: at most MAX_BLOCKS rows per key.
    behind = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("_block").alias("_b"), *[F.col(b).alias(f"_by_{b}") for b in by],
        *[F.last(f"_first_{c}", ignorenulls=True).over(ahead).alias(f"_ahead_{c}") for c in columns],
        *([F.last(f"_last_{c}", ignorenulls=True).over(behind).alias(f"_behind_{c}") for c in columns] if backward else []),
    )
    match = blocked["_block"] == carried["_b"]
    for b in by:
        match = match & blocked[b].eqNullSafe(carried[f"_by_{b}"])
    joined = blocked.join(carried, match, "left")
    # Looking ahead is looking back in descending order: a frame that grows is
    # kept up row by row, a frame that shrinks would be recomputed for each row.
    so_far = Window.unboundedPreceding, Window.currentRow
    past = Window.partitionBy("_block", *by).orderBy("_idx").rowsBetween(*so_far)
    onward = Window.partitionBy("_block", *by).orderBy(F.desc("_idx")).rowsBetween(*so_far)
    found = {
        f"_next_{c}": F.coalesce(F.last(_anchor(ts, c), ignorenulls=True).over(onward), F.col(f"_ahead_{c}"))
        for c in columns
    }
    if backward:
        found |= {
            f"_prev_{c}": F.coalesce(F.last(_anchor(ts, c), ignorenulls=True).over(past), F.col(f"_behind_{c}"))
            for c in columns
        }
    return joined.withColumns(found).select(*df.columns, *found)


def fill_next(
    df: DataFrame, columns: list[str], order: list[str], by: list[str] = (),
    block_rows: int | None = None, last_resort: float | None = 0, index: str | None = None,
) -> DataFrame:
    """Replace nulls by the next non-null value, then by ``last_resort``.

    The rows are read several times; with ``index`` pass a written table. With
    ``index``, up to SMALL_ROWS rows with nulls get their values from a small
    table of these rows and the rows after them, and the others are not moved.
    """
    if not columns:
        return df
    types, by = dict(df.dtypes), list(by)
    filled = {}
    for c in columns:
        value = F.col(f"_next_{c}")["v"]
        filled[c] = value if last_resort is None else F.coalesce(value, F.lit(last_resort).cast(types[c]))
    gap = functools.reduce(operator.or_, [F.col(c).isNull() for c in columns])
    few = index is not None
    if few:
        at = materialize(df.filter(gap).select(F.col(index).alias("_at")).limit(SMALL_ROWS + 1), "gaps")
        few = at.count() <= SMALL_ROWS
    if not few:
        near = _neighbours(df, list(order), list(columns), None, by, block_rows, False, index)
        return near.withColumns(filled).select(*df.columns)
    # The value that ends a run of nulls is in the row after a row with nulls.
    places = at.select(F.explode(F.array(F.col("_at"), F.col("_at") + 1)).alias("_at"))
    narrow = df.select(*dict.fromkeys([index, *by, *columns]))
    narrow = materialize(narrow.join(F.broadcast(places), narrow[index] == places["_at"], "left_semi"), "gap-rows")
    near = _neighbours(narrow, list(order), list(columns), None, by, block_rows, False, index).filter(gap)
    fills = materialize(near.select(F.col(index).alias("_at"), *[v.alias(f"_fill_{c}") for c, v in filled.items()]), "fills")
    joined = df.join(F.broadcast(fills), df[index] == fills["_at"], "left")
    return joined.withColumns({c: F.coalesce(c, f"_fill_{c}") for c in columns}).select(*df.columns)


def interpolate_time(
    df: DataFrame, columns: list[str], ts: str, order: list[str], by: list[str] = (),
    block_rows: int | None = None, index: str | None = None,
) -> DataFrame:
    """Fill nulls on the straight line in time between the neighbouring values.

    Before the first and after the last value the nearest value is taken. An
    integer column becomes double, as the line has fractions.
    """
    if not columns:
        return df
    near = _neighbours(df, list(order), list(columns), ts, list(by), block_rows, True, index)
    types = dict(df.dtypes)
    kind = {c: types[c] if types[c] in ("float", "double") or types[c].startswith("decimal") else "double" for c in columns}
    filled = {c: _on_line(F.col(f"_prev_{c}"), F.col(f"_next_{c}"), F.col(ts)).cast(kind[c]) for c in columns}
    kept = {c: F.coalesce(F.col(c).cast(kind[c]), filled[c]) for c in columns}
    return near.withColumns(kept).select(*df.columns)


def _on_line(prev: Column, nxt: Column, ts: Column) -> Column:
    run = micros(nxt["t"]) - micros(prev["t"])
    rise = (nxt["v"] - prev["v"]).cast("double")
    point = F.when(run == 0, prev["v"].cast("double")).otherwise(
        prev["v"] + rise * F.try_divide((micros(ts) - micros(prev["t"])).cast("double"), run.cast("double"))
    )
    return F.coalesce(point, prev["v"].cast("double"), nxt["v"].cast("double"))


def running_totals(
    df: DataFrame, order: list[str], sums: dict[str, Column], block_rows: int | None = None,
) -> DataFrame:
    """Add running sums over the whole order, current row included."""
    numbered = number_rows(df.withColumns({f"_in_{n}": e for n, e in sums.items()}), order, "_idx")
    size = _block_rows(numbered, 1, block_rows)
    blocked = numbered.withColumn("_block", (F.col("_idx") / F.lit(size)).cast("long"))
    totals = blocked.groupBy("_block").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    within = Window.partitionBy("_block").orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = blocked.join(starts, "_block")
    return joined.withColumns(
        {n: F.col(f"_s_{n}") + F.sum(f"_in_{n}").over(within) for n in sums}
    ).select(*df.columns, *sums)
