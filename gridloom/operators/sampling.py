"""Repeatable samples and train/test splits.

Rows are ranked by a seeded hash of their key. Cut-offs come from exact order
statistics of the hash, so a split is a filter on each row: no class and no
table is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import micros
from gridloom.operators.quantiles import IN_MEMORY_ROWS, order_statistics


def hash_rank(key: str, seed: int = 42) -> Column:
    """52-bit number from MD5 of ``key:seed``; any SQL engine gives the same."""
    text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def bounded_sample(df: DataFrame, key: str, rows: int = 3000, seed: int = 42) -> DataFrame:
    """A random sample of min(rows, n) rows: those of the smallest hash.

    The count gives a limit of the hash that somewhat more than ``rows`` rows
    pass, so that a merge of all tasks' candidates stays at that size. Hashes
    are uniform; should fewer rows pass all the same, the limit is lifted.
    """
    marked = df.withColumn("_h", hash_rank(key, seed))
    n = df.count()
    wanted = min(rows, n)
    limit = int(min(1.0, (wanted + 10 * wanted**0.5 + 20) / max(n, 1)) * (1 << 52))
    few = marked.filter(F.col("_h") < limit)
    if limit < 1 << 52 and few.count() >= wanted:
        marked = few
    return marked.orderBy("_h", key).limit(rows).drop("_h")


def stratified_split(
    df: DataFrame, key: str, target: str, test_share: float = 0.2, seed: int = 42,
    max_classes: int = 10, in_memory_rows: int = IN_MEMORY_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, split per class when the target has few values."""
    values = df.select(target).distinct().limit(max_classes + 1).count()
    marked = df.withColumn("_h", hash_rank(key, seed))
    by = (target,) if values <= max_classes else ()
    sizes = {tuple(r)[:-1]: r["n"] for r in marked.groupBy(*by).agg(F.count("*").alias("n")).collect()}
    tests = _test_rows(sizes, test_share)
    ranks = {g: [t - 1] for g, t in tests.items() if t > 0}
    cuts = order_statistics(marked, "_h", ranks, by, in_memory_rows)
    limit = F.lit(None).cast("long")
    for (group, _), value in cuts.items():
        chosen = F.col(target).eqNullSafe(F.lit(group[0])) if by else F.lit(True)
        limit = F.when(chosen, F.lit(int(value))).otherwise(limit)
    is_test = F.coalesce(F.col("_h") <= limit, F.lit(False))
    return marked.filter(~is_test).drop("_h"), marked.filter(is_test).drop("_h")


def _test_rows(sizes: dict[tuple, int], share: float) -> dict[tuple, int]:
    """Whole test rows per class: the total is rounded up, remainders go to the largest."""
    total = math.ceil(round(share * sum(sizes.values()), 9))
    exact = {g: share * n for g, n in sizes.items()}
    out = {g: math.floor(round(x, 9)) for g, x in exact.items()}
    left = total - sum(out.values())
    for g in sorted(exact, key=lambda g: (-(exact[g] - out[g]), -sizes[g], str(g)))[:left]:
        out[g] += 1
    return out


#: Time of a row without one: after all others, and exact as a double.
_LAST = 1 << 62


def chronological_split(
    df: DataFrame, ts: str, tie: str, train_share: float = 0.8, in_memory_rows: int = IN_MEMORY_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The first int(share * n) rows in (ts, tie) order, and the rest; rows without a time come last.

    The cut is found from order statistics: first of the time, then of the
    tie-breaker, a whole number, among the rows that share the time of the cut.
    """
    marked = df.withColumn("_t", F.coalesce(micros(F.col(ts)), F.lit(_LAST)))
    n = marked.count()
    k = int(n * train_share)
    if k == 0 or k == n:
        return (df.limit(0), df) if k == 0 else (df, df.limit(0))
    at = int(order_statistics(marked, "_t", {(): [k]}, (), in_memory_rows)[((), k)])
    earlier = marked.filter(F.col("_t") < at).count()
    same = marked.filter(F.col("_t") == at)
    cut = int(order_statistics(same, tie, {(): [k - earlier]}, (), in_memory_rows)[((), k - earlier)])
    first = (F.col("_t") < at) | ((F.col("_t") == at) & (F.col(tie) < cut))
    return marked.filter(first).drop("_t"), marked.filter(~first).drop("_t")
