"""Exact quantiles and order statistics without holding a column in one task.

Small groups use Spark's exact ``percentile``. A group above ``in_memory_rows``
is narrowed instead: each pass counts, for a bracket of values around every
wanted rank, the rows below, on and inside it, and sketches the inside. The
sketch only proposes the next bracket; the counts prove where the rank lies,
so the answer is exact. A value held by many rows ends on a bracket edge and
is recognised there by its count. Passes are map-side aggregates: no shuffle
of the data, and a thousandfold table needs about one pass more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IN_MEMORY_ROWS = 200_000
BROADCAST_GROUPS = 20_000
_STEPS = 200
_ACCURACY = 2000


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    by: tuple[str, ...] = (),
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> DataFrame:
    """Rows (by..., column, quantiles): linear-interpolated, nulls ignored."""
    by = tuple(by)
    sizes = df.groupBy(*by).agg(F.greatest(*[F.count(c) for c in columns], F.lit(0)).alias("_n"))
    heavy = [tuple(r)[:-1] for r in sizes.filter(F.col("_n") > in_memory_rows).collect()]
    if not heavy:
        return _builtin(df, columns, probs, by)
    keys = df.sparkSession.createDataFrame(heavy, _key_schema(df, by)) if by else None
    exact = _narrowed(df, columns, probs, by, keys, in_memory_rows)
    if not by:
        return exact
    rest = df.join(keys, _null_safe(df, keys, by), "left_anti")
    return _builtin(rest, columns, probs, by).unionByName(exact)


def order_statistics(
    df: DataFrame, column: str, ranks: dict[tuple, list[int]], by: tuple[str, ...] = (),
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> dict[tuple[tuple, int], float]:
    """Value at each 0-based rank per group; the group of no ``by`` is ``()``.

    Values pass through double precision: integers up to 2**53 are exact.
    """
    sizes = {
        tuple(r)[:-1]: r["_n"] for r in df.groupBy(*by).agg(F.count(column).alias("_n")).collect()
    }
    wanted = {(g, column, k): sizes[g] for g, ks in ranks.items() for k in ks}
    found = _select(df, by, wanted, in_memory_rows)
    return {(g, k): v for (g, _, k), v in found.items()}


def _builtin(df, columns, probs, by):
    return df.groupBy(*by).agg(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.percentile(F.col(c).cast("double"), probs).alias("quantiles")) for c in columns]
        ).alias("_q")
    ).select(*by, F.inline("_q"))


def _narrowed(df, columns, probs, by, keys, in_memory_rows):
    spark = df.sparkSession
    big = df.join(keys, _null_safe(df, keys, by), "left_semi") if by else df
    counted = big.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns]).collect()
    sizes = {(tuple(r)[: len(by)], c): r[c] for r in counted for c in columns}
    wanted = {}
    for (group, column), n in sizes.items():
        for p in probs if n else ():
            for k in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                wanted[(group, column, k)] = n
    found = _select(big, by, wanted, in_memory_rows)
    rows = []
    for (group, column), n in sizes.items():
        values = []
        for p in probs if n else ():
            rank = p * (n - 1)
            low, high = found[(group, column, math.floor(rank))], found[(group, column, math.ceil(rank))]
            values.append(low if low == high else low + (high - low) * (rank - math.floor(rank)))
        rows.append((*group, column, values or None))
    schema = T.StructType(
        _key_schema(df, by).fields
        + [T.StructField("column", T.StringType()), T.StructField("quantiles", T.ArrayType(T.DoubleType()))]
    )
    return spark.createDataFrame(rows, schema)


def _key_schema(df, by):
    return T.StructType([T.StructField(b, df.schema[b].dataType) for b in by])


def _null_safe(left, right, by):
    condition = F.lit(True)
    for b in by:
        condition = condition & left[b].eqNullSafe(right[b])
    return condition


def _select(df, by, wanted, in_memory_rows):
    """Values at the wanted ranks: {(group, column, rank): rows in the column}."""
    columns = sorted({c for _, c, _ in wanted})
    work = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    found, open_ranks = {}, {}
    for (group, column, k), n in wanted.items():
        if not 0 <= k < n:
            raise ValueError(f"rank {k} outside 0..{n - 1}")
        open_ranks[(group, columns.index(column), k)] = (-math.inf, math.inf, n)
    while open_ranks:
        gather = all(bound <= in_memory_rows for _, _, bound in open_ranks.values())
        slots, stats = _pass(work, by, open_ranks, gather)
        following = {}
        for (group, ci, k), (lo, hi, _) in open_ranks.items():
            s = stats[(group, slots[(group, ci, lo, hi)])]
            k_mid = k - s["below"] - s["at_lo"]
            if k_mid < 0:
                if k < s["below"]:
                    raise RuntimeError("bracket lost its rank: the input changed between passes")
                found[(group, columns[ci], k)] = lo
            elif k_mid >= s["mid"]:
                if k_mid < s["mid"] + s["at_hi"]:
                    found[(group, columns[ci], k)] = hi
                elif hi == math.inf and k_mid < s["mid"] + s["at_hi"] + s["nan"]:
                    found[(group, columns[ci], k)] = math.nan  # after all numbers, as in the built-in order
                else:
                    raise RuntimeError("bracket lost its rank: the input changed between passes")
            elif gather:
                found[(group, columns[ci], k)] = s["chosen"][slots["ranks"][(group, ci, lo, hi)].index(k)]
            else:
                grid, share = s["inside"], k_mid / s["mid"]
                i = math.floor(_STEPS * (share - 2 / _ACCURACY)) - 1
                j = math.ceil(_STEPS * (share + 2 / _ACCURACY)) + 1
                new_lo = grid[i] if i > 0 else s["min"]
                new_hi = grid[j] if j < _STEPS else s["max"]
                bound = s["mid"] * ((j - i) / _STEPS + 2 / _ACCURACY)
                following[(group, ci, k)] = (new_lo, new_hi, bound)
        open_ranks = following
    return found


def _pass(work, by, open_ranks, gather):
    """Count and sketch every open bracket; one row per group comes back.

    With ``gather`` executors sort what is inside a bracket, at most
    ``in_memory_rows`` values, and hand back the wanted ranks only.
    """
    spark = work.sparkSession
    slots, brackets, ranks = {}, {}, {}
    for (group, ci, k), (lo, hi, _) in open_ranks.items():
        ranks.setdefault((group, ci, lo, hi), []).append(k)
    for (group, ci, _), (lo, hi, _) in open_ranks.items():
        mine = brackets.setdefault(group, [])
        if (group, ci, lo, hi) not in slots:
            at = sum(1 for c, *_ in mine if c == ci)
            slots[(group, ci, lo, hi)] = (ci, at)
            mine.append((ci, at, lo, hi))
    names = sorted(set(slots.values()))
    if by:
        schema = T.StructType(
            _key_schema(work, by).fields
            + [T.StructField(f"_{side}_{c}_{a}", T.DoubleType()) for c, a in names for side in ("lo", "hi")]
            + [T.StructField(f"_k_{c}_{a}", T.ArrayType(T.LongType())) for c, a in names]
        )
        rows = []
        for group, mine in brackets.items():
            limits = {(c, a): (lo, hi) for c, a, lo, hi in mine}
            wanted = {(c, a): ranks[(group, c, lo, hi)] for c, a, lo, hi in mine}
            rows.append((*group, *[x for s in names for x in limits.get(s, (None, None))], *[wanted.get(s) for s in names]))
        table = spark.createDataFrame(rows, schema)
        if len(rows) <= BROADCAST_GROUPS:
            table = F.broadcast(table)
        work = work.join(table, _null_safe(work, table, by)).drop(*[table[b] for b in by])
        limit = {(c, a): (F.col(f"_lo_{c}_{a}"), F.col(f"_hi_{c}_{a}")) for c, a in names}
        asked = {(c, a): F.first(f"_k_{c}_{a}") for c, a in names}
    else:
        limit = {(c, a): (F.lit(lo), F.lit(hi)) for c, a, lo, hi in brackets[()]}
        asked = {(c, a): F.first(F.array(*[F.lit(k).cast("long") for k in ranks[((), c, lo, hi)]])) for c, a, lo, hi in brackets[()]}
    aggs = []
    for c, a in names:
        v, (lo, hi) = F.col(f"_v{c}"), limit[(c, a)]
        inside = F.when((v > lo) & (v < hi), v)
        kept = (
            F.array_sort(F.collect_list(inside))
            if gather
            else F.percentile_approx(inside, [i / _STEPS for i in range(_STEPS + 1)], _ACCURACY)
        )
        aggs.append(
            F.struct(
                F.count_if(v < lo).alias("below"),
                F.count_if(v == lo).alias("at_lo"),
                F.count(inside).alias("mid"),
                F.count_if(v == hi).alias("at_hi"),
                F.count_if(F.isnan(v)).alias("nan"),
                asked[(c, a)].alias("asked"),
                F.min(inside).alias("min"),
                F.max(inside).alias("max"),
                kept.alias("inside"),
            ).alias(f"_s_{c}_{a}")
        )
    out = work.groupBy(*by).agg(*aggs)
    if gather:
        for c, a in names:
            s = F.col(f"_s_{c}_{a}")
            chosen = F.transform(s["asked"], _ranked(s))
            out = out.withColumn(f"_s_{c}_{a}", s.dropFields("inside", "asked").withField("chosen", chosen))
    stats = {}
    slots["ranks"] = ranks
    for row in out.collect():
        group = tuple(row)[: len(by)]
        for c, a in names:
            stats[(group, (c, a))] = row[f"_s_{c}_{a}"]
    return slots, stats


def _ranked(s):
    return lambda k: F.get(s["inside"], (k - s["below"] - s["at_lo"]).cast("int"))
