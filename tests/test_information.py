"""Mutual information by neighbours against a brute-force estimator."""

import math
from functools import cache

import numpy as np
import pytest

from gridloom.operators import encode


@cache
def _psi(n):
    return -0.57721566490153286 + sum(1.0 / i for i in range(1, n))


def _brute(x, y, k):
    rows = [(v, c) for v, c in zip(x, y) if v is not None and math.isfinite(v) and c is not None]
    sizes = {c: sum(1 for _, d in rows if d == c) for _, c in rows}
    rows = [(v, c) for v, c in rows if sizes[c] > 1]
    values = np.array([v for v, _ in rows])
    of = {c: np.array([v for v, d in rows if d == c]) for c in sizes}
    total = 0.0
    for v, c in rows:
        own, apart = np.abs(of[c] - v), np.abs(values - v)
        radius = np.sort(own)[min(k, sizes[c] - 1)]
        counts = [int((a < radius).sum() if radius > 0 else (a == 0).sum()) for a in (own, apart)]
        total += _psi(counts[0]) - _psi(sizes[c]) - _psi(counts[1])
    return max(0.0, _psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("k, block_rows", [(3, None), (3, 70), (5, 33), (1, 70)])
def test_equals_brute_force(spark, k, block_rows):
    rng = np.random.default_rng(5)
    y = ["a" if u < 0.8 else "b" if u < 0.97 else "c" for u in rng.random(1000)] + ["alone", None, "two", "two"]
    free = (np.round(rng.normal(0, 40, 1004)) / 8).tolist()
    tied = [float(int(8 * u) + (5 if c == "b" else 0)) for u, c in zip(rng.random(1004), y)]
    odd = [None if i % 7 == 0 else math.nan if i % 11 == 0 else math.inf if i % 13 == 0 else -0.0 if i % 5 == 0 else v for i, v in enumerate(free)]
    df = spark.createDataFrame(list(zip(free, tied, odd, y)), "free double, tied double, odd double, y string")
    ours = {r["feature"]: r["score"] for r in encode.neighbour_information(df, ["free", "tied", "odd"], "y", k, block_rows).collect()}
    want = {"free": _brute(free, y, k), "tied": _brute(tied, y, k), "odd": _brute(odd, y, k)}
    assert ours.keys() == want.keys()
    for name in want:
        assert ours[name] == pytest.approx(want[name], abs=1e-8), name
    assert ours["tied"] > ours["free"] + 0.05


def test_nothing_left(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "a")], "x double, y string")
    assert encode.neighbour_information(df, ["x"], "y").count() == 0
    assert encode.neighbour_information(df.limit(0), ["x"], "y").count() == 0


def test_select_by_information(spark):
    rows = [(float(i % 50), float((i * 37) % 101), i / 7.0, (i % 50) // 25) for i in range(400)]
    df = spark.createDataFrame(rows, "near double, far double, wide double, y int")
    best = encode.select_k_best(df, ["near", "far"], "y", 1, task="information").collect()
    assert [r["feature"] for r in best] == ["near"] and best[0]["rank"] == 1
    assert encode.select_k_best(df, ["near", "far"], "wide", 2, task="information").count() == 2
