import math
import random

import numpy as np

from gridloom.llm import topk
from gridloom.llm.queries import QUERIES

T = "vec_id long, embedding array<float>"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(queries, rows, k):
    q = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    rows = [(i, q(v)) for i, v in rows if good(v) and i is not None]
    out = []
    for i, a in {(i, tuple(q(v))) for i, v in queries if good(v) and i is not None}:
        best = sorted((-dot(a, b), j) for j, b in rows if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def vectors(n=300, dims=9):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(5, rows[5][1]), (50, rows[7][1])]
    rows += [(2000, None), (2001, [None] * dims), (2002, [float("nan")] * dims), (2003, [float("inf")] + [0.0] * (dims - 1)), (None, rows[1][1])]
    return rows + [(2050, [0.0] * dims), (2100, [-0.0] * dims), (2150, [1000.0] * dims), (2200, rows[0][1][:4]), (2250, [])]


def ours(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 70)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], T + ", score int").repartition(3)
    queries = df.filter("vec_id % 50 = 0")
    assert ours(topk.search(queries, df, 5)) == brute([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows, 5)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -2.0])], T)
    assert ours(topk.search(df, df, 5)) == [(0, 1, 1, 256 * 256 * -3), (1, 1, 0, 256 * 256 * -3)]
    none = df.limit(0)
    assert ours(topk.search(none, df)) == [] and ours(topk.search(df, none)) == [] and ours(topk.search(none, none)) == []


def test_sums_and_selection():
    rnd = np.random.default_rng(1)
    q = rnd.integers(-300, 300, (130, 7))
    low, bits, slices = topk.slice_block(q)
    asked = rnd.integers(-300, 300, (5, 7))
    total, less = topk.sums(low, bits, slices, asked)
    rows = np.unpackbits(total.view(np.uint8), axis=-1, bitorder="little").reshape(len(total), 5, -1)[:, :, :130].astype(np.int64)
    score = (rows * (1 << np.arange(len(total)))[:, None, None]).sum(axis=0) - less[:, None]
    assert (score == asked @ q.T).all()


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert ours(QUERIES["op8_exact_top_k"](spark, sf)) == brute([r for r in rows if r[0] % 50 == 0], rows, 5)


def test_large_components_and_long_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 10)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) * 10 ** rnd.choice([0, 3, 6, 12, 38]) for _ in range(6)]) for i in range(60)] + [(100, [524288.0] * 6), (150, [3e38] * 6), (150, [1.0] * 9)]
    df = spark.createDataFrame(rows, T).repartition(3)
    asked = [r for r in rows if r[0] % 5 == 0] + [(200, [1.0] * 12)]
    want = brute(asked, rows, 5)
    got = topk.search(spark.createDataFrame(asked, T), df, 5, exact=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, int(r.exact)) for r in got) == want
    assert all(r.score == (int(r.exact) if -(1 << 63) <= int(r.exact) < 1 << 63 else None) for r in got)
    assert {200} <= {w[0] for w in want} and any(w[3] > 1 << 64 for w in want)


def test_sums_at_the_bound_fit():
    for dims in (1, 256, 4096):
        b = topk.bound(dims)
        q = np.array([[b] * dims, [-b] * dims, [0] * dims], dtype=np.int64)
        total, less = topk.sums(*topk.slice_block(q), q)
        rows = np.unpackbits(total.view(np.uint8), axis=-1, bitorder="little").reshape(len(total), 3, -1)[:, :, :3].astype(np.int64)
        score = (rows * (np.int64(1) << np.arange(len(total), dtype=np.int64))[:, None, None]).sum(axis=0) - less[:, None]
        assert (score.astype(object) == q.astype(object) @ q.astype(object).T).all()
