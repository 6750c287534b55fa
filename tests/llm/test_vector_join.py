import math

import numpy as np
import pytest

from gridloom.llm import vector_join
from gridloom.llm.queries import QUERIES

T = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.9):
    dims = max((len(v) for _, v in rows if v is not None), default=1)
    good = [v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v) for _, v in rows]
    x = np.zeros((len(rows), dims))
    for i, (_, v) in enumerate(rows):
        if good[i]:
            x[i, : len(v)] = np.asarray(v, dtype=np.float32).astype(float)
            x[i] /= np.linalg.norm(x[i])
    near = x @ x.T >= cosine
    near[~np.array(good)] = False
    near[:, ~np.array(good)] = False
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, int(near[i].sum()), c, d is not None and d == c))
    return sorted(out, key=str)


def ours(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def vectors():
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rnd.normal(size=16) * (0.2 + 0.02 * (i % 20))).tolist()) for i in range(400)]
    path = base[0].copy()
    for i in range(60):  # a chain whose ends are unlike
        path = path + rnd.normal(size=16) * 0.3
        rows.append((500 + i, path.tolist()))
    rows += [(600 + i, rows[3][1]) for i in range(80)] + [(700, [2 * x for x in rows[3][1]]), (3, rows[3][1]), (None, rows[3][1])]
    rows += [(800, None), (801, [0.0] * 16), (802, [None] * 16), (803, [float("nan")] * 16), (804, [float("inf")] * 16), (None, None), (805, []), (806, [1.0]), (807, [2.0, 0.0])]
    return rows + [(808, [1e-30, -0.0] + [0.0] * 14), (809, [1e-30, 0.0])]


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vector_join, "PER_PIVOT", 20)
        monkeypatch.setattr(vector_join, "BLOCK", 16)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], T + ", rows int, id string").repartition(3)
    assert ours(vector_join.range_join(df)) == brute(rows)


def test_empty(spark):
    assert vector_join.range_join(spark.createDataFrame([], T)).count() == 0
    assert ours(vector_join.range_join(spark.createDataFrame([(1, None), (2, [0.0])], T))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_borders_miss_no_neighbour():
    rnd = np.random.default_rng(2)
    u = vector_join.unit(rnd.normal(size=(500, 3)))
    radius = math.sqrt(0.2)
    pivots = vector_join.choose_pivots(u, 12, radius)
    home, row, cell = vector_join.borders(u, pivots, radius)
    held = {(r, c) for r, c in zip(row, cell)} | {(i, h) for i, h in enumerate(home)}
    near = u @ u.T >= 0.9
    assert all((j, home[i]) in held for i in range(500) for j in np.flatnonzero(near[i]))
    assert len(row) < 500 * len(pivots) / 2


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert ours(QUERIES["op10_embedding_near_dedup"](spark, sf)) == brute(rows)


def test_vectors_are_stored_once(spark, monkeypatch):
    """However many cells a vector may reach, it is written once, and blocks meet without a shuffle of vectors."""
    held, real = {}, vector_join.stored
    monkeypatch.setattr(vector_join, "PER_PIVOT", 20)
    monkeypatch.setattr(vector_join, "BLOCK", 16)
    monkeypatch.setattr(vector_join, "stored", lambda df, label: held.setdefault(label, real(df, label)))
    rows = [(i, v) for i, v in vectors() if v]
    vector_join.range_join(spark.createDataFrame(rows, T)).count()
    wide = [t for t in held.values() if "v" in t.columns or "u" in t.columns]
    stored = sum(len(r["ids"]) for r in held["vectors-blocks"].select("ids").collect())
    assert len(wide) == 1 and stored <= len(rows)
    assert max(len(r["reach"]) for r in held["vectors-blocks"].select("reach").collect()) > 1
    assert "Exchange hashpartitioning" not in vector_join._pairs(held["vectors-blocks"])._jdf.queryExecution().toString()
