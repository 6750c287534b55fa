import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import anomaly, density, encode, forest
from gridloom.operators.density import noise_points


def _brute_noise(x: np.ndarray, eps: float, least: int) -> set[int]:
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    return set(np.flatnonzero(~core & ~near[:, core].any(axis=1)))


@pytest.mark.parametrize("leaf", [256, 2])
@pytest.mark.parametrize("d", [2, 5])
def test_noise_equals_brute_force(spark, monkeypatch, d, leaf):
    """A third of the rows in one spot, copies among them, and a thin cloud around."""
    monkeypatch.setattr(density, "LEAF_POINTS", leaf)
    rng = np.random.default_rng(d)
    hot = rng.normal(0, 0.03, (300, d))
    hot[:100] = hot[0]
    x = np.vstack([hot, rng.normal(0, 0.9, (500, d)), rng.uniform(-4, 4, (200, d))])
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    eps = 0.3 if d == 2 else 0.8
    got = {r["id"] for r in noise_points(df, "id", cols, eps, 10).collect()}
    want = _brute_noise(x, eps, 10)
    assert got == want and 0 < len(want) < len(x)


def _brute_clusters(x: np.ndarray, eps: float, least: int) -> list[int]:
    near = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1])) <= eps * eps
    core = near.sum(axis=1) >= least
    out, cluster = np.full(len(x), -1), 0
    for start in range(len(x)):
        if not core[start] or out[start] >= 0:
            continue
        todo = [start]
        out[start] = cluster
        while todo:
            for k in np.flatnonzero(near[todo.pop()] & (out < 0)):
                out[k] = cluster
                if core[k]:
                    todo.append(k)
        cluster += 1
    return out.tolist()


@pytest.mark.parametrize("leaf, d", [(256, 2), (2, 2), (2, 5)])
def test_clusters_equal_brute_force(spark, monkeypatch, leaf, d):
    """Blobs that touch or nearly do, copies, a ring at the radius, a thin cloud; small leaves force splits."""
    monkeypatch.setattr(density, "LEAF_POINTS", leaf)
    rng = np.random.default_rng(d)
    blobs = [rng.normal(0, 0.08, (60, d)) + np.eye(d)[0] * c for c in (0, 0.6, 1.3, 3.0)]
    copies = np.repeat(rng.normal(-2, 0.01, (2, d)), 20, axis=0)
    edge = np.zeros((40, d))
    edge[:, 1] = 5 + np.repeat([0, 0.3], 20) + rng.normal(0, 1e-4, 40)
    x = rng.permutation(np.vstack([*blobs, copies, edge, rng.uniform(-4, 4, (120, d))]))
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    eps = 0.3 if d == 2 else 0.5
    got = {r["id"]: r["cluster"] for r in density.clusters(df, "id", cols, eps, 8).collect()}
    want = _brute_clusters(x, eps, 8)
    assert [got[i] for i in range(len(x))] == want
    assert max(want) >= 2 and -1 in want


def test_clusters_of_nothing_and_of_noise(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 9.0)], "id long, x double")
    assert {tuple(r) for r in density.clusters(df, "id", ["x"], 0.5, 2).collect()} == {(1, -1), (2, -1)}
    assert density.clusters(df.limit(0), "id", ["x"], 0.5, 2).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    from gridloom.operators.graph import components

    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)] + [(int(a), int(b)) for a, b in rng.integers(400, 460, (40, 2))]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: root(a) for a in parent}


def test_isolation_forest_finds_the_far_rows(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (970, 3)), rng.normal(9, 1, (30, 3))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(1000)))
    out = forest.isolation_flags(df, "id", ["a", "b", "c"], 0.05, trees=60).toPandas().sort_values("id")
    assert out["if_anomaly"].sum() == 50 and out["if_anomaly"].iloc[970:].sum() == 30
    assert (out["if_score"] < 0).all() and (out["if_score"] >= -1).all()
    again = forest.isolation_flags(df.repartition(5), "id", ["a", "b", "c"], 0.05, trees=60).toPandas().sort_values("id")
    assert np.allclose(out["if_score"], again["if_score"])


def test_each_tree_draws_its_rows_once(spark):
    """Trees draw independently, so two may share a row; no tree has a row twice."""
    df = spark.range(4000).select("id", F.col("id").cast("double").alias("a"))
    rows = forest._tree_rows(df, "id", ["a"], trees=10, rows=64, seed=1)
    assert rows.count() == 640 and rows.select("tree", "id").distinct().count() == 640
    assert {r["count"] for r in rows.groupBy("tree").count().collect()} == {64}


def test_reconstruction_error(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 6)) @ rng.normal(0, 1, (6, 6))
    cols = list("abcdef")
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(400)))
    got = anomaly.reconstruction_flags(df, cols, 3).toPandas().sort_values("id")
    centred = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    error = ((centred - centred @ v[:3].T @ v[:3]) ** 2).mean(axis=1)
    assert np.allclose(got["ae_score"], error)
    assert (got["ae_anomaly"].to_numpy() == (error > np.quantile(error, 0.95))).all()
    shares = encode.fit_pca(df, cols, 2).explained
    s = np.linalg.svd(centred, compute_uv=False) ** 2
    assert np.allclose(shares, s[:2] / s.sum())


def test_boundary_score_is_the_mean_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1000, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(1000)))
    out = anomaly.boundary_flags(df, "id", list("abcd"), 0.05, waves=2048).toPandas().sort_values("id")
    exact = np.exp(-((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) / 4).mean(axis=1)
    assert out["ocsvm_anomaly"].sum() == 50
    assert np.abs(out["ocsvm_score"] - exact).max() < 0.05 and np.corrcoef(out["ocsvm_score"], exact)[0, 1] > 0.99


def test_literal_vote_keeps_the_sign(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, -0.8, 3.0), (2, 0, 0, 0, -0.4, 0.0)], "id int, if_anomaly int, ae_anomaly int, dbscan_anomaly int, if_score double, ae_score double")
    plain = {r["id"]: r["anomaly_risk_score"] for r in anomaly.vote(df).collect()}
    literal = {r["id"]: r["anomaly_risk_score"] for r in anomaly.vote(df, literal=True).collect()}
    assert plain == {1: 86.67, 2: 0.0} and literal == {1: 56.67, 2: 30.0}


def test_cells_on_the_edge_meet_few_points(spark, monkeypatch):
    """Boxes with more pairs of points than PAIR_POINTS are split, with the clusters of the plain definition."""
    rng = np.random.default_rng(11)
    lines = rng.integers(0, 6, 600) * 0.52
    pts = np.column_stack([rng.uniform(0, 3, 600), lines + rng.uniform(-0.02, 0.02, 600)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    want = _brute_clusters(pts, 0.5, 5)
    monkeypatch.setattr(density, "PAIR_POINTS", 4)
    got = density.clusters(df, "id", ["x", "y"], 0.5, 5).toPandas().sort_values("id")["cluster"]
    assert got.tolist() == want
