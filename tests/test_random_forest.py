import numpy as np
import pandas as pd
import pytest
from pyspark import RDD
from pyspark.ml.classification import RandomForestClassifier

from gridloom.operators import models
from gridloom.operators import random_forest as r

NAMES = ["a", "b b", "c.c", "d"]


def table_of(spark, n=900):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    z = x[:, 0] + np.abs(x[:, 1]) + x[:, 3] + rng.normal(0, 0.3, n)
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(y=(z > 2).astype(int), z=z, id=range(n)))


def block_of(n=700, k=5, bins=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, bins, (k, n)).astype(np.uint8)
    z = x[0] + x[1] * (x[2] > 3) + rng.normal(0, 2, n)
    return x, z, rng.integers(0, 2**63, n).astype(np.uint64)


def part(how, y, c):
    if how.classes:
        w = [how.weights[i] * c[y == i].sum() for i in (0, 1)]
        return (w[0] ** 2 + w[1] ** 2) / sum(w)
    return (c * y).sum() ** 2 / c.sum()


@pytest.mark.parametrize("how", [
    r.Forest(3, 4, 5, "sqrt", 8, weights=(0.7, 2.0)), r.Forest(2, 30, 1, "all", 8), r.Forest(3, 4, 4, "all", 8, classes=False), r.Forest(2, 5, 2, "onethird", 8, classes=False),
], ids=lambda h: f"{h.columns}-{h.classes}-{h.depth}")
def test_trees_equal_a_brute_force_grower(how):
    """Each node has the best cut among its columns, and is a leaf only if there is none or it may not be cut."""
    x, z, u = block_of()
    y = (z > 6).astype(float) if how.classes else z
    rows = r.Rows([{"bins": x.tobytes(), "y": y.tobytes(), "u": u.tobytes()}], 5, how, 0.0)
    for number in range(how.trees):
        t = r.grow(rows, number, 0.5).tree()
        drawn, counts, _ = rows.start(number)
        level, depth = [(0, drawn, counts)], 0
        while level:
            due = [v for v in level if depth < how.depth and v[2].sum() >= 2 * how.least_rows and (not how.classes or 0 < y[v[1]].mean() < 1)]
            for node, _, _ in [v for v in level if v[0] not in {d[0] for d in due}]:
                assert t["column"][node] < 0
            below = []
            for (node, i, c), subset in zip(due, how.subset(5, number, depth, len(due))):
                cuts = {}
                for k in subset:
                    for cut in range(8):
                        low = x[k, i] <= cut
                        if min(c[low].sum(), c[~low].sum()) >= max(how.least_rows, 1):
                            cuts[k, cut] = part(how, y[i][low], c[low]) + part(how, y[i][~low], c[~low]) - part(how, y[i], c)
                best = max(cuts.values(), default=0)
                k, cut = int(t["column"][node]), int(t["cut"][node])
                if k < 0:
                    assert best < 1e-9
                    continue
                assert cuts[k, cut] == pytest.approx(best) and t["gain"][node] == pytest.approx(best)
                low, left = x[k, i] <= cut, t["left"][node]
                below += [(left, i[low], c[low]), (left + 1, i[~low], c[~low])]
            for node, i, c in level:
                w = c * np.where(y[i] == 1, how.weights[1], how.weights[0]) if how.classes else c
                assert t["value"][node] == pytest.approx((w * y[i]).sum() / w.sum())
            level, depth = below, depth + 1
        assert counts.mean() == pytest.approx(1 / (1 - np.exp(-1)), abs=0.1)


@pytest.mark.parametrize("classes", [True, False])
def test_rows_found_and_summed_up_either_way(monkeypatch, classes):
    """Few nodes are found by whole columns and summed up one by one, many by rows: both give the same."""
    x, z, u = block_of(3000)
    how = r.Forest(1, 9, 2, "sqrt", 8, classes)
    rows = r.Rows([{"bins": x.tobytes(), "y": ((z > 6).astype(float) if classes else z).tobytes(), "u": u.tobytes()}], 5, how, 0.0)
    tree, state = r.grow(rows, 0, 0.5), rows.start(0)
    for depth in range(len(tree.levels)):
        if depth:
            state = rows.descend(state, tree.levels[depth - 1])
        m = len(tree.levels[depth].column)
        subset, sums = how.subset(5, 0, depth, m), []
        for whole in (0, 3, 64):
            monkeypatch.setattr(r, "WHOLE", whole)
            assert all((a == b).all() for a, b in zip(rows.at_level(0, tree.levels[:depth]), state))
        for many in (0, 1 << 40):
            monkeypatch.setattr(r, "MANY", many)
            sums.append(rows.sums(state, subset))
        assert np.allclose(*sums) and sums[0].sum() != 0
    assert len(tree.levels) > 5


@pytest.mark.parametrize("classes", [True, False])
def test_spread_rows_give_the_same_trees(spark, monkeypatch, classes):
    df, label = table_of(spark), "y" if classes else "z"
    how = r.Forest(5, 6, 3, "sqrt" if classes else "all", 16, classes, (1.0, 2.0) if classes else (1.0, 1.0))
    alone = r.fit(df, NAMES, label, how)
    monkeypatch.setattr(r, "ALONE", 0)
    monkeypatch.setattr(r, "NODES", 3)
    monkeypatch.setattr(r, "HELD", 400)
    monkeypatch.setattr(r, "MOVED", 30_000)
    spread = r.fit(df.repartition(3), NAMES, label, how)
    assert alone.cuts == spread.cuts and len(alone.trees) == 5
    for s, t in zip(alone.trees, spread.trees):
        assert all((s[p] == t[p]).all() for p in ("column", "cut", "left")) and np.allclose(s["value"], t["value"])


def test_model_learns_scores_and_is_stored(spark, folder):
    df = table_of(spark)
    preset = models.Preset(RandomForestClassifier(numTrees=30, maxDepth=8, seed=1, labelCol="label", featuresCol="features"), "balanced")
    trained = models.train(df, NAMES, "y", preset, "rf")
    assert isinstance(trained.model, r.ForestModel) and trained.model.how.slots(4) == 2 and len(trained.model.trees) == 30
    got = trained.predict(df).toPandas().sort_values("id")
    assert (got["prediction"] == got["y"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert trained.model.importances.argmin() == 2 and trained.model.importances.sum() == pytest.approx(1)
    assert models.feature_importance(trained, spark).count() == 4
    models.save_model(trained, f"{folder}/m")
    again = models.load_model(spark, f"{folder}/m")[0].predict(df).toPandas().sort_values("id")
    assert (again["score"].to_numpy() == got["score"].to_numpy()).all()


def test_numbers_few_values_and_no_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else 1.0, 100.0 + 2 * (i % 7)) for i in range(300)] + [(-1, 1.0, 1.0, None)], "id int, a double, b double, y double")
    how = r.Forest(20, 5, 1, "all", 32, classes=False)
    model = r.fit(df, ["a", "b"], "y", how)
    assert model.cuts[0] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    got = model.transform(df.filter("y is not null")).toPandas()
    assert np.abs(got["prediction"] - got["y"]).max() < 0.01
    assert r.fit(df.limit(0), ["a"], "y", how).transform(df).filter("prediction = 0").count() == 301
    one = r.fit(df.selectExpr("id", "a", "1 as y"), ["a"], "y", r.Forest(3))
    assert one.transform(df).filter("score = 1").count() == 301


@pytest.mark.parametrize("classes", [True, False])
def test_all_columns_are_counted_by_codes(monkeypatch, classes):
    """Where nodes have all columns, several of them share a code; with few rows to a node, columns are counted one by one."""
    x, z, u = block_of(4000)
    x = np.concatenate([x, np.zeros((1, 4000), np.uint8), x[:1] % 2])
    how = r.Forest(1, 6, 2, "all", 8, classes)
    y = (z > 6).astype(float) if classes else z
    rows = r.Rows([{"bins": x.tobytes(), "y": y.tobytes(), "u": u.tobytes()}], 7, how, 0.0)
    assert len(rows.packed) < 5 and all(bits <= r.SHARED for _, bits in rows.codes.groups)
    tree = r.grow(rows, 0, 0.5)
    for depth in (0, 3):
        for piece in (100, 1 << 15):
            monkeypatch.setattr(r, "PIECE", piece)
            monkeypatch.setattr(r, "WHOLE", 2)
            state = some, counts, node = rows.at_level(0, tree.levels[:depth])
        m = len(tree.levels[depth].column)
        want = np.zeros((m, 7, 8, 2))
        for c in range(7):
            at = (node, c, x[c, some])
            np.add.at(want, (*at, y[some].astype(int) if classes else 0), counts)
            if not classes:
                np.add.at(want, (*at, 1), counts * y[some])
        for shared in (10, 30):
            monkeypatch.setattr(r, "SHARED", shared)
            assert np.allclose(rows.sums(state, how.subset(7, 0, depth, m)), want)


def test_a_share_of_rows_is_kept_by_several_tasks(spark, monkeypatch):
    """Histograms move once per share of the rows, not once per task: trees are divided among the tasks of a share."""
    monkeypatch.setattr(r, "ALONE", 0)
    df, parts, real = table_of(spark).repartition(4), [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *level: parts.append(self.getNumPartitions()) or real(self, *level))
    model = r.fit(df, NAMES, "z", r.Forest(8, 3, 3, "all", 16, False))
    assert len(model.trees) == 8 and parts == [min(8, spark.sparkContext.defaultParallelism)]
