import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gridloom.operators import boosting as b

K, BINS = 4, 8


def some_rows(n=500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, BINS, (n, K)).astype(np.uint8)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 3) + rng.normal(0, 2, n) > 6).astype(float)
    table = pa.table({"bins": pa.array([r.tobytes() for r in x], pa.binary()), "y": y, "w": np.where(y == 1, 2.0, 1.0), "u": rng.integers(-2**62, 2**62, n), "raw": np.zeros(n)})
    return b.Rows(table, K)


def gain_of(how, g, h, c, low):
    """Gain of cutting a node's rows in two, None if it may not be cut."""
    size = c if how.grow == "variance" else h
    ridge = 0 if how.grow == "variance" else how.ridge
    parts = [(g[m].sum(), size[m].sum(), c[m].sum(), h[m].sum()) for m in (low, ~low)]
    if any(p[2] < max(how.least_rows, 1) or p[3] < how.least_weight for p in parts):
        return None
    return sum(p[0] ** 2 / (p[1] + ridge) for p in parts) - g.sum() ** 2 / (size.sum() + ridge)


def best_of(how, x, g, h, c):
    found = [(gain_of(how, g, h, c, x[:, k] <= t), -k, -t) for k in range(K) for t in range(BINS)]
    found = [f for f in found if f[0] is not None]
    return max(found, default=(-math.inf, 0, 0))


def brute(rows, how):
    """Leaf value of each row of one tree."""
    x, g, h, c = rows.x.T, rows.g, rows.h, np.ones(len(rows.y))
    parts = [(np.arange(len(x)), 0)]
    done = []
    if how.grow == "leaf":
        while len(parts) < how.leaves:
            cuts = [(best_of(how, x[i], g[i], h[i], c[i]) if d < how.depth else (-math.inf, 0, 0)) for i, d in parts]
            k = max(range(len(parts)), key=lambda j: cuts[j][0])
            if cuts[k][0] <= 1e-9:
                break
            (i, d), (_, f, t) = parts.pop(k), cuts[k]
            low = x[i, -f] <= -t
            parts += [(i[low], d + 1), (i[~low], d + 1)]
    else:
        for _ in range(how.depth):
            if how.grow == "symmetric":
                gain = lambda k, t: [gain_of(how, g[i], h[i], c[i], x[i, k] <= t) for i, _ in parts]  # noqa: E731, B023
                total, k, t = max((sum(v or 0 for v in gain(k, t)), -k, -t) for k in range(K) for t in range(BINS))
                cuts = [(v, k, t) if v is not None else (-math.inf, 0, 0) for v in gain(-k, -t)]
                split = [total > 1e-9 and v[0] > -math.inf for v in cuts]
            else:
                cuts = [best_of(how, x[i], g[i], h[i], c[i]) for i, _ in parts]
                split = [v[0] > 1e-9 for v in cuts]
            new = []
            for (i, d), (_, f, t), s in zip(parts, cuts, split):
                if not s:
                    done.append((i, d))
                    continue
                low = x[i, -f] <= -t
                new += [(i[low], d + 1), (i[~low], d + 1)]
            parts = new
            if not parts:
                break
    out = np.zeros(len(x))
    for i, _ in parts + done:
        out[i] = -how.rate * g[i].sum() / (h[i].sum() + (0 if how.grow == "variance" else how.ridge))
    return out


@pytest.mark.parametrize("how", [
    b.Boosting(6, 0.3, 4, "variance", bins=BINS), b.Boosting(6, 0.3, 4, "level", bins=BINS, least_weight=3.0),
    b.Boosting(6, 0.3, 5, "leaf", leaves=7, bins=BINS, least_rows=15, ridge=0.0), b.Boosting(6, 0.3, 4, "symmetric", bins=BINS, ridge=3.0),
    b.Boosting(4, 0.3, 3, "level", bins=BINS, loss="squared")], ids=lambda h: f"{h.grow}-{h.loss}")
def test_trees_equal_a_brute_force_grower(how):
    rows, again = some_rows(), some_rows()
    for number, tree in enumerate(b.train_rows(rows, how)):
        again.begin(how, number)
        want = brute(again, how)
        got = np.zeros(len(want))
        tree.add(again.x, got)
        assert np.allclose(got, want), number
        again.raw += want
    assert np.allclose(rows.raw, again.raw)


def table_of(spark, n=900):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + np.abs(x[:, 1]) + rng.normal(0, 0.3, n) > 1).astype(int)
    return spark.createDataFrame(pd.DataFrame(x, columns=["a", "b b", "c.c"]).assign(y=y, w=1.0 + y, id=range(n)))


@pytest.mark.parametrize("grow", ["level", "leaf"])
def test_spread_rows_give_the_same_trees(spark, monkeypatch, grow):
    df = table_of(spark)
    how = b.Boosting(5, 0.3, 3, grow, leaves=6, rows=0.7, columns=0.7, bins=16)
    alone = b.fit(df, ["a", "b b", "c.c"], "y", how, "w")
    monkeypatch.setattr(b, "ALONE", 0)
    monkeypatch.setattr(b, "STORED", 2)
    spread = b.fit(df.repartition(3), ["a", "b b", "c.c"], "y", how, "w")
    assert alone.cuts == spread.cuts
    for s, t in zip(alone.trees, spread.trees):
        assert (s.column, s.cut, s.left) == (t.column, t.cut, t.left) and np.allclose(s.value, t.value)


@pytest.mark.parametrize("grow", ["variance", "level", "leaf", "symmetric"])
def test_model_learns_scores_and_is_stored(spark, folder, grow):
    df = table_of(spark)
    model = b.fit(df, ["a", "b b", "c.c"], "y", b.Boosting(40, 0.2, 4, grow, leaves=8), "w")
    got = model.transform(df).toPandas().sort_values("id")
    assert (got["prediction"] == got["y"]).mean() > 0.93 and got["score"].between(0, 1).all()
    assert model.importances.argmin() == 2 and model.importances.sum() == pytest.approx(1)
    model.save(spark, f"{folder}/m")
    again = b.BoostedTrees.load(spark, f"{folder}/m").transform(df).toPandas().sort_values("id")
    assert (again["score"].to_numpy() == got["score"].to_numpy()).all()


def test_numbers_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(float(i % 7), None if i % 5 == 0 else 1.0, float(i % 7) * 2) for i in range(200)] + [(1.0, 1.0, None)], "a double, b double, y double")
    model = b.fit(df, ["a", "b"], "y", b.Boosting(60, 0.3, 3, loss="squared", ridge=0.0))
    got = model.transform(df.filter("y is not null")).toPandas()
    assert np.abs(got["prediction"] - got["y"]).max() < 0.01
    none = b.fit(df.limit(0), ["a"], "y", b.Boosting(3))
    assert none.transform(df).filter("score = 0.5").count() == 201
    one = b.fit(df.filter("y is not null").selectExpr("a", "1 as y"), ["a"], "y", b.Boosting(3))
    assert one.transform(df).filter("score > 0.99").count() == 201


@pytest.mark.parametrize("grow", ["variance", "level", "leaf", "symmetric"])
def test_leaves_of_the_last_level_need_no_rows(grow):
    """A tree asks for rows once per level that is cut, not for its leaves; many rows find the same leaves as few."""
    rows, how = some_rows(5000), b.Boosting(1, 0.3, 3, grow, leaves=64, bins=BINS)
    rows.begin(how, 0)
    asked = []

    def sums(tree, nodes):
        leaf = tree.leaf_of(rows.x)
        assert (leaf == np.concatenate([tree.leaf_of(part) for part in np.array_split(rows.x, 5, axis=1)])).all()
        asked.append(len(nodes))
        return list(rows.histograms([np.flatnonzero(leaf == n) for n in nodes], BINS))

    tree = b.grow_tree(sums, how, np.arange(K))
    # By leaf, the two halves of the tree may be opened one after the other.
    assert asked == [1, 1, 2] if grow != "leaf" else asked[:2] == [1, 1] and sum(asked) == 4
    leaf = tree.leaf_of(rows.x)
    for n in np.unique(leaf):
        ridge = 0 if grow == "variance" else how.ridge
        assert tree.value[n] == pytest.approx(-how.rate * rows.g[leaf == n].sum() / (rows.h[leaf == n].sum() + ridge))
