"""Rows of a spread table: several columns to a code, kept by the executors from round to round."""

import pickle

import numpy as np
import pandas as pd
import pytest

from gridloom.operators import boosting as b

SIZES = [1, 2, 64, 5, 64, 17, 3, 64, 2]


def some_blocks(n=6000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, s, n) for s in SIZES]).astype(np.uint8)
    parts = {"y": rng.integers(0, 2, n).astype(float), "w": rng.random(n) + 0.5, "u": rng.integers(-2**62, 2**62, n), "raw": rng.normal(size=n)}
    cut = n // 3
    return x, parts, [{"bins": x[:, s].tobytes(), **{c: v[s].tobytes() for c, v in parts.items()}} for s in (slice(0, cut), slice(cut, n))]


@pytest.mark.parametrize("how", [b.Boosting(1, rows=0.6), b.Boosting(1), b.Boosting(1, loss="squared")], ids=["some", "all", "squared"])
def test_codes_give_the_histograms_of_their_columns(how):
    x, parts, blocks = some_blocks()
    if how.loss == "squared":
        parts["w"][:] = 1.0
        blocks = [{**block, "w": np.ones(len(block["w"]) // 8).tobytes()} for block in blocks]
    codes = b.Codes(SIZES)
    assert len(codes.groups) < 5 and all(bits <= b.WIDTH for _, bits in codes.groups)
    rows = pickle.loads(pickle.dumps(b.Packed(blocks, codes, how)))
    assert (codes.unpack(rows.x) == x).all()
    tree = b.Tree.root()
    left, right = tree.split(0, 2, 30, 1.0)
    tree.split(left, 6, 0, 1.0)
    tree.split(right, 0, 0, 1.0)  # a column with one bin: all rows go left
    leaf = tree.leaf_of(x)
    assert (rows.leaf_of(tree) == leaf).all()
    plain = b.Rows.__new__(b.Rows)
    plain.x, plain.y, plain.w, plain.u, plain.raw = x, *(parts[c] for c in ("y", "w", "u", "raw"))
    plain.begin(how, 4)
    rows.begin(how, 4)
    for t, nodes in ((b.Tree.root(), [0]), (tree, [5]), (tree, [4, 3, 5])):
        at = t.leaf_of(x)[plain.kept]
        want = plain.histograms([plain.kept[at == n] for n in nodes], 64)
        assert np.allclose(rows.sums(t, nodes, 64), want)
    many = b.Tree(*(part * 60 for part in ([-1], [0], [0], [0], [0.5], [0.0])))
    many.column, many.value = [-1] * 300, [0.25] * 300
    assert (rows.leaf_of(many) == 0).all()


def test_rows_are_written_once(spark, monkeypatch):
    """A spread table is read and written before the first round only, whatever the number of rounds."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(600, 2)), columns=["a", "b"]).assign(y=lambda d: (d["a"] > 0).astype(int), id=range(600)))
    written, real = [], b.materialize

    def materialize(table, label):
        written.append(label)
        return real(table, label)

    monkeypatch.setattr(b, "materialize", materialize)
    monkeypatch.setattr(b, "ALONE", 0)
    monkeypatch.setattr(b, "STORED", 1)
    trees = b.fit(df, ["a", "b"], "y", b.Boosting(4, 0.3, 2)).trees
    assert written == ["boosting-blocks"] and len(trees) == 4
