"""Gradient-boosted trees on binned columns, grown in four ways.

Columns are cut into at most 64 bins, one byte a cell. A tree is grown from
histograms of gradients, curvatures and counts per node, column and bin; of two
children one is summed up and the other is the difference. One Spark job sums
up the children of all leaves that are due, so a tree takes a job per level,
whichever way it grows; tasks hand on their histograms only. The rows of a spread table
are kept by the executors, several columns to a code, so that one look-up counts
them together; scores are renewed every few rounds, so no task walks more than a
few trees. A table that is known to be small is handed to one task, which runs
the same rounds on it.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.quantiles import quantiles
from gridloom.session import materialize

#: Cells (rows x columns) up to which one task trains alone; more are spread over tasks. Both give the same trees.
ALONE = 1 << 25
#: Rows up to which bins have exact bounds.
EXACT = 200_000
#: Rounds after which the scores of a spread table are renewed.
STORED = 4
#: Histograms that the driver adds up itself; more are added up by groups of tasks first.
DIRECT = 64
#: Rows that a spread table keeps in one block, column by column.
BLOCK = 1 << 14
#: Bits of the code that several columns of a spread table share; its histograms should stay in a core's cache.
WIDTH = 13
#: Rows of a spread table that are counted at a time, and cells that one task has.
COUNTED, SHARE = 1 << 18, 1 << 29


@dataclass(frozen=True)
class Boosting:
    """How trees are grown.

    ``grow``: "variance" splits level by level by the variance of the gradients
    and fits the leaves by curvature; "level" takes the second-order gain level
    by level; "leaf" splits the leaf of highest gain next, up to ``leaves``;
    "symmetric" splits all nodes of a level alike.
    """

    rounds: int = 200
    rate: float = 0.05
    depth: int = 6
    grow: str = "level"
    leaves: int = 64
    rows: float = 1.0
    columns: float = 1.0
    ridge: float = 1.0
    least_rows: int = 1
    least_weight: float = 0.0
    bins: int = 64
    loss: str = "logistic"
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; a leaf has column -1. Rows with a value up to the cut go left."""

    column: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]

    @staticmethod
    def root() -> Tree:
        return Tree([-1], [0], [0], [0], [0.0], [0.0])

    def split(self, node: int, column: int, cut: int, gain: float) -> tuple[int, int]:
        a = len(self.column)
        self.column[node], self.cut[node], self.left[node], self.right[node], self.gain[node] = column, cut, a, a + 1, gain
        for part, none in ((self.column, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            part.extend([none, none])
        return a, a + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row; ``x`` has a row per column, bins or values with cuts alike."""
        if x.shape[1] > 2048 and x.dtype == np.uint8 and len(self.column) <= 256:
            return self.leaf_of_bins(x.shape[1], lambda c, cut: x[c] <= np.uint8(cut))
        column, cut, left, right = (np.array(p) for p in (self.column, self.cut, self.left, self.right))
        node = np.zeros(x.shape[1], dtype=np.int64)
        active = np.arange(x.shape[1]) if column[0] >= 0 else np.empty(0, dtype=np.int64)
        while len(active):
            at = node[active]
            node[active] = np.where(x[column[at], active] <= cut[at], left[at], right[at])
            active = active[column[node[active]] >= 0]
        return node

    def leaf_of_bins(self, n: int, low_of: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """The same for ``n`` rows of bins: whole columns are compared, node by node; ``low_of`` tells which rows have a bin up to a cut."""
        leaf = np.zeros(n, dtype=np.uint8)
        inside = {0: np.ones(n, dtype=bool)}
        for node, column in enumerate(self.column):  # children come after their parents
            own = inside.pop(node, None)
            if own is None:
                continue
            if column < 0:
                leaf += own.view(np.uint8) * np.uint8(node)
            else:
                low = own & low_of(column, self.cut[node])
                inside[self.left[node]], inside[self.right[node]] = low, own ^ low
        return leaf

    def add(self, x: np.ndarray, raw: np.ndarray) -> None:
        raw += np.array(self.value)[self.leaf_of(x)]


# -------------------------------------------------------------------- rows


class Rows:
    """Binned rows in memory: ``x`` has a row per column."""

    def __init__(self, table: pa.Table, columns: int):
        self.x = np.frombuffer(b"".join(table.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, columns).T.copy()
        self.y, self.w, self.u, self.raw = (table.column(c).to_numpy().copy() for c in ("y", "w", "u", "raw"))

    def begin(self, how: Boosting, number: int) -> None:
        """Gradients of a round; rows that the round leaves out weigh nothing."""
        if how.loss == "logistic":
            p = 1 / (1 + np.exp(-self.raw))
            self.g, self.h = self.w * (p - self.y), self.w * p * (1 - p)
        else:
            self.g, self.h = self.w * (self.raw - self.y), self.w
        self.kept = np.arange(len(self.y))
        if how.rows < 1:
            seed = np.uint64((number + 1) * 0x9E3779B97F4A7C15 + how.seed & (1 << 64) - 1)
            z = (self.u.view(np.uint64) ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            self.kept = np.flatnonzero((z >> np.uint64(11)).astype(np.float64) < how.rows * 2.0**53)

    def histogram(self, rows: np.ndarray, bins: int) -> np.ndarray:
        """(column, bin, [gradient, curvature, rows]) of some rows."""
        k = len(self.x)
        if len(rows) > 4096:
            return self.histograms([rows], bins)[0]
        at = (self.x[:, rows] + (np.arange(k, dtype=np.int64) * bins)[:, None]).ravel()
        sums = [np.bincount(at, weights=np.broadcast_to(v[rows], (k, len(rows))).ravel(), minlength=k * bins) for v in (self.g, self.h)]
        return np.stack([*sums, np.bincount(at, minlength=k * bins)], axis=1).reshape(k, bins, 3)


    def histograms(self, some: list[np.ndarray], bins: int) -> np.ndarray:
        """The histogram of each of several nodes, given by their rows, column by column; with enough rows two columns at a time."""
        k, m, n = len(self.x), len(some), self.x.shape[1]
        rows, node = np.concatenate(some), np.repeat(np.arange(m), [len(r) for r in some])
        values = [self.g[rows], self.h[rows], None]
        bin_of = lambda c: (self.x[c] if len(rows) == n and m == 1 else self.x[c].take(rows)).astype(np.int64)
        out = np.zeros((m, k, bins, 3))
        twos = k - k % 2 if len(rows) >= m * bins * bins else 0
        for c in range(0, twos, 2):
            at = (node * bins + bin_of(c)) * bins + bin_of(c + 1)
            for j, v in enumerate(values):
                both = np.bincount(at, v, m * bins * bins).reshape(m, bins, bins)
                out[:, c, :, j], out[:, c + 1, :, j] = both.sum(axis=2), both.sum(axis=1)
        for c in range(twos, k):
            at = node * bins + bin_of(c)
            for j, v in enumerate(values):
                out[:, c, :, j] = np.bincount(at, v, m * bins).reshape(m, bins)
        return out


class Codes:
    """How columns share codes: ``groups`` has the columns and the bits of each code, ``at`` the code, shift and bits of each column with more than one bin."""

    def __init__(self, sizes: list[int], width: int = WIDTH):
        self.k, self.groups, self.at = len(sizes), [], {}
        bits = [(n - 1).bit_length() for n in sizes]
        for c in sorted(range(self.k), key=lambda c: (-bits[c], c)):
            if not bits[c]:
                continue
            code = next((i for i, (_, used) in enumerate(self.groups) if used + bits[c] <= width), len(self.groups))
            if code == len(self.groups):
                self.groups.append(([], 0))
            columns, used = self.groups[code]
            self.at[c] = (code, used, bits[c])
            self.groups[code] = ([*columns, c], used + bits[c])

    def pack(self, x: np.ndarray) -> np.ndarray:
        """A row per code from a row of bins per column."""
        out = np.zeros((len(self.groups), x.shape[1]), dtype=np.uint16)
        for c, (code, shift, _) in self.at.items():
            out[code] |= x[c].astype(np.uint16) << np.uint16(shift)
        return out

    def unpack(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((self.k, codes.shape[1]), dtype=np.uint8)
        for c, (code, shift, bits) in self.at.items():
            out[c] = (codes[code] >> np.uint16(shift)) & np.uint16((1 << bits) - 1)
        return out


class Packed(Rows):
    """Rows of a spread table: codes of several columns instead of bins."""

    def __init__(self, blocks: list[dict], codes: Codes, how: Boosting):
        x = [codes.pack(np.frombuffer(b["bins"], dtype=np.uint8).reshape(codes.k, -1)) for b in blocks]
        self.codes, self.x = codes, np.concatenate(x, axis=1)
        self.y, self.w, self.raw = (np.concatenate([np.frombuffer(b[c], dtype=np.float64) for b in blocks]) for c in ("y", "w", "raw"))
        self.u = np.concatenate([np.frombuffer(b["u"], dtype=np.int64) for b in blocks]) if how.rows < 1 else None
        if (np.isin(self.y, (0.0, 1.0))).all():
            self.y = self.y.astype(np.uint8)
        if (self.w == 1).all():
            self.w = np.broadcast_to(1.0, len(self.y))

    def __getstate__(self) -> dict:
        """What an executor keeps: no gradients, a weight of 1 by its number only."""
        return {"codes": self.codes, "x": self.x, "y": self.y, "raw": self.raw, "u": self.u, "w": self.w if self.w.strides[0] else None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.w is None:
            self.w = np.broadcast_to(1.0, len(self.y))

    def leaf_of(self, tree: Tree) -> np.ndarray:
        if len(tree.column) > 256:
            return tree.leaf_of(self.codes.unpack(self.x))
        return tree.leaf_of_bins(self.x.shape[1], self._low)

    def _low(self, column: int, cut: int) -> np.ndarray:
        if column not in self.codes.at:
            return np.broadcast_to(True, self.x.shape[1])
        code, shift, bits = self.codes.at[column]
        if shift + bits == self.codes.groups[code][1]:  # nothing above it in the code
            return self.x[code] < min((cut + 1) << shift, 1 << (shift + bits))
        return (self.x[code] & np.uint16(((1 << bits) - 1) << shift)) <= np.uint16(cut << shift)

    def add(self, trees: list[Tree]) -> Packed:
        """The same rows with the scores of further trees."""
        self.raw = self.raw.copy() if trees else self.raw
        for t in trees:
            self.raw += np.array(t.value).take(self.leaf_of(t))
        return self

    def sums(self, tree: Tree, nodes: list[int], bins: int) -> np.ndarray:
        """The histogram of each of several nodes of a tree, code by code."""
        m, n = len(nodes), self.x.shape[1]
        rows = slice(None) if len(self.kept) == n else self.kept
        node = np.zeros(1, dtype=np.intp)
        if len(tree.column) > 1:
            slots = np.full(len(tree.column), m, dtype=np.uint8 if m < 255 else np.int32)
            slots[nodes] = np.arange(m)
            slot = slots.take(self.leaf_of(tree))
            if len(self.kept) < n:
                left_out = np.ones(n, dtype=bool)
                left_out[self.kept] = False
                slot[left_out] = m
            rows = np.flatnonzero(slot < m)
            if m > 1:  # node by node
                node = slot.take(rows)
                order = np.argsort(node, kind="stable")
                rows, node = rows.take(order), node.take(order).astype(np.intp)
        take = (lambda v: v) if isinstance(rows, slice) else (lambda v: v.take(rows))
        plain = not self.h.strides[0]  # every row has the curvature 1
        values = [take(self.g), None if plain else take(self.h), None]
        every = np.broadcast_to(node, len(values[0]))
        out = np.zeros((m, len(self.x) and self.codes.k, bins, 3))
        whole = [np.bincount(every, v, m) for v in values]
        for j, v in enumerate(whole):
            out[:, [c for c in range(self.codes.k) if c not in self.codes.at], 0, j] = v[:, None]
        for x, (columns, bits) in zip(self.x, self.codes.groups):
            at = take(x).astype(np.intp)
            if m > 1:
                at += node << bits
            for j, v in enumerate(values):
                if j == 1 and plain:
                    continue
                left = np.bincount(at, v, m << bits)
                for c in columns:  # the lowest bits of the code that is left
                    left = left.reshape(m, -1, 1 << self.codes.at[c][2])
                    own = left.sum(axis=1)
                    out[:, c, : min(own.shape[1], bins), j] = own[:, :bins]
                    left = left.sum(axis=2)
        if plain:
            out[..., 1] = out[..., 2]
        return out


# ------------------------------------------------------------------ growing

#: Asks for the histograms of nodes of the tree as it stands.
Sums = Callable[[Tree, list[int]], list[np.ndarray]]


def _scores(h: np.ndarray, how: Boosting) -> np.ndarray:
    """Gain of each (column, bin) as a cut of a node; -inf where it may not be cut."""
    left = np.cumsum(h, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    size = 2 if how.grow == "variance" else 1
    ridge = 0.0 if how.grow == "variance" else how.ridge
    part = lambda s: s[..., 0] ** 2 / np.maximum(s[..., size] + ridge, 1e-12)
    gain = part(left) + part(right) - part(whole)
    fits = np.minimum(left[..., 2], right[..., 2]) >= max(how.least_rows, 1)
    fits &= np.minimum(left[..., 1], right[..., 1]) >= how.least_weight
    return np.where(fits, gain, -np.inf)


def _best(gain: np.ndarray, columns: np.ndarray) -> tuple[float, int, int]:
    """Highest gain, its column and bin; of equal ones the first."""
    some = gain[columns]
    k = int(np.argmax(some))
    return float(some.flat[k]), int(columns[k // gain.shape[1]]), k % gain.shape[1]


def grow_tree(sums: Sums, how: Boosting, columns: np.ndarray) -> Tree:
    """One tree; nodes that are due are asked for together, of two children only the smaller.

    Leaves of the last level have the sums that their parent's histogram gives them.
    """
    tree = Tree.root()
    held = {0: sums(tree, [0])[0]}
    whole = {0: held[0][0].sum(axis=0)}
    depth = {0: 0}
    made: dict[int, list[int]] = {}  # leaf: its children, if they are known

    def expand(some: list[tuple[int, float, int, int]]) -> None:
        ask, other = [], []
        for node, gain, column, cut in some:
            a, b = tree.split(node, column, cut, gain)
            made[node], depth[a], depth[b] = [a, b], depth[node] + 1, depth[node] + 1
            whole[a], whole[b] = held[node][column, : cut + 1].sum(axis=0), held[node][column, cut + 1:].sum(axis=0)
            if depth[a] == how.depth:
                continue
            few, many = (a, b) if whole[a][2] <= whole[b][2] else (b, a)
            ask.append(few)
            other.append((node, many))
        for few, (node, many), h in zip(ask, other, sums(tree, ask) if ask else []):
            held[few], held[many] = h, held[node] - h

    if how.grow == "leaf":
        options = {0: _best(_scores(held[0], how), columns)}
        queue = [(-options[0][0], 0)]
        leaves, kept = 1, set()
        while queue and leaves < how.leaves and queue[0][0] < -1e-9:
            if queue[0][1] not in made:  # look ahead for all leaves that may be next
                expand([(n, *options[n]) for g, n in sorted(queue) if n not in made and g < -1e-9])
            _, node = heapq.heappop(queue)
            kept.add(node)
            leaves += 1
            for child in made[node]:
                options[child] = _best(_scores(held[child], how), columns) if depth[child] < how.depth else (-math.inf, 0, 0)
                heapq.heappush(queue, (-options[child][0], child))
        for node in made:  # what was looked at but not taken is a leaf again
            if node not in kept:
                tree.column[node] = -1
    else:
        level = [0]
        for _ in range(how.depth):
            gains = [_scores(held[n], how) for n in level]
            if how.grow == "symmetric":
                gain, column, cut = _best(sum(np.where(np.isfinite(g), g, 0.0) for g in gains), columns)
                some = [(n, float(g[column, cut]), column, cut) for n, g in zip(level, gains) if np.isfinite(g[column, cut])] if gain > 1e-9 else []
            else:
                some = [(n, *_best(g, columns)) for n, g in zip(level, gains)]
                some = [s for s in some if s[1] > 1e-9]
            expand(some)
            level = [c for s in some for c in made[s[0]]]
            if not level:
                break
    for node, (g, c, _) in whole.items():
        tree.value[node] = float(-how.rate * g / max(c + (0.0 if how.grow == "variance" else how.ridge), 1e-12))
    return tree


def _columns(how: Boosting, number: int, k: int) -> np.ndarray:
    if how.columns >= 1:
        return np.arange(k)
    rng = np.random.default_rng([how.seed, number])
    return np.sort(rng.choice(k, max(1, math.ceil(how.columns * k)), replace=False))


def train_rows(rows: Rows, how: Boosting) -> list[Tree]:
    """All rounds on rows in memory."""
    trees = []
    for number in range(how.rounds):
        rows.begin(how, number)
        at: dict[int, np.ndarray] = {0: rows.kept}

        def members(tree: Tree, node: int) -> np.ndarray:
            if node not in at:
                parent = (tree.left.index(node) if node in tree.left else tree.right.index(node))
                own = at.pop(parent)
                low = rows.x[tree.column[parent], own] <= tree.cut[parent]
                at[tree.left[parent]], at[tree.right[parent]] = own[low], own[~low]
            return at[node]

        tree = grow_tree(lambda t, nodes: [rows.histogram(members(t, n), how.bins) for n in nodes], how, _columns(how, number, len(rows.x)))
        tree.add(rows.x, rows.raw)
        trees.append(tree)
    return trees


def train_spread(table: DataFrame, how: Boosting, sizes: list[int]) -> list[Tree]:
    """All rounds on a table of blocks over many tasks: a job per level. ``sizes`` are the bins of each column."""
    trees: list[Tree] = []
    fresh: list[Tree] = []  # trees that the kept scores do not have yet
    codes, shape = Codes(sizes), (len(sizes), how.bins, 3)
    cores = table.sparkSession.sparkContext.defaultParallelism
    cells = table.agg(F.sum(F.length("bins"))).first()[0]
    tasks = cores * max(1, -(-cells // (cores * SHARE)))

    def packed(it: Iterator[dict]) -> Iterator[Packed]:
        held, n = [], 0
        for block in it:
            held.append(block)
            n += len(block["y"]) // 8
            if n >= COUNTED:
                yield Packed(held, codes, how)
                held, n = [], 0
        if held:
            yield Packed(held, codes, how)

    rows = table.repartition(tasks).rdd.mapPartitions(packed).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    last = None  # what the kept rows were made from

    def summed(tree: Tree, nodes: list[int]) -> list[np.ndarray]:
        number, since = len(trees), list(fresh)

        def add(it: Iterator[Packed]) -> Iterator[np.ndarray]:
            total = np.zeros((len(nodes), *shape))
            for part in it:
                part.add(since).begin(how, number)
                total += part.sums(tree, nodes, how.bins)
            yield total

        parts = rows.mapPartitions(add)
        return list(parts.treeReduce(np.add) if tasks > DIRECT else sum(parts.collect()))

    for number in range(how.rounds):
        if len(fresh) == STORED:
            since = list(fresh)
            last, rows = rows, rows.map(lambda part, since=since: part.add(since)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            fresh = []
        tree = grow_tree(summed, how, _columns(how, number, len(sizes)))
        if last is not None:
            last, _ = None, last.unpersist()
        trees.append(tree)
        fresh.append(tree)
    rows.unpersist()
    return trees


# -------------------------------------------------------------------- model


class BoostedTrees:
    """Fitted trees; ``cuts`` has for each feature the upper values of its bins."""

    def __init__(self, features: list[str], how: Boosting, base: float, cuts: list[list[float]], trees: list[Tree]):
        self.features, self.how, self.base, self.cuts, self.trees = list(features), how, base, cuts, trees

    @property
    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        out = np.zeros(len(self.features))
        for t in self.trees:
            for c, g in zip(t.column, t.gain):
                if c >= 0:
                    out[c] += g
        return out / out.sum() if out.sum() else out

    def margin(self, columns: list[np.ndarray]) -> np.ndarray:
        """Sum of the trees for rows given by column."""
        x = np.stack([np.searchsorted(np.array(c), v, "left") for c, v in zip(self.cuts, columns)]) if columns else np.zeros((0, 0))
        x = x.astype(np.uint8) if self.how.bins <= 256 else x
        out = np.full(x.shape[1], self.base)
        for t in self.trees:
            t.add(x, out)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for two classes, ``score``, the probability of class 1. Nulls count as 0."""

        @F.pandas_udf("double")
        def margin(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)
                yield pd.Series(self.margin([c.to_numpy(dtype=float) for c in columns]))

        out = margin(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.features])
        if self.how.loss != "logistic":
            return df.withColumn("prediction", out)
        score = 1 / (1 + F.exp(-out))
        return df.withColumn("score", score).withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        about = json.dumps({"features": self.features, "how": asdict(self.how), "base": self.base, "cuts": self.cuts})
        trees = [(i, json.dumps(asdict(t))) for i, t in enumerate(self.trees)]
        spark.createDataFrame([(-1, about), *trees], "tree int, content string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        about, *trees = [json.loads(r["content"]) for r in spark.read.parquet(path).orderBy("tree").collect()]
        return BoostedTrees(about["features"], Boosting(**about["how"]), about["base"], about["cuts"], [Tree(**t) for t in trees])


def bin_cuts(df: DataFrame, features: list[str], bins: int, n: int) -> list[list[float]]:
    """Upper values of each feature's bins: quantiles without repeats, the last bin is open.

    Beyond EXACT of the ``n`` rows they may be off by a quarter of a bin's rows.
    """
    values = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)])
    names, shares = [f"f{i}" for i in range(len(features))], [i / bins for i in range(1, bins)]
    if n <= EXACT:
        rows = {r["column"]: r["quantiles"] for r in quantiles(values, names, shares).collect()}
        found = [rows[c] for c in names]
    else:
        found = values.approxQuantile(names, shares, 0.25 / bins)
    return [sorted({v for v in f or [] if not math.isnan(v)}) for f in found]


def _numbers(df: DataFrame, features: list[str], label: str, weight: str | None) -> DataFrame:
    """f0, f1, ... (nulls as 0), y, w, u: what is binned, the label, the weight and a hash of the row."""
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    u = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(*values, F.col(label).cast("double").alias("y"), w.alias("w"), u.alias("u"))


def binned_blocks(df: DataFrame, features: list[str], label: str, weight: str | None, cuts: list[list[float]], base: float) -> DataFrame:
    """Binned rows in blocks of about BLOCK rows, column by column, so that no round takes a row apart."""
    bounds = [np.array(c, dtype=float) for c in cuts]

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, *rest = (np.concatenate(parts, axis=-1) for parts in zip(*held))
        parts = {"bins": x, **dict(zip("ywu", rest)), "raw": np.full(x.shape[1], base)}
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts.values()], list(parts))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            x = np.empty((len(bounds), batch.num_rows), dtype=np.uint8)
            for i, c in enumerate(bounds):
                x[i] = np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False), "left")
            held.append((x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in "ywu")))
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return _numbers(df, features, label, weight).mapInArrow(run, "bins binary, y binary, w binary, u binary, raw binary")


def _binned(df: DataFrame, features: list[str], label: str, weight: str | None, cuts: list[list[float]], base: float) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.stack([np.searchsorted(np.array(c), batch.column(i).to_numpy(zero_copy_only=False), "left") for i, c in enumerate(cuts)], axis=1)
            data = x.astype(np.uint8).tobytes()
            k = len(cuts)
            rows = [data[i * k: (i + 1) * k] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), *(batch.column(c) for c in ("y", "w", "u")), pa.array(np.full(batch.num_rows, base))], ["bins", "y", "w", "u", "raw"])

    return _numbers(df, features, label, weight).mapInArrow(run, "bins binary, y double, w double, u long, raw double")


def fit(
    df: DataFrame, features: list[str], label: str, how: Boosting, weight: str | None = None,
    find: Callable[[DataFrame, list[str], int, int], list[list[float]]] = bin_cuts,
) -> BoostedTrees:
    """Trees for ``label`` (0 and 1, or a number for the squared loss). Null features count as 0; rows without a label play no part.

    ``find`` finds the bins, from the rows, the features, how many bins and how many rows.
    """
    df = df.filter(F.col(label).isNotNull())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    n, mean = df.agg(F.count("*"), F.sum(w * F.col(label)) / F.sum(w)).first()
    if not n:
        return BoostedTrees(features, how, 0.0, [[] for _ in features], [])
    base = float(mean)
    if how.loss == "logistic":
        base = math.log(max(base, 1e-9) / max(1 - base, 1e-9))
    cuts = find(df, features, how.bins, n)
    if n * len(features) > ALONE:
        table = materialize(binned_blocks(df, features, label, weight, cuts, base), "boosting-blocks")
        return BoostedTrees(features, how, base, cuts, train_spread(table, how, [len(c) + 1 for c in cuts]))

    def alone(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(it)).sort_by("u")  # at most ALONE bytes of bins, in an order that does not change
        rows = Rows(table, len(features))
        trees = train_rows(rows, how)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(trees)), pa.int32()), pa.array([json.dumps(asdict(t)) for t in trees])], ["tree", "content"])

    got = materialize(_binned(df, features, label, weight, cuts, base), "boosting-bins").repartition(1).mapInArrow(alone, "tree int, content string").collect()
    return BoostedTrees(features, how, base, cuts, [Tree(**json.loads(r["content"])) for r in sorted(got, key=lambda r: r["tree"])])
