"""Random forests on binned columns.

Every tree draws its rows by a hash (Poisson counts, as a bootstrap of any
size; rows that agree in all columns are drawn together, so a table should have
its key) and, at every node, its own columns. Nodes are cut by histograms of
counts per column and bin, all nodes of a level together. A table that is known
to be small goes to several tasks, each of which grows some of the trees. A
larger one is cut into shares as large as a task can hold, and each share is
kept by as many tasks as there are cores to a share, which divide the trees: a
job per level sums up histograms, adds them up over the shares by groups of
nodes, and hands on the best cuts only. Both ways grow the same trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.boosting import ALONE, Codes, bin_cuts, binned_blocks
from gridloom.session import materialize

#: Nodes whose histograms are summed up together.
NODES = 256
#: Cells (rows x columns) of a share of a spread table, which a task holds.
HELD = 1 << 26
#: Bits of the code that columns share where every node has all of them.
SHARED = 10
#: Nodes of a level up to which rows are led to their nodes by comparing whole columns.
WHOLE = 16
#: Rows that go down the levels at a time, so that what they read stays in a core's cache.
PIECE = 1 << 15
#: Rows of a node, on average, from which nodes are summed up one by one.
MANY = 2048
#: Bytes of histograms that one job hands from tasks to tasks; the trees of a level are dealt out to several jobs beyond.
MOVED = 1 << 31
#: Poisson counts of mean 1 by the first 16 bits of a hash.
COUNTS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
TREE = "tree int, column binary, cut binary, left binary, value binary, gain binary"
TYPES = {"column": np.int16, "cut": np.uint8, "left": np.int32, "value": np.float64, "gain": np.float64}


@dataclass(frozen=True)
class Forest:
    """How trees are grown; ``columns`` is "all", "sqrt" or "onethird" of them at each node, ``weights`` those of class 0 and 1."""

    trees: int = 200
    depth: int = 12
    least_rows: int = 1
    columns: str = "sqrt"
    bins: int = 32
    classes: bool = True
    weights: tuple[float, float] = (1.0, 1.0)
    seed: int = 42

    @staticmethod
    def of(estimator, weights: tuple[float, float] = (1.0, 1.0)) -> Forest:
        """The forest that Spark's estimator describes."""
        classes, columns = isinstance(estimator, RandomForestClassifier), estimator.getFeatureSubsetStrategy()
        if columns == "auto":
            columns = "all" if estimator.getNumTrees() == 1 else "sqrt" if classes else "onethird"
        return Forest(estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), columns,
                      estimator.getMaxBins(), classes, weights, estimator.getSeed())

    def slots(self, k: int) -> int:
        return {"all": k, "sqrt": math.ceil(math.sqrt(k)), "onethird": math.ceil(k / 3)}[self.columns]

    def subset(self, k: int, tree: int, level: int, m: int) -> np.ndarray:
        """Columns of the ``m`` nodes of a level, ascending."""
        some = self.slots(k)
        if some == k:
            return np.broadcast_to(np.arange(k), (m, k))
        drawn = np.random.default_rng([self.seed, tree, level]).random((m, k))
        return np.sort(np.argpartition(drawn, some, axis=1)[:, :some], axis=1)


# -------------------------------------------------------------------- trees


@dataclass
class Level:
    """Nodes of a level that were due: their cut, and the places of their children among the due nodes of the next level (-1: a leaf)."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # left and right of each node


class Growing:
    """A tree that grows level by level."""

    def __init__(self, how: Forest, base: float):
        self.how, self.levels, self.due = how, [], np.zeros(1, dtype=np.int64)
        self.parts = {"column": [np.array([-1])], "cut": [np.array([0])], "left": [np.array([0])], "value": [np.array([base])], "gain": [np.array([0.0])]}
        self.size = 1

    def values(self, sums: np.ndarray) -> np.ndarray:
        """Leaf values from counts by class, or from count and sum."""
        if self.how.classes:
            ones = sums[:, 1] * self.how.weights[1]
            return ones / (sums[:, 0] * self.how.weights[0] + ones)
        return sums[:, 1] / sums[:, 0]

    def cut(self, best: dict[str, np.ndarray]) -> None:
        """Cuts the due nodes as ``best`` says, and finds those that are due next."""
        how, whole, left = self.how, best["whole"], best["left"]
        if not self.levels and whole[0].sum() > 0 and (how.classes or whole[0, 0] > 0):
            self.parts["value"][0] = self.values(whole[:1])
        split = best["gain"] > 0
        n = int(split.sum())
        column, flat = np.where(split, best["column"], -1), {p: np.concatenate(v) for p, v in self.parts.items()}
        flat["column"][self.due], flat["cut"][self.due] = column, np.where(split, best["cut"], 0)
        flat["left"][self.due[split]] = self.size + 2 * np.arange(n)
        flat["gain"][self.due] = np.where(split, best["gain"], 0.0)
        below = np.stack([left[split], (whole - left)[split]], axis=1).reshape(-1, 2)
        rows = below.sum(axis=1) if how.classes else below[:, 0]
        deeper = np.full(2 * n, len(self.levels) + 1 < how.depth) & (rows >= 2 * max(how.least_rows, 1))
        if how.classes:
            deeper &= below.min(axis=1) > 0
        child = np.full((len(split), 2), -1, dtype=np.int64)
        child[split] = np.where(deeper, np.cumsum(deeper) - 1, -1).reshape(-1, 2)
        self.levels.append(Level(np.maximum(column, 0), np.where(split, best["cut"], 0).astype(np.uint8), child.ravel()))
        self.due = self.size + np.flatnonzero(deeper)
        self.size += 2 * n
        none = {"column": np.full(2 * n, -1), "cut": np.zeros(2 * n, int), "left": np.zeros(2 * n, int), "value": self.values(below), "gain": np.zeros(2 * n)}
        self.parts = {p: [flat[p], none[p]] for p in flat}

    def tree(self) -> dict[str, np.ndarray]:
        return {p: np.concatenate(self.parts[p]).astype(t) for p, t in TYPES.items()}


def best_cuts(h: np.ndarray, subset: np.ndarray, how: Forest) -> dict[str, np.ndarray]:
    """The best cut of each node from (node, column, bin, sums); a gain of 0 where there is none. Of equal ones the first."""
    left = np.cumsum(h, axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left
    if how.classes:
        a, b = how.weights
        part = lambda s: ((a * s[..., 0]) ** 2 + (b * s[..., 1]) ** 2) / np.maximum(a * s[..., 0] + b * s[..., 1], 1e-300)
        rows = lambda s: s[..., 0] + s[..., 1]
    else:
        part = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)
        rows = lambda s: s[..., 0]
    both = part(left) + part(right)
    gain = both - part(whole)
    fits = (np.minimum(rows(left), rows(right)) >= max(how.least_rows, 1)) & (gain > 1e-12 * both)
    gain = np.where(fits, gain, 0.0).reshape(len(h), -1)
    at = gain.argmax(axis=1)
    node, slot, cut = np.arange(len(h)), at // h.shape[2], at % h.shape[2]
    return {"gain": gain[node, at], "column": subset[node, slot], "cut": cut, "left": left[node, slot, cut], "whole": whole[:, 0, 0]}


# --------------------------------------------------------------------- rows


class Rows:
    """Binned rows in memory, in the order of their hashes if ``sort`` is set; by column, and by row too if nodes have columns of their own."""

    def __init__(self, blocks: list[dict], k: int, how: Forest, center: float, sort: bool = False):
        x = np.concatenate([np.frombuffer(b["bins"], dtype=np.uint8).reshape(k, -1) for b in blocks], axis=1)
        y = np.concatenate([np.frombuffer(b["y"], dtype=np.float64) for b in blocks])
        self.u = np.concatenate([np.frombuffer(b["u"], dtype=np.uint64) for b in blocks])
        if sort:
            order = np.argsort(self.u, kind="stable")
            x, y, self.u = x[:, order], y[order], self.u[order]
        self.how, self.k, self.n = how, k, len(y)
        self.all = how.slots(k) == k
        self.columns = np.ascontiguousarray(x)
        self.x = self.columns.ravel() if self.all else np.ascontiguousarray(x.T).ravel()
        self.row, self.column = (1, self.n) if self.all else (k, 1)
        if self.all:
            self.codes = Codes([int(c.max(initial=0)) + 1 for c in self.columns], SHARED)
            self.packed = self.codes.pack(self.columns)
        self.y = y.astype(np.int64) if how.classes else y - center
        self.ones = y.astype(np.uint8) if how.classes else None

    def start(self, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that a tree draws, how often, and their node: the root."""
        counts = self.counts(tree)
        rows = np.flatnonzero(counts)
        return rows, counts.take(rows).astype(np.float64), np.zeros(len(rows), dtype=np.int64)

    def counts(self, tree: int) -> np.ndarray:
        z = (self.u ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + self.how.seed & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return COUNTS.take(z >> np.uint64(48))

    def at_level(self, tree: int, levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a tree that are in the due nodes below some levels; while nodes are few, whole columns of bytes are compared."""
        counts = self.counts(tree)
        inside, few = {0: counts > 0}, 0
        for few, level in enumerate(levels):  # noqa: B007
            if len(level.column) > WHOLE:
                break
            below = {}
            for node, own in inside.items():
                left, right = level.child[2 * node: 2 * node + 2]
                if left >= 0 or right >= 0:
                    low = own & (self.columns[level.column[node]] <= level.cut[node])
                    below |= {child: part for child, part in ((left, low), (right, own ^ low)) if child >= 0}
            inside = below
        else:
            few = len(levels)
        at = np.zeros(self.n, dtype=np.uint8)
        for node, own in inside.items():
            at += own.view(np.uint8) * np.uint8(node + 1)
        rows = np.flatnonzero(at)
        state = rows, counts.take(rows).astype(np.float64), at.take(rows).astype(np.int64) - 1
        if few == len(levels):
            return state
        pieces = []
        for a in range(0, max(len(rows), 1), PIECE):
            piece = tuple(v[a: a + PIECE] for v in state)
            for level in levels[few:]:
                piece = self.descend(piece, level)
            pieces.append(piece)
        return tuple(np.concatenate(v) for v in zip(*pieces))

    def descend(self, state: tuple[np.ndarray, np.ndarray, np.ndarray], level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the next level; those that reached a leaf are left out."""
        rows, counts, node = state
        x = self.x.take((rows if self.row == 1 else rows * self.row) + (level.column * self.column).take(node))
        node = level.child.take(2 * node + (x > level.cut.take(node)))
        if (node < 0).any():
            kept = np.flatnonzero(node >= 0)
            rows, counts, node = rows.take(kept), counts.take(kept), node.take(kept)
        return rows, counts, node

    def sums(self, state: tuple[np.ndarray, np.ndarray, np.ndarray], subset: np.ndarray, first: int = 0) -> np.ndarray:
        """(node, column, bin, sums) of the nodes ``first`` and on, with the columns of ``subset``."""
        rows, counts, node = state
        (m, slots), bins = subset.shape, self.how.bins
        if first or (len(node) and int(node.max()) >= m):
            own = np.flatnonzero((node >= first) & (node < first + m))
            rows, counts, node = rows.take(own), counts.take(own), node.take(own) - first
        if self.all:
            return self._coded(rows, counts, node, m)
        out = np.empty((m, slots, bins, 2))
        if len(rows) >= MANY * m and m < 1 << 15:
            return self._one_by_one(rows, counts, node, subset, out)
        y = self.y.take(rows)
        at_node = (node * 2 + y) * bins if self.how.classes else node * bins
        value, at_row = None if self.how.classes else counts * y, rows * self.row
        for s in range(slots):
            at = at_node + self.x.take(at_row + (subset[:, s] * self.column).take(node))
            if self.how.classes:
                out[:, s] = np.bincount(at, counts, m * 2 * bins).reshape(m, 2, bins).transpose(0, 2, 1)
            else:
                out[:, s, :, 0] = np.bincount(at, counts, m * bins).reshape(m, bins)
                out[:, s, :, 1] = np.bincount(at, value, m * bins).reshape(m, bins)
        return out

    def _coded(self, rows: np.ndarray, counts: np.ndarray, node: np.ndarray, m: int) -> np.ndarray:
        """The same for all columns, several of them in one look-up if nodes have enough rows."""
        lanes, bins = 2 if self.how.classes else 1, self.how.bins
        out, y = np.zeros((m, self.k, bins, 2)), self.y.take(rows)
        lane = node * 2 + y if self.how.classes else node
        flat = [c for c in range(self.k) if c not in self.codes.at]
        values = [counts] if self.how.classes else [counts, counts * y]
        for j, v in enumerate(values):
            out[:, flat, 0, j: j + lanes] = np.bincount(lane, v, m * lanes).reshape(m, 1, lanes)
        coded = zip(self.packed, self.codes.groups)
        if len(rows) < m << SHARED:  # histograms of codes would be mostly empty
            coded = ((self.columns[c], ([c], bits)) for c, (_, _, bits) in self.codes.at.items())
        for x, (columns, bits) in coded:
            at = x.take(rows).astype(np.intp)
            at += lane << bits
            for j, v in enumerate(values):
                left = np.bincount(at, v, (m * lanes) << bits)
                for c in columns:  # the lowest bits of the code that is left
                    left = left.reshape(m * lanes, -1, 1 << self.codes.at[c][2])
                    own = left.sum(axis=1)[:, :bins]
                    out[:, c, : own.shape[1], j: j + lanes] = own.reshape(m, lanes, -1).transpose(0, 2, 1)
                    left = left.sum(axis=2)
        return out

    def _one_by_one(self, rows: np.ndarray, counts: np.ndarray, node: np.ndarray, subset: np.ndarray, out: np.ndarray) -> np.ndarray:
        bins = self.how.bins
        order = np.argsort(node.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(node, minlength=len(out)))
        for j, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            own, c = rows.take(order[a:b]), counts.take(order[a:b])
            if self.how.classes:
                ones = self.ones.take(own).astype(np.intp) * bins
            else:
                value = c * self.y.take(own)
            for s, column in enumerate(subset[j]):
                at = self.columns[column].take(own)
                if self.how.classes:
                    out[j, s] = np.bincount(at + ones, c, 2 * bins).reshape(2, bins).T
                else:
                    at = at.astype(np.intp)
                    out[j, s, :, 0], out[j, s, :, 1] = np.bincount(at, c, bins), np.bincount(at, value, bins)
        return out


def grow(rows: Rows, number: int, base: float) -> Growing:
    """One tree on rows in memory."""
    how, tree, state = rows.how, Growing(rows.how, base), rows.start(number)
    while len(tree.due):
        if tree.levels:
            state = rows.descend(state, tree.levels[-1])
        m = len(tree.due)
        subset = how.subset(rows.k, number, len(tree.levels), m)
        parts = [best_cuts(rows.sums(state, subset[a: a + NODES * 8], a), subset[a: a + NODES * 8], how) for a in range(0, m, NODES * 8)]
        tree.cut({p: np.concatenate([b[p] for b in parts]) for p in parts[0]})
    return tree


def _grown_alone(table: DataFrame, k: int, how: Forest, base: float, center: float) -> list[dict[str, np.ndarray]]:
    """All trees of a small table of blocks: every task gets the table and grows some of the trees."""
    spark = table.sparkSession
    tasks = min(how.trees, 4 * spark.sparkContext.defaultParallelism)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b for batch in it for b in batch.to_pylist()]  # at most ALONE bytes of bins
        if not blocks:
            return
        rows, task = Rows(blocks, k, how, center, sort=True), blocks[0]["task"]
        del blocks
        for number in range(task, how.trees, tasks):
            tree = grow(rows, number, base).tree()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([tree[p].tobytes()], pa.binary()) for p in TYPES)], ["tree", *TYPES])

    dealt = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task")).crossJoin(F.broadcast(table.select("bins", "y", "u")))
    return _trees(dealt.mapInArrow(run, TREE))


def _grown_spread(table: DataFrame, k: int, how: Forest, base: float, center: float) -> list[dict[str, np.ndarray]]:
    """All trees of a large table of blocks: a job per level, or several if histograms are many."""
    trees = [Growing(how, base) for _ in range(how.trees)]
    slots = how.slots(k)
    wide = slots * how.bins * 2 * (4 if how.classes else 8)  # bytes of a node
    cores = table.sparkSession.sparkContext.defaultParallelism
    shares = max(1, -(-table.agg(F.sum(F.length("bins"))).first()[0] // HELD))
    teams = min(how.trees, max(1, -(-cores // shares)))
    blocks = table.select("bins", "y", "u").rdd.map(lambda r: {c: bytes(r[c]) for c in ("bins", "y", "u")}).zipWithIndex()
    dealt = blocks.flatMap(lambda at: [(at[1] % shares * teams + team, at[0]) for team in range(teams)]).partitionBy(shares * teams, lambda place: place)
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def job(numbers: list[int]) -> None:
        level = len(trees[numbers[0]].levels)
        plan = [(number, trees[number].levels, len(trees[number].due)) for number in numbers]
        due = {number: m for number, _, m in plan}
        found = {"gain": np.float64, "column": np.int64, "cut": np.int64, "left": np.float64, "whole": np.float64}

        def add(it: Iterator[tuple[int, dict]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            places, held = zip(*it) if (it := list(it)) else ((), ())
            if not held:
                return
            team, rows = places[0] % teams, Rows(list(held), k, how, center)
            del it, held
            for number, levels, m in plan[team::teams]:
                state, subset = rows.at_level(number, levels), how.subset(k, number, level, m)
                for a in range(0, m, NODES):
                    sums = rows.sums(state, subset[a: a + NODES], a)
                    yield (number, a), sums.astype(np.float32 if how.classes else np.float64)  # counts of HELD cells are exact

        def pick(it: Iterator[tuple[tuple[int, int], np.ndarray]]) -> Iterator[tuple]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for key, sums in it:
                if key in total:
                    total[key] += sums
                else:
                    total[key] = sums.astype(np.float64)
            for (number, a), sums in total.items():
                best = best_cuts(sums, how.subset(k, number, level, due[number])[a: a + len(sums)], how)
                yield number, a, {p: best[p].astype(t) for p, t in found.items()}

        parts = min(sum(-(-m // NODES) for m in due.values()), 2 * cores)
        best = dealt.mapPartitions(add).partitionBy(parts, lambda key: key[0] * 31 + key[1] // NODES).mapPartitions(pick).collect()
        best.sort(key=lambda r: r[:2])
        own: dict[int, list[dict]] = {}
        for number, _, cuts in best:
            own.setdefault(number, []).append(cuts)
        for number in numbers:
            cuts = {p: np.concatenate([c[p] for c in own[number]]) for p in found}
            trees[number].cut({p: v.reshape(-1, 2) if p in ("left", "whole") else v for p, v in cuts.items()})

    while due := [i for i, t in enumerate(trees) if len(t.due)]:
        some, size = [], 0
        for number in due:
            own = len(trees[number].due) * wide * shares
            if some and size + own > MOVED:
                job(some)
                some, size = [], 0
            some.append(number)
            size += own
        job(some)
    dealt.unpersist()
    return [t.tree() for t in trees]


def _trees(table: DataFrame) -> list[dict[str, np.ndarray]]:
    return [{p: np.frombuffer(r[p], dtype=t) for p, t in TYPES.items()} for r in sorted(table.collect(), key=lambda r: r["tree"])]


# -------------------------------------------------------------------- model


class ForestModel:
    """Fitted trees; ``cuts`` has for each feature the upper values of its bins."""

    def __init__(self, features: list[str], how: Forest, base: float, center: float, cuts: list[list[float]], trees: list[dict[str, np.ndarray]]):
        self.features, self.how, self.base, self.center, self.cuts, self.trees = list(features), how, base, center, cuts, trees

    @property
    def importances(self) -> np.ndarray:
        """Share of each feature in the impurity that the splits of a tree take away, over all trees alike."""
        out = np.zeros(len(self.features))
        for t in self.trees:
            split = t["column"] >= 0
            own = np.bincount(t["column"][split], t["gain"][split], len(out))
            out += own / own.sum() if own.sum() else 0.0
        return out / out.sum() if out.sum() else out

    def mean(self, columns: list[np.ndarray]) -> np.ndarray:
        """Mean of the trees for rows given by column."""
        n, k = len(columns[0]), len(self.cuts)
        x = np.stack([np.searchsorted(np.array(c), v, "left") for c, v in zip(self.cuts, columns)], axis=1).astype(np.uint8).ravel()
        out, row = np.zeros(n), np.arange(n) * k
        for t in self.trees:
            node, active = np.zeros(n, dtype=np.int64), np.arange(n) if t["column"][0] >= 0 else np.zeros(0, dtype=np.int64)
            while len(active):
                at = node.take(active)
                at = t["left"].take(at) + (x.take(row.take(active) + t["column"].take(at)) > t["cut"].take(at))
                node[active] = at
                active = active.compress(t["column"].take(at) >= 0)
            out += t["value"].take(node)
        return out / len(self.trees) + self.center if self.trees else np.full(n, self.base + self.center)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for two classes, ``score``, the probability of class 1. Nulls count as 0."""
        own = ForestModel(self.features, self.how, self.base, self.center, self.cuts, [{p: v for p, v in t.items() if p != "gain"} for t in self.trees])

        @F.pandas_udf("double")
        def mean(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)
                yield pd.Series(own.mean([c.to_numpy(dtype=float) for c in columns]))

        out = mean(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.features])
        if not self.how.classes:
            return df.withColumn("prediction", out)
        return df.withColumn("score", out).withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        about = json.dumps({"features": self.features, "how": asdict(self.how), "base": self.base, "center": self.center, "cuts": self.cuts})
        trees = [(i, *(bytearray(t[p].tobytes()) for p in TYPES)) for i, t in enumerate(self.trees)]
        spark.createDataFrame(trees, TREE).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        about = json.loads(spark.read.parquet(f"{path}/forest").first()["about"])
        how = Forest(**{**about["how"], "weights": tuple(about["how"]["weights"])})
        return ForestModel(about["features"], how, about["base"], about["center"], about["cuts"], _trees(spark.read.parquet(f"{path}/trees")))


def forest_cuts(df: DataFrame, features: list[str], bins: int, n: int) -> list[list[float]]:
    """Upper values of each feature's bins: a bin per value where there are few, else quantiles."""
    values = {f"f{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for i, c in enumerate(features)}
    about = df.agg(*[F.approx_count_distinct(v).alias(c) for c, v in values.items()]).first()
    few = [c for c in values if about[c] <= 2 * bins]
    sets = df.agg(*[F.collect_set(values[c]).alias(c) for c in few]).first().asDict() if few else {}
    sets = {c: sorted(v for v in s if not math.isnan(v)) for c, s in sets.items()}
    exact = {c: s if len(s) <= bins else None for c, s in sets.items()}
    rest = [c for c in values if exact.get(c) is None]
    found = dict(zip(rest, bin_cuts(df, [features[int(c[1:])] for c in rest], bins, n))) if rest else {}
    return [found[c] if c in found else exact[c][:-1] for c in values]


def fit(
    df: DataFrame, features: list[str], label: str, how: Forest,
    find: Callable[[DataFrame, list[str], int, int], list[list[float]]] = forest_cuts,
) -> ForestModel:
    """A forest for ``label`` (0 and 1, or a number). Null features count as 0; rows without a label play no part.

    ``find`` finds the bins, from the rows, the features, how many bins and how many rows.
    """
    df = df.filter(F.col(label).isNotNull())
    n, mean, other = df.agg(F.count("*"), F.avg(label), F.count_if(~F.col(label).isin(0, 1))).first()
    if how.classes and other:
        raise ValueError(f"{label} has values besides 0 and 1")
    if not n:
        return ForestModel(features, how, 0.0, 0.0, [[] for _ in features], [])
    ones = mean * how.weights[1]
    base, center = (ones / ((1 - mean) * how.weights[0] + ones), 0.0) if how.classes else (0.0, float(mean))
    cuts, k = find(df, features, how.bins, n), len(features)
    table = materialize(binned_blocks(df, features, label, None, cuts, 0.0), "forest-blocks")
    small = n * k <= ALONE
    return ForestModel(features, how, base, center, cuts, (_grown_alone if small else _grown_spread)(table, k, how, base, center))
