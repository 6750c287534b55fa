"""Near-duplicate vectors: exact metric range join with pivots.

On the unit sphere a cosine of at least c is a distance of at most
sqrt(2 - 2 c). Every vector lives in the cell of its nearest pivot and is stored
once, in a block of vectors of that cell. A vector within that radius r of a
cell's border, which the triangle inequality tells from its distances to the
pivots, may have neighbours there; a block knows the cells that its vectors may
reach. Two blocks meet if each may reach the other's cell, and of them only the
vectors that may. Blocks meet by a Cartesian product over the stored table, so
no vector is copied to disk, however many blocks it meets. Equal vectors are one
class before that, so a common vector costs one row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, stored
from gridloom.llm.vectors import matrix, usable

COSINE = 0.9
#: Vectors per pivot that are aimed at, pivots at the most, and rows of the sample they are chosen from (a documented bound).
PER_PIVOT, PIVOTS, SAMPLE = 2000, 512, 20_000
#: Vectors of a block at the most, and of the blocks that one task writes, about.
BLOCK, WRITTEN = 4096, 16_384
#: Slack for rounding in the border test.
SLACK = 1e-9


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v of all rows; v is null where it links with nothing. Components keep their type, -0 is 0."""
    v = F.col(vector)
    wide = F.transform(v, lambda x: x.cast("double"))
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    good = usable(wide) & F.exists(wide, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(good, F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))).alias("v"))


def _key(v: np.ndarray) -> bytes:
    """Name of a value: 128 bits."""
    return hashlib.blake2b(v.tobytes(), digest_size=16).digest()


def _named(column: pa.Array) -> list[bytes | None]:
    """Names of the vectors of a column."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(column).to_pylist())])
    return [_key(flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow on the way
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Farthest-first: each next pivot is the sample row that is farthest from those before."""
    if not len(sample) or most < 1:
        return sample[:0]
    chosen, best = [0], 2 - 2 * sample @ sample[0]
    while len(chosen) < most:
        far = int(np.argmax(best))
        if best[far] <= radius**2:
            break
        chosen.append(far)
        best = np.minimum(best, 2 - 2 * sample @ sample[far])
    return sample[chosen]


def borders(u: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and (row, cell) of its visits.

    If y lives with q and is within r of x, whose home is p, then x is within r
    of the points that are nearer to q than to p, so its distance from the
    middle between p and q is at most r: d(x,q)^2 - d(x,p)^2 <= 2 r d(p,q).
    """
    d2 = np.maximum(2 - 2 * (u @ pivots.T), 0)
    home = d2.argmin(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    visits = d2 - d2[np.arange(len(u)), home][:, None] <= 2 * radius * apart[home] + SLACK
    visits[np.arange(len(u)), home] = False
    row, cell = np.nonzero(visits)
    return home, row, cell


def _locate(pivots: np.ndarray, dims: int, kind: type):
    """Values of a batch: cell, key, v as bytes, how many rows have it and their smallest id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                rows: dict[bytes, list] = {}
                for i, (key, d) in enumerate(zip(_named(part.column("v")), part.column("vec_id").to_pylist())):
                    held = rows.setdefault(key, [i, 0, None])
                    held[1] += 1
                    held[2] = d if held[2] is None else held[2] if d is None else min(held[2], d)
                first, count, least = zip(*rows.values())
                x = matrix(part.column("v").take(pa.array(first)), dims)
                home = np.maximum(2 - 2 * (unit(x) @ pivots.T), 0).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home.astype(np.int32)), pa.array(list(rows), pa.binary()), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array(count, pa.int64()), pa.array(least, pa.int64())],
                    ["cell", "key", "v", "rows", "least"])

    return run


def _blocks(pivots: np.ndarray, radius: float, dims: int, kind: type, size: int):
    """Classes that come cell by cell, in blocks of one cell."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        ids, cell, key, v, count, least = zip(*rows)
        u = unit(np.frombuffer(b"".join(v), dtype=kind).reshape(-1, dims).astype(np.float64))
        reach = {cell[0]}
        for s in range(0, len(u), 2048):
            # A class keeps the cell it was given, also where two pivots are equally near.
            d2 = np.maximum(2 - 2 * (u[s: s + 2048] @ pivots.T), 0)
            reach |= set(np.flatnonzero(_visits(d2, d2[:, cell[0]], pivots, cell[0], radius).any(axis=0)).tolist())
        wrap = lambda values, kind: pa.array([list(values)], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[0]]), pa.array([cell[0]], pa.int32()), wrap(sorted(reach), pa.int32()), wrap(ids, pa.int64()), wrap(key, pa.binary()), wrap(count, pa.int64()), wrap(least, pa.int64()), pa.array([b"".join(v)], pa.binary())],
            ["block", "cell", "reach", "ids", "keys", "rows", "least", "v"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "key", "v", "rows", "least"))):
                if held and (len(held) == size or held[0][1] != row[0]):
                    yield block(held)
                    held = []
                held.append((number, *row))
                number += 1
        if held:
            yield block(held)

    return run


def _visits(d2: np.ndarray, own: np.ndarray, pivots: np.ndarray, home: int, radius: float) -> np.ndarray:
    """Which cells the vectors of cell ``home`` may reach, as in ``borders``."""
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots[home]), 0))
    return d2 - own[:, None] <= 2 * radius * apart + SLACK


class _Met:
    """What a task knows of the vectors it has met: their links, and which of them links connect."""

    def __init__(self):
        self.first: dict[int, int] = {}
        self.ids, self.links, self.root = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.a: list[int] = []
        self.b: list[int] = []

    def places(self, block: int, ids: np.ndarray) -> np.ndarray:
        if block not in self.first:
            n = self.first[block] = len(self.ids)
            self.ids = np.concatenate((self.ids, ids))
            self.links = np.concatenate((self.links, np.zeros(len(ids), dtype=np.int64)))
            self.root = np.concatenate((self.root, np.arange(n, n + len(ids))))
        return self.first[block] + np.arange(len(ids))

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.root[at]
        while (self.root[root] != root).any():
            root = self.root[root]
        self.root[at] = root
        return root

    def connect(self, x: np.ndarray, y: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Notes links enough to connect what the pairs (i, j) connect; ``label`` has the roots of x, then those of y."""
        lx, ly = label[: len(x)], label[len(x):]
        for row in np.unique(i[lx[i] != ly[j]]).tolist():
            near = j[np.searchsorted(i, row): np.searchsorted(i, row, "right")]
            own = lx[row]
            near = near[ly[near] != own]
            new, at = np.unique(ly[near], return_index=True)
            if len(new):
                self.a += [int(self.ids[x[row]])] * len(new)
                self.b += self.ids[y[near[at]]].tolist()
                self.root[new] = own
                label[np.isin(label, new)] = own

    def found(self) -> pa.RecordBatch:
        full = np.flatnonzero(self.links)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((self.ids[full], np.array(self.a, dtype=np.int64)))), pa.array([None] * len(full) + self.b, pa.int64()), pa.array(self.links[full].tolist() + [None] * len(self.a), pa.int64())],
            ["a", "b", "links"])


def _meet(pivots: np.ndarray, radius: float, dims: int, kind: type, cosine: float):
    """Links of each vector over all meetings of a task, and links enough to connect what is connected."""
    doubt = 1.2e-7 * (dims + 8)  # more than a product of unit vectors in single precision may be off

    def side(batch: pa.RecordBatch, r: int, s: str, other: int, met: _Met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors that may reach the other cell, their places and their rows."""
        get = lambda c: batch.column(f"{s}_{c}")[r]
        ids, rows = (get(c).values.to_numpy() for c in ("ids", "rows"))
        at, u = met.places(get("block").as_py(), ids), unit(np.frombuffer(get("v").as_buffer(), dtype=kind).reshape(-1, dims).astype(np.float64))
        cell = get("cell").as_py()
        if cell != other:
            d2 = np.maximum(2 - 2 * (u @ pivots[[cell, other]].T), 0)
            apart = math.sqrt(max(0.0, 2 - 2 * float(pivots[cell] @ pivots[other])))
            some = np.flatnonzero(d2[:, 1] - d2[:, 0] <= 2 * radius * apart + SLACK)
            u, at, rows = u[some], at[some], rows[some]
        return u, at, rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in it:
            for r in range(batch.num_rows):
                cells = [batch.column(f"{s}_cell")[r].as_py() for s in "xy"]
                same = batch.column("x_block")[r] == batch.column("y_block")[r]
                (x, xat, xrows), (y, yat, yrows) = side(batch, r, "x", cells[1], met), side(batch, r, "y", cells[0], met)
                if not len(x) or not len(y):
                    continue
                few, wide, label = x.astype(np.float32), y.astype(np.float32).T, None
                for s in range(0, len(x), 512):
                    likely = few[s: s + 512] @ wide
                    if likely.max() < cosine - doubt and not same:
                        continue
                    some = s + np.flatnonzero(likely.max(axis=1) >= cosine - doubt)
                    near = x[some] @ y.T >= cosine
                    if same:
                        near[np.arange(len(some)), some] = False
                    i, j = np.nonzero(near)
                    i = some[i]
                    if not len(i):
                        continue
                    met.links[xat] += np.bincount(i, yrows[j], len(x)).astype(np.int64)
                    if not same:
                        met.links[yat] += np.bincount(j, xrows[i], len(y)).astype(np.int64)
                    if label is None:
                        label = met.roots(np.concatenate((xat, yat)))
                    met.connect(xat, yat, label, i, j)
        yield met.found()

    return run


def range_join(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two rows link when the cosine of their vectors, in doubles, is at least
    ``cosine``. Vectors that are null, zero, or hold null or non-finite
    components link with nothing. ``component_id`` is the smallest id that
    links reach, the row's own included; ``kept`` says that it is the row's
    own. Shorter vectors are filled up with zeros. Rows that repeat an id stay
    rows of their own and link with each other; a null id is never the
    smallest, unless it is alone, and is not kept. Other columns are not read;
    an empty table gives no rows.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    every = _usable(vectors, vec_id, vector)
    rows = every.filter("v is not null")
    kind = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = dims or 1
    order = F.xxhash64("v")
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))  # a little more than needed, then at most SAMPLE
    chosen = rows.filter(F.pmod(order, F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").distinct().orderBy(order, "v").limit(SAMPLE).toPandas()["v"]
    sample = np.zeros((len(chosen), dims))
    for i, v in enumerate(chosen):
        sample[i, : len(v)] = v
    pivots = choose_pivots(unit(sample), max(1, min(PIVOTS, n // PER_PIVOT)), radius) if len(sample) else np.ones((1, dims)) / math.sqrt(dims)
    # Equal values of a batch are one row before they are moved, so one that a third of all rows hold stays small.
    values = rows.mapInArrow(_locate(pivots, dims, kind), "cell int, key binary, v binary, rows long, least long")
    values = values.repartitionByRange(max(1, -(-n // WRITTEN)), "cell", "key").groupBy("cell", "key", "v").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"))
    blocks = stored(values.sortWithinPartitions("cell", "key").mapInArrow(
        _blocks(pivots, radius, dims, kind, BLOCK), "block long, cell int, reach array<int>, ids array<long>, keys array<binary>, rows array<long>, least array<long>, v binary"), "vectors-blocks")
    found = stored(_pairs(blocks).mapInArrow(_meet(pivots, radius, dims, kind, cosine), "a long, b long, links long"), "vectors-links")
    comp = components(found.filter("b is not null"), label="vectors").toDF("id", "comp")
    links = found.filter("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    classes = blocks.select(F.inline(F.arrays_zip("ids", "keys", "rows", "least"))).toDF("id", "key", "rows", "least")
    done = classes.join(links, "id", "left").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    done = done.filter("rows > 1 or links is not null")
    least = done.groupBy("comp").agg(F.min("least").alias("component_id"))
    done = done.join(least, "comp").select("key", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    return _rows(every, done, n)


def _pairs(blocks: DataFrame) -> DataFrame:
    """Every two blocks of which each may reach the other's cell, once, on one side or the other."""
    x, y = (blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("block", "cell", "reach", "ids", "rows", "v")]) for s in "xy")
    a, b = F.col("x_block"), F.col("y_block")
    turned = F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(2)) == 1
    once = (a == b) | ((a < b) & ~turned) | ((a > b) & turned)
    return x.join(y, once & F.array_contains("x_reach", F.col("y_cell")) & F.array_contains("y_reach", F.col("x_cell"))).drop("x_reach", "y_reach")


def _rows(every: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """One row per input row from the results by value; a value that many rows hold is met in 16 parts."""

    def named(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_named(batch.column("v")), pa.binary())], ["vec_id", "_key"])

    common = [bytes(r["key"]) for r in done.filter(F.col("rows") > n // 64).select("key").collect()] if n >= 64 else []  # at most 64
    hot = lambda key: key.isin(common) if common else F.lit(False)
    salt = F.when(hot(F.col("_key")), F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int")).otherwise(0)
    parts = F.sequence(F.lit(0), F.when(hot(F.col("key")), 15).otherwise(0))
    linked = done.select(F.col("key").alias("_key"), "n_links", "component_id", F.explode(parts).alias("_salt"))
    out = every.mapInArrow(named, "vec_id long, _key binary").withColumn("_salt", salt).join(linked, ["_key", "_salt"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
