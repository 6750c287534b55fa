"""Merkle manifest of a dataset: an append log of nodes in postorder, and proofs cut from it.

Rows are leaves; each part of the table (a source) is a tree of runs of 16, and
the roots of the parts, in order, form one more tree. Builders take aligned
blocks of 16^3 nodes and append a node as soon as its children are there, so
the log is a postorder. A node's position in it follows from the sizes of the
subtrees before it alone (`position`): a proof addresses its siblings by
arithmetic, reads one contiguous segment of the log per block, and takes what
lies above the block from the proof of the block's own root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import stored
from gridloom.operators.ordered import number_rows
from gridloom.session import small

#: Children of a node, as a power of two, and levels that one builder completes.
FAN_BITS, LEVELS = 4, 3
FAN, BLOCK_BITS = 1 << FAN_BITS, FAN_BITS * LEVELS
#: Proofs handed on at once.
PROOFS = 512

_LOG = "tree long, n long, level int, place long, pos long, node binary"
_STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(columns: list[str | Column]) -> Column:
    """Hex digest of a row: each value as its UTF-8 length, a colon and itself; ``-`` for null."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return sum([(n > F.lit(1 << FAN_BITS * k)).cast("int") for k in range(1, 15)], (n > 1).cast("int"))


def _height(n: int) -> int:
    h = 0
    while 1 << FAN_BITS * h < n:
        h += 1
    return h


def position(level: int, place: np.ndarray, n: int) -> np.ndarray:
    """Places in the log of the nodes ``place`` of a level, in a tree of ``n`` leaves.

    A node is written after its last leaf, after all nodes that were complete
    before that leaf, and after the nodes between: with e the number of the
    last leaf, e leaves and e // 16^k nodes of each level k come first.
    """
    e = np.minimum((place + 1) << FAN_BITS * level, n) - 1
    out = e + level
    for k in range(1, _height(n) + 1):
        out = out + (e >> FAN_BITS * k)
    return out


def _groups(it: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (integers without nulls), whole, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _parents(nodes: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(nodes[i: i + FAN])).hexdigest().encode() for i in range(0, len(nodes), FAN)]


def _builder(base: int):
    """Builds blocks of nodes of level ``base``; rows come sorted by tree and place."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(it, "tree", "block"):
            tree, n, first = (block.column(c)[0].as_py() for c in ("tree", "n", "place"))
            nodes = [x.hex().encode() for x in block.column("node").to_pylist()]
            levels, places, positions, digests = [], [], [], []
            for i in range(min(LEVELS, _height(n) - base) + 1):
                if i:
                    nodes = _parents(nodes)
                if i or not base:  # lower builders have written the nodes of a higher base
                    at = np.arange(first >> FAN_BITS * i, (first >> FAN_BITS * i) + len(nodes), dtype=np.int64)
                    levels.append(np.full(len(nodes), base + i, dtype=np.int32))
                    places.append(at)
                    positions.append(position(base + i, at, n))
                    digests += [bytes.fromhex(x.decode()) for x in nodes]
            pos = np.concatenate(positions)
            order = np.argsort(pos, kind="stable")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(pos), tree)), pa.array(np.full(len(pos), n)), pa.array(np.concatenate(levels)[order]),
                pa.array(np.concatenate(places)[order]), pa.array(pos[order]), pa.array([digests[k] for k in order.tolist()], pa.binary())],
                ["tree", "n", "level", "place", "pos", "node"])

    return build


def append_log(leaves: DataFrame, label: str = "log") -> list[DataFrame]:
    """The nodes of all trees, one stored table per three levels, the lowest first.

    ``leaves``: tree, n (leaves of the tree), place (from 0), node (digest as
    bytes). Blocks of 16^3 nodes are dealt over the tasks, so a tree of any
    size is built by many; each further table has 16^3 times fewer rows.
    """
    log: list[DataFrame] = []
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("tree", "n", "place", "node")
    while not log or 1 << BLOCK_BITS * len(log) < most:
        block = F.shiftright("place", BLOCK_BITS)
        dealt = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        log.append(stored(dealt.mapInArrow(_builder(LEVELS * len(log)), _LOG), f"manifest-{label}-{len(log)}"))
        top = LEVELS * len(log)
        nodes = log[-1].filter((F.col("level") == top) & (height(F.col("n")) > top)).select("tree", "n", "place", "node")
    return log


def roots(log: list[DataFrame]) -> DataFrame:
    """(tree, n, node) of each tree's last node."""
    out = [t.filter((F.col("place") == 0) & (F.col("level") == height(F.col("n")))).select("tree", "n", "node") for t in log]
    whole = out[0]
    for t in out[1:]:
        whole = whole.union(t)
    return whole


def _cutter(base: int):
    """Cuts proofs from the segments of blocks of nodes of level ``base``."""

    def rows(found: list[tuple], tree: int, claims: pa.Array) -> pa.RecordBatch:
        places, steps, subroot = zip(*found)
        flat = [s for x in steps for s in x]
        struct = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.string()), pa.array([b for _, b in flat], pa.string())], fields=list(_STEP))
        ends = np.cumsum([0, *map(len, steps)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(places), tree)), pa.array(places, pa.int64()), claims, pa.ListArray.from_arrays(pa.array(ends), struct), pa.array(subroot, pa.string())],
            ["tree", "place", "claim", "proof", "subroot"])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(it, "tree", "block"):
            kind = block.column("kind").to_numpy()
            a, b = np.searchsorted(kind, [1, 2])
            if b == len(kind) or a == b:
                continue  # no claims, or claims on leaves that are not there
            tree, number, n = block.column("tree")[0].as_py(), block.column("block")[0].as_py(), block.column("n")[int(a)].as_py()
            above = [(s["left"], s["right"]) for s in block.column("proof")[0].as_py()] if a else []
            # The nodes of this level and above are a tree of their own, and the block's are one run of
            # its postorder: each is found by its position.
            m = ((n - 1) >> FAN_BITS * base) + 1
            origin = int(position(0, np.array([number << BLOCK_BITS]), m)[0])
            segment = [x.hex() for x in block.column("node").slice(a, b - a).to_pylist()]
            levels = min(LEVELS, _height(m))
            runs: list[list[str]] = []
            for i in range(levels):
                first = number << FAN_BITS * (LEVELS - i)
                at = np.arange(first, min(first + (1 << FAN_BITS * (LEVELS - i)), ((m - 1) >> FAN_BITS * i) + 1), dtype=np.int64)
                row = [segment[p] for p in (position(i, at, m) - origin).tolist()]
                runs.append(["".join(row[k: k + FAN]) for k in range(0, len(row), FAN)])
            subroot = block.column("subroot")[0].as_py() if a else segment[-1]
            asked = block.slice(b, int(np.searchsorted(block.column("at").slice(b).to_numpy(), m)))  # others are not there
            for start in range(0, asked.num_rows, PROOFS):
                some = asked.slice(start, PROOFS)
                found = []
                for p in some.column("at").to_pylist():
                    steps = []
                    for i in range(levels):
                        run = runs[i][(p & ((1 << BLOCK_BITS) - 1)) >> FAN_BITS * (i + 1)]
                        q = 64 * ((p >> FAN_BITS * i) & (FAN - 1))
                        steps.append((run[:q], run[q + 64:]))
                    found.append((p, steps + above, subroot))
                yield rows(found, tree, some.column("claim").combine_chunks())

    return cut


def prove(log: list[DataFrame], claims: DataFrame, upper: DataFrame | None = None) -> DataFrame:
    """Adds ``proof`` (steps: the digests to the left and right in each run, as hex, lowest first) and ``subroot`` to ``claims``.

    ``claims``: tree, place and any other columns, any part of the leaves, also
    repeatedly; a place that is not there gives no row. ``upper``: tree, n, proof
    and subroot that each tree's proofs go on with. Only blocks with claims are
    looked at.
    """
    names = [c for c in claims.columns if c not in ("tree", "place")]
    packed = claims.select("tree", "place", F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")]).alias("claim"))
    return _prove(log, 0, packed, upper).select("tree", "place", *[F.col("claim")[c].alias(c) for c in names], "proof", "subroot")


def _prove(log: list[DataFrame], tier: int, claims: DataFrame, upper: DataFrame | None) -> DataFrame:
    base = LEVELS * tier
    kind, none = claims.schema["claim"].dataType, lambda t: F.lit(None).cast(t)
    block = F.shiftright("place", BLOCK_BITS)
    wanted = claims.select("tree", block.alias("block")).distinct()
    # A block's nodes: of each level as many places as its share of the block.
    home = F.coalesce(*[F.when(F.col("level") == base + i, F.shiftright("place", FAN_BITS * (LEVELS - i))) for i in range(LEVELS)], F.col("place"))
    segment = log[tier] if not tier else log[tier].union(log[tier - 1].filter((F.col("level") == base) & (height(F.col("n")) > base)))
    nodes = segment.select("tree", home.alias("block"), F.lit(1).alias("kind"), F.col("pos").alias("at"), "n", "node",
                           none(_STEPS).alias("proof"), none("string").alias("subroot"), none(kind).alias("claim"))
    asked = claims.select("tree", block.alias("block"), F.lit(2).alias("kind"), F.col("place").alias("at"), none("long").alias("n"), none("binary").alias("node"),
                          none(_STEPS).alias("proof"), none("string").alias("subroot"), "claim")
    rows = nodes.join(wanted, ["tree", "block"], "left_semi").union(asked)
    paths = []
    if upper is not None:  # of trees that end in this table
        paths.append(upper.filter(F.greatest(F.lit(0), F.ceil(height(F.col("n")) / LEVELS) - 1) == tier).select("tree", F.lit(0).cast("long").alias("place"), "proof", "subroot"))
    if tier + 1 < len(log):
        higher = wanted.select("tree", F.col("block").alias("place"), F.struct(F.lit(0).alias("none")).alias("claim"))
        paths.append(_prove(log, tier + 1, higher, upper).select("tree", "place", "proof", "subroot"))
    for path in paths:
        rows = rows.union(path.select("tree", F.col("place").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), none("long").alias("n"),
                                      none("binary").alias("node"), "proof", "subroot", none(kind).alias("claim")))
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at")
    out = T.StructType([T.StructField("tree", T.LongType()), T.StructField("place", T.LongType()), T.StructField("claim", kind),
                        T.StructField("proof", _STEPS), T.StructField("subroot", T.StringType())])
    return dealt.mapInArrow(_cutter(base), out)


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf (hex) and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


@dataclass(frozen=True)
class Manifest:
    """Log of the parts and of the tree above them; ``members``: tree, place, n, leaf and the carried columns of each row."""

    log: list[DataFrame]
    top: list[DataFrame]
    parts: DataFrame
    members: DataFrame
    root: str | None

    def upper(self) -> DataFrame:
        """tree, n, proof, subroot: how each part's root leads to the root."""
        claims = self.parts.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("n").alias("leaves"), F.lower(F.hex("node")).alias("part"))
        return prove(self.top, claims).select(F.col("place").alias("tree"), F.col("leaves").alias("n"), "proof", F.col("part").alias("subroot"))

    def prove(self, claims: DataFrame) -> DataFrame:
        """Proofs up to the root for claims by tree and place."""
        return prove(self.log, claims, self.upper())


def build(rows: DataFrame, columns: list[str], key: str = "doc_id", part: str = "source", carry: dict[str, Column] | None = None) -> Manifest:
    """Manifest of a table: a leaf per row, ascending by ``key`` in its part, parts by value (null first).

    Null values and a null key or part count as such; rows with equal keys are
    ordered by digest, so repeated rows give the same manifest in any order. An
    empty table has no root. Other columns play no part and their names cannot
    clash; ``carry`` names columns that ``members`` keeps of each row.
    """
    carry = carry or {}
    leaves = rows.select(F.col(f"`{part}`").alias("part"), F.col(f"`{key}`").alias("key"), F.unhex(digest(columns)).alias("leaf"),
                         F.struct(*[c.alias(name) for name, c in carry.items()] or [F.lit(0).alias("none")]).alias("carried"))
    # A part with a third of the rows is spread by its keys.
    numbered = number_rows(leaves, ["part", "key", "leaf"], "at")
    parts = stored(numbered.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "manifest-parts")
    parts = number_rows(parts, ["first"], "tree")
    joined = numbered.alias("r").join(small(parts).alias("p"), F.col("r.part").eqNullSafe(F.col("p.part")))
    members = stored(joined.select("tree", (F.col("at") - F.col("first")).alias("place"), "n", "leaf", "carried"), "manifest-members")
    log = append_log(members.select("tree", "n", "place", F.col("leaf").alias("node")))
    ends = stored(roots(log), "manifest-subroots")
    count = ends.count()
    top = append_log(ends.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("place"), "node"), "top")
    root = roots(top).select(F.lower(F.hex("node"))).first()
    names = [F.col(f"carried.`{c}`").alias(c) for c in carry]
    return Manifest(log, top, ends, members.select("tree", "place", "n", F.lower(F.hex("leaf")).alias("leaf"), *names), root[0] if root else None)
