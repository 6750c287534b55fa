"""Density clustering, exactly, without comparing a dense region with itself.

Space is cut into cells whose diagonal is ``eps``, so all points of one cell
are neighbours. A cell with ``min_points`` points is dense: all its points are
core, none is noise, and nobody compares them. Only points of the other cells
(fewer than ``min_points`` each) are candidates. A candidate meets

* other candidates near it, at most ``min_points - 1`` per cell, and
* dense cells near it, through their bounding boxes. A box wholly within
  ``eps`` counts with all its points, a box wholly outside with none; a box on
  the edge is settled point by point if it holds few points, and is otherwise
  replaced by the smaller boxes of its points, until it does.

Clusters are components of cells with core points. Two cells are linked as
soon as two of their boxes lie within ``eps`` of each other as a whole; pairs
of boxes on the edge are split as above, and only between cells that nothing
else has joined yet; of two groups of joined cells one link is enough. Points
(or smaller boxes) out of reach of the other box meet nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import components
from gridloom.operators.ordered import number_rows
from gridloom.session import materialize, spread

#: Splits of a box at the most: beyond, its points differ by less than a 64-bit number can say.
LEVELS = 24
LEAF_POINTS = 256
#: Pairs of points of two boxes up to which the points are compared; boxes with more are split.
PAIR_POINTS = 1024
BROADCAST_ROWS = 200_000


def _idx(i: int) -> str:
    return f"_c{i}"


class _Grid:
    """Cell arithmetic for d coordinates."""

    def __init__(self, coords: list[str], eps: float):
        self.coords, self.eps, self.d = list(coords), eps, len(coords)
        self.side = eps / math.sqrt(self.d)
        self.reach = math.ceil(math.sqrt(self.d))  # fine cells per coarse cell side
        self.cells = [_idx(i) for i in range(self.d)]
        self.coarse = [f"_g{i}" for i in range(self.d)]

    def locate(self, df: DataFrame, level: int = 0) -> DataFrame:
        """Add cell numbers; a level splits every side in four."""
        scale = float(4**level)
        return df.withColumns(
            {c: F.floor(F.col(x) / F.lit(self.side) * F.lit(scale)) for c, x in zip(self.cells, self.coords)}
        )

    def coarse_columns(self) -> dict[str, Column]:
        return {g: F.floor(F.col(c) / F.lit(float(self.reach))) for g, c in zip(self.coarse, self.cells)}

    def boxes(self, located: DataFrame) -> DataFrame:
        """Point count and bounding box per cell, combined before the shuffle."""
        return located.groupBy(*self.cells).agg(*self.box_columns())

    def box_columns(self) -> list[Column]:
        return [
            F.count("*").alias("_n"),
            *[F.min(x).alias(f"_lo{i}") for i, x in enumerate(self.coords)],
            *[F.max(x).alias(f"_hi{i}") for i, x in enumerate(self.coords)],
        ]

    def cell_array(self, level: int) -> Column:
        """The cell numbers of ``locate`` as one column."""
        return F.array(*[F.floor(F.col(x) / F.lit(self.side) * F.lit(float(4**level))) for x in self.coords])

    def nearest(self, prefix: str = "p_") -> Column:
        """Squared distance from a probe to the nearest point of a box."""
        gaps = []
        for i in range(self.d):
            p = F.col(f"{prefix}{i}")
            gap = F.greatest(F.col(f"_lo{i}") - p, p - F.col(f"_hi{i}"), F.lit(0.0))
            gaps.append(gap * gap)
        return sum(gaps[1:], gaps[0])

    def farthest(self, prefix: str = "p_") -> Column:
        """Squared distance from a probe to the farthest corner of a box."""
        spans = []
        for i in range(self.d):
            p = F.col(f"{prefix}{i}")
            span = F.greatest(F.abs(p - F.col(f"_lo{i}")), F.abs(p - F.col(f"_hi{i}")))
            spans.append(span * span)
        return sum(spans[1:], spans[0])

    def distance(self, prefix: str = "p_") -> Column:
        """Squared distance from a probe to a point."""
        parts = [(F.col(f"{prefix}{i}") - F.col(x)) * (F.col(f"{prefix}{i}") - F.col(x)) for i, x in enumerate(self.coords)]
        return sum(parts[1:], parts[0])

    def as_probes(self, points: DataFrame, key: str) -> DataFrame:
        """Points as probes of their own coarse cell."""
        return points.select(
            F.col(key).alias("p_key"), *[F.col(x).alias(f"p_{i}") for i, x in enumerate(self.coords)], *self.cells
        ).withColumns(self.coarse_columns()).drop(*self.cells)

    def probes(self, points: DataFrame, key: str) -> DataFrame:
        """One row per coarse cell the eps-ball of a point may touch.

        Dimension after dimension, moves whose summed gap exceeds eps are cut.
        """
        width = self.side * self.reach
        out = self.as_probes(points, key).withColumn("_room", F.lit(self.eps**2 * (1 + 1e-9)))
        for i, g in enumerate(self.coarse):
            at = F.col(f"p_{i}") - F.col(g) * width
            moves = F.array(
                F.struct(F.lit(-1).alias("m"), (at * at).alias("cost")),
                F.struct(F.lit(0).alias("m"), F.lit(0.0).alias("cost")),
                F.struct(F.lit(1).alias("m"), ((F.lit(width) - at) * (F.lit(width) - at)).alias("cost")),
            )
            out = (
                out.withColumn("_m", F.explode(moves))
                .filter(F.col("_m")["cost"] <= F.col("_room"))
                .withColumns({g: F.col(g) + F.col("_m")["m"], "_room": F.col("_room") - F.col("_m")["cost"]})
                .drop("_m")
            )
        return out.drop("_room")

    def box_probes(self, boxes: DataFrame) -> DataFrame:
        """One row per coarse cell that points within eps of a box ``_lo<i>a`` to ``_hi<i>a`` may lie in."""
        width = self.side * self.reach
        out = boxes.withColumn("_room", F.lit(self.eps**2 * (1 + 1e-9)))
        for i, g in enumerate(self.coarse):
            back, on = F.col(f"_lo{i}a") - F.col(g) * width, (F.col(g) + 1) * width - F.col(f"_hi{i}a")
            moves = F.array(*[F.struct(F.lit(m).alias("m"), cost.alias("cost")) for m, cost in ((-1, back * back), (0, F.lit(0.0)), (1, on * on))])
            out = out.withColumn("_m", F.explode(moves)).filter(F.col("_m")["cost"] <= F.col("_room"))
            out = out.withColumns({g: F.col(g) + F.col("_m")["m"], "_room": F.col("_room") - F.col("_m")["cost"]}).drop("_m")
        return out.drop("_room")


@dataclass
class _Judged:
    """All points; those of cells that are not dense; which of these are core at sight; the others with what they were found to be."""

    grid: _Grid
    points: DataFrame
    candidates: DataFrame
    settled: DataFrame
    judged: DataFrame


def _judge(df: DataFrame, key: str, coords: list[str], eps: float, min_points: int) -> _Judged:
    """Tells core points from others; a point of a dense cell is core without a comparison."""
    grid = _Grid(coords, eps)
    points = materialize(grid.locate(df.select(key, *coords)), "density-points")
    cells = grid.boxes(points).withColumns(grid.coarse_columns())
    dense = materialize(cells.filter(F.col("_n") >= min_points), "density-cells")

    # Every task passes on at most min_points rows of a cell, so a hot cell
    # stays small; a cell that shows fewer rows has shown all of them.
    in_cell = Window.partitionBy(*grid.cells)
    few = (
        points.withColumn("_r", F.row_number().over(in_cell.orderBy(key)))
        .filter(F.col("_r") <= min_points)
        .withColumn("_shown", F.max("_r").over(in_cell))
    )
    candidates = materialize(
        few.filter(F.col("_shown") < min_points).drop("_r", "_shown").withColumns(grid.coarse_columns()),
        "density-candidates",
    )
    candidates = spread(candidates)
    limit = F.lit(eps * eps)
    targets = candidates.drop(*grid.cells)

    # Most rows prove core inside their own coarse cell; only the others look around.
    own = grid.as_probes(candidates, key)
    settled = materialize(_pairs(own, targets, grid, limit).filter(F.col("_sparse") >= min_points), "density-settled")
    rest = spread(materialize(_without(candidates, settled, key), "density-rest"))
    from_sparse = materialize(_pairs(grid.probes(rest, key), targets, grid, limit), "density-sparse")
    unsure = _without(rest, from_sparse.filter(F.col("_sparse") >= min_points), key)
    unsure = spread(materialize(unsure, "density-unsure"))
    met = _met(points, dense.withColumn("_node", F.lit(0)), grid.probes(unsure, key), grid, key, limit)
    from_dense = met.groupBy("p_key").agg(F.sum("_n").alias("_dense"))
    judged = materialize(
        rest.join(from_sparse, F.col(key) == from_sparse["p_key"], "left").drop("p_key")
        .join(from_dense, F.col(key) == from_dense["p_key"], "left").drop("p_key")
        .withColumn("_dense", F.coalesce("_dense", F.lit(0).cast("long")))
        .withColumn("_core", F.coalesce("_sparse", F.lit(0).cast("long")) + F.col("_dense") >= min_points),
        "density-judged",
    )
    return _Judged(grid, points, candidates, settled, judged)


def noise_points(df: DataFrame, key: str, coords: list[str], eps: float, min_points: int) -> DataFrame:
    """Keys of the rows that are neither core nor within ``eps`` of a core row.

    A row counts itself among its neighbours; ``key`` is unique.
    """
    found = _judge(df, key, coords, eps, min_points)
    grid, limit = found.grid, F.lit(eps * eps)
    by_own_cell = found.candidates.join(found.settled, F.col(key) == F.col("p_key"), "left_semi").select(*grid.coarse, *coords)
    core = by_own_cell.unionByName(found.judged.filter("_core").select(*grid.coarse, *coords))
    open_ = found.judged.filter(~F.col("_core") & (F.col("_dense") == 0)).select(key, *coords, *grid.cells)
    reached = grid.probes(open_, key).join(core, list(grid.coarse)).filter(grid.distance() <= limit)
    return open_.select(key).join(reached.select(F.col("p_key").alias(key)).distinct(), key, "left_anti")


def clusters(df: DataFrame, key: str, coords: list[str], eps: float, min_points: int) -> DataFrame:
    """(key, cluster): the number of each row's cluster, -1 for noise.

    Clusters are numbered from 0 by their smallest core key. A row that is not
    core but within ``eps`` of core rows of several clusters belongs to the one
    with the smallest number. ``key`` is a unique integer.
    """
    found = _judge(df, key, coords, eps, min_points)
    grid, limit = found.grid, F.lit(eps * eps)
    others = found.judged.filter(~F.col("_core")).select(key, *coords, *grid.cells)
    core = found.points.join(others.select(key), key, "left_anti")
    nodes = core.groupBy(*grid.cells).agg(F.min(key).alias("_node"), *grid.box_columns()).withColumns(grid.coarse_columns())
    nodes = materialize(nodes, "density-nodes")
    core = materialize(core.join(_small(nodes.select(*grid.cells, "_node")), grid.cells).select(key, *coords, "_node"), "density-core")
    linked = components(_core_links(nodes, core, grid, limit, key), "density")
    named = nodes.select("_node").join(linked.toDF("_node", "_root"), "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    named = materialize(named, "density-roots")
    numbered = number_rows(named.select("_root").distinct(), ["_root"], "cluster")
    named = materialize(named.join(_small(numbered), "_root").select("_node", "cluster"), "density-clusters")
    inner = core.join(_small(named), "_node").select(key, "cluster")
    met = _met(core.select(key, *coords), nodes.drop(*grid.coarse).withColumns(grid.coarse_columns()), grid.probes(others, key), grid, key, limit)
    border = met.select("p_key", "_node").distinct().join(_small(named), "_node").groupBy("p_key").agg(F.min("cluster").alias("cluster"))
    outer = others.select(key).join(border, F.col(key) == F.col("p_key"), "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return inner.union(outer)


def _core_links(nodes: DataFrame, core: DataFrame, grid: _Grid, limit: Column, key: str) -> DataFrame:
    """Links (a, b) of cells with two core points within eps of each other; enough of them to join all that are joined."""
    lows, highs = [f"_lo{i}" for i in range(grid.d)], [f"_hi{i}" for i in range(grid.d)]

    def side(boxes: DataFrame, name: str, *more: str) -> DataFrame:
        return boxes.select(F.col("_node").alias(name), F.col("_n").alias(f"_n{name}"), F.col("_cell").alias(f"_cell{name}"),
                            *[F.col(c).alias(f"{c}{name}") for c in (*lows, *highs)], *more)

    near = sum([_square(F.greatest(F.col(f"_lo{i}b") - F.col(f"_hi{i}a"), F.col(f"_lo{i}a") - F.col(f"_hi{i}b"), F.lit(0.0))) for i in range(grid.d)], F.lit(0.0))
    far = sum([_square(F.greatest(F.abs(F.col(f"_hi{i}a") - F.col(f"_lo{i}b")), F.abs(F.col(f"_hi{i}b") - F.col(f"_lo{i}a")))) for i in range(grid.d)], F.lit(0.0))
    boxes = nodes.withColumn("_cell", F.array(*grid.cells))
    met = grid.box_probes(side(boxes, "a", *grid.coarse)).join(side(boxes, "b", *grid.coarse), grid.coarse).filter("a < b")
    met = materialize(met.filter(near <= limit).select(*[c for c in met.columns if c not in grid.coarse], (far <= limit).alias("_inside")), "density-met")
    links = met.filter("_inside").select("a", "b")
    edge = met.filter(~F.col("_inside"))
    if edge.isEmpty():
        return links
    # Cells that are joined by now need no closer look, and of two groups of joined cells one link is enough.
    root, groups = components(links, "density-first"), ["_ra", "_rb"]
    for name in "ab":
        edge = edge.join(_small(root.toDF(name, f"_root{name}")), name, "left").withColumn(f"_root{name}", F.coalesce(f"_root{name}", name))
    edge = edge.withColumns({"_ra": F.least("_roota", "_rootb"), "_rb": F.greatest("_roota", "_rootb")})
    edge = materialize(edge.filter("_roota <> _rootb").drop("_roota", "_rootb", "_inside"), "density-edge")
    apart = sum([_square(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in grid.coords], F.lit(0.0))
    cells = ["_cella", "_cellb"]

    for level in range(LEVELS + 1):
        few = edge.filter(F.col("_na") * F.col("_nb") <= PAIR_POINTS) if level < LEVELS else edge
        located = core.withColumn("_cell", grid.cell_array(level))
        own, gap = {}, {}
        for n, other in ("ab", "ba"):
            own[n] = located.select(F.col("_node").alias(n), F.col("_cell").alias(f"_cell{n}"), *[F.col(c).alias(f"{c}_{n}") for c in grid.coords])
            gap[n] = sum([_square(F.greatest(F.col(f"_lo{i}{other}") - F.col(f"{c}_{n}"), F.col(f"{c}_{n}") - F.col(f"_hi{i}{other}"), F.lit(0.0)))
                          for i, c in enumerate(grid.coords)], F.lit(0.0))
        # Points out of reach of the other's box are left out before any two points meet.
        parts = {n: few.join(own[n], [n, f"_cell{n}"]).filter(gap[n] <= limit).select("a", "b", *cells, *(groups if n == "a" else []), *[f"{c}_{n}" for c in grid.coords]) for n in "ab"}
        both = parts["a"].join(parts["b"], ["a", "b", *cells])
        found = materialize(both.filter(apart <= limit).select("a", "b", *groups).distinct(), f"density-near-{level}")
        links = links.union(found.select("a", "b"))
        edge = edge.filter(F.col("_na") * F.col("_nb") > PAIR_POINTS).join(found.select(*groups).distinct(), groups, "left_anti")
        if level == LEVELS or edge.isEmpty():
            break
        wanted = edge.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
        finer = core.join(_small(wanted), "_node", "left_semi").withColumn("_cell", grid.cell_array(level + 1))
        finer = finer.groupBy("_node", "_cell").agg(*grid.box_columns())
        finer = materialize(finer.withColumn("_parent", F.transform("_cell", lambda c: F.floor(c / 4))), f"density-finer-{level}")
        own = {n: side(finer, n, F.col("_parent").alias(f"_p{n}")).withColumnsRenamed({f"_cell{n}": f"_own{n}", f"_p{n}": f"_cell{n}"}) for n in "ab"}
        pairs = {n: edge.select("a", "b", *cells, *groups, *[f"{c}{other}" for c in (*lows, *highs)]) for n, other in ("ab", "ba")}
        parts = {n: pairs[n].join(own[n], [n, f"_cell{n}"]).filter(near <= limit).select("a", "b", *cells, *(groups if n == "a" else []), *[c for c in own[n].columns if c not in (n, f"_cell{n}")]) for n in "ab"}
        met = parts["a"].join(parts["b"], ["a", "b", *cells]).filter(near <= limit).drop(*cells).withColumnsRenamed({"_owna": "_cella", "_ownb": "_cellb"})
        met = materialize(met.withColumn("_inside", far <= limit), f"density-split-{level}")
        sure = met.filter("_inside").select("a", "b", *groups).distinct()
        links = links.union(sure.select("a", "b"))
        edge = materialize(met.filter(~F.col("_inside")).drop("_inside").join(sure.select(*groups).distinct(), groups, "left_anti"), f"density-open-{level}")
    return links


def _square(x: Column) -> Column:
    return x * x


def _pairs(probes: DataFrame, targets: DataFrame, grid: _Grid, limit: Column) -> DataFrame:
    """Number of targets within eps of each probe."""
    near = probes.join(targets, list(grid.coarse)).filter(grid.distance() <= limit)
    return near.groupBy("p_key").agg(F.count("*").alias("_sparse"))


def _without(points: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return points.join(keys, F.col(key) == F.col("p_key"), "left_anti")


def _met(points, cells, probes, grid, key, limit) -> DataFrame:
    """(p_key, _node, _n): numbers of points within eps of each probe, in parts, with the ``_node`` of their cell."""
    p = ["p_key"] + [f"p_{i}" for i in range(grid.d)] + ["_node"]
    box = [f"_h{i}" for i in range(grid.d)]  # cell numbers of a box on its level
    met = probes.join(cells.withColumnsRenamed(dict(zip(grid.cells, box))), list(grid.coarse))
    counted = []
    for level in range(LEVELS + 1):
        met = met.filter(grid.nearest() <= limit).select(*p, *box, "_n", (grid.farthest() <= limit).alias("_inside"))
        met = materialize(met, f"density-boxes-{level}")
        counted.append(met.filter("_inside").select("p_key", "_node", "_n"))
        edge = met.filter(~F.col("_inside"))
        # Small boxes are settled point by point, and so is what the last level leaves.
        few = edge.filter(F.col("_n") <= LEAF_POINTS) if level < LEVELS else edge
        located = grid.locate(points.select(key, *grid.coords), level).withColumnsRenamed(dict(zip(grid.cells, box)))
        hits = located.join(_small(few.select(*p, *box)), box).filter(grid.distance() <= limit)
        counted.append(hits.groupBy("p_key", "_node").agg(F.count("*").alias("_n")))
        edge = edge.filter(F.col("_n") > LEAF_POINTS).select(*p, *box)
        if level == LEVELS or edge.isEmpty():
            break
        parent = {b: F.floor(F.col(c) / 4) for b, c in zip(box, grid.cells)}
        finer = grid.locate(points.select(key, *grid.coords), level + 1).withColumns(parent)
        finer = grid.boxes(finer.join(_small(edge.select(*box).distinct()), box, "left_semi")).withColumns(parent)
        met = edge.join(finer, box).drop(*box).withColumnsRenamed(dict(zip(grid.cells, box)))
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


def _small(df: DataFrame) -> DataFrame:
    """Mark a counted small table for broadcast."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

