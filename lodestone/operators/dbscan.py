"""DBSCAN (Ester et al. 1996) over cells so small that the points of one are all neighbours.

Cells have a diagonal below eps (Gan and Tao 2015), so a cell with enough points needs no look at them: all are core
points of one cluster. Every other question, how many points lie near a point or whether two cells hold core points
within eps, is first asked of boxes: a box wholly within eps, or wholly beyond, answers for all its points. Points of
undecided boxes are listed only where they are few; large boxes are halved along every feature until they are decided.
Equal points are one, with a weight, and what is listed of a full cell is dealt out by a second key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import squared_distance
from ..functions.scratch import Scratch
from .graph import components
from .prepare import attach_labels, standardise

GRID_FEATURES = 3  # those of widest range; 27 coarse cells meet, other features only filter
LISTED = 4096  # pairs of points of two boxes that are compared one by one
FEW = 64  # points of a box that are looked at one by one for a count
DEALT = 10_000  # points of a cell under one key
SLACK = 1 + 1e-9  # boxes decide only what rounding cannot change


def _gap2(a: str, b: str, d: int) -> Column:
    """Squared distance of two boxes; a box has the columns {name}l0, {name}h0, {name}l1, ..."""
    parts = [F.greatest(F.lit(0.0), F.col(f"{b}l{j}") - F.col(f"{a}h{j}"), F.col(f"{a}l{j}") - F.col(f"{b}h{j}")) for j in range(d)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _span2(a: str, b: str, d: int) -> Column:
    """Squared distance of the points of two boxes that are farthest apart."""
    parts = [F.greatest(F.col(f"{b}h{j}") - F.col(f"{a}l{j}"), F.col(f"{a}h{j}") - F.col(f"{b}l{j}")) for j in range(d)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _box(d: int) -> list[Column]:
    return [f(f"x{j}").alias(f"{k}{j}") for j in range(d) for k, f in (("l", F.min), ("h", F.max))]


def _named(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


class _Grid:
    """Points (id, x0, x1, ..., w, cell), w rows each, and boxes of their cells."""

    def __init__(self, points: DataFrame, d: int, eps: float, scratch: Scratch):
        self.d, self.eps, self.scratch = d, eps, scratch
        self.side = eps / math.sqrt(d) * (1 - 1e-6)
        self.x = [f"x{j}" for j in range(d)]
        self.box = [f"{k}{j}" for j in range(d) for k in "lh"]
        self.points = scratch.table(points.withColumn("cell", self.cell(0)), "points")
        self.cells = scratch.table(self.points.groupBy("cell").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), *_box(d)), "cells")

    def cell(self, level: int) -> Column:
        """Cells of level k have sides halved k times; halving is exact, so they lie within those of the level before."""
        return F.array(*[F.floor(F.col(x) / F.lit(self.side / 2**level)) for x in self.x])

    def near(self, a: str, b: str) -> Column:
        return _gap2(a, b, self.d) <= F.lit(self.eps**2 * SLACK)

    def whole(self, a: str, b: str) -> Column:
        return _span2(a, b, self.d) <= F.lit(self.eps**2 / SLACK)

    def exact(self, a: str, b: str) -> Column:
        at = lambda p: [F.col(f"{p}{x}") for x in self.x]
        return F.sqrt(squared_distance(at(a), at(b))) <= F.lit(self.eps)

    def adjoining(self) -> DataFrame:
        """(acell, bcell, and b's n, m and box): pairs of different cells whose boxes lie within eps, both ways.

        Cells meet by the coarse cell of their lower corners, of side eps + side, in the features of widest range.
        """
        ranges = self.cells.agg(*[(F.max(f"h{j}") - F.min(f"l{j}")).alias(f"r{j}") for j in range(self.d)]).first()
        chosen = sorted(range(self.d), key=lambda j: (-(ranges[f"r{j}"] or 0), j))[:GRID_FEATURES]
        coarse = [F.floor(F.col(f"l{j}") / F.lit(self.eps + self.side)).alias(f"g{j}") for j in chosen]
        b = _named(self.cells.select("*", *coarse), "b", ["cell", "n", "m", *self.box, *[f"g{j}" for j in chosen]])
        a = _named(self.cells.select("*", *coarse), "a", ["cell", *self.box, *[f"g{j}" for j in chosen]])
        for j in chosen:
            a = a.withColumn(f"bg{j}", F.explode(F.sequence(F.col(f"ag{j}") - 1, F.col(f"ag{j}") + 1)))
        met = a.join(b, [f"bg{j}" for j in chosen]).where((F.col("acell") != F.col("bcell")) & self.near("a", "b"))
        return self.scratch.table(met.select("acell", "bcell", "bn", "bm", *[f"b{c}" for c in self.box]), "adjoining")

    def asked(self, points: DataFrame, pairs: DataFrame) -> DataFrame:
        """points (aid, acell, ax0, ...) by the boxes near their cell, each point a box of its own; boxes beyond eps go."""
        own = points.select("*", *[F.col(f"ax{j}").alias(f"a{k}{j}") for j in range(self.d) for k in "lh"])
        return own.join(pairs, "acell").where(self.near("a", "b"))

    def listed(self, asked: DataFrame, points: DataFrame) -> DataFrame:
        """asked by the points (bid, bx0, ..., bw, bcell, bm) of its cell within eps; full cells are dealt out by a second key."""
        keys = lambda m: F.ceil(F.col(m) / DEALT)
        left = asked.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), keys("bm") - 1))).drop("bm")
        right = points.withColumn("deal", F.pmod(F.xxhash64("bid"), keys("bm"))).drop("bm")
        return left.join(right, ["bcell", "deal"]).where(self.exact("a", "b"))


def _around(grid: _Grid, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, around): how many rows of other cells lie within eps of each of the points (aid, acell, ax0, ...).

    Boxes wholly near count as they are, small ones by their points; what is large and undecided is halved and asked again,
    so a point meets only boxes that its circle cuts, however full the cells are.
    """
    scratch, d, counted = grid.scratch, grid.d, []
    point = ["aid", *[f"a{x}" for x in grid.x]]
    ask = grid.asked(points, pairs).select(*point, "bcell", "bn", "bm", grid.whole("a", "b").alias("whole"))
    ask, level, key = scratch.table(ask, "asked"), 0, ["cell"]
    while True:
        counted.append(ask.where("whole").select("aid", F.col("bn").alias("w")))
        open_, few = ask.where("not whole"), F.col("bm") <= FEW
        side = grid.points.select(*grid.x, "w", "cell", *([grid.cell(level).alias("sub")] if level else []))
        listed = open_.where(few).select(*point, *[f"b{k}" for k in key]).join(_named(side, "b", [*key, "w", *grid.x]), [f"b{k}" for k in key])
        counted.append(listed.where(grid.exact("a", "b")).select("aid", F.col("bw").alias("w")))
        todo = open_.where(~few).select(*point, *[f"b{k}" for k in key])
        if todo.isEmpty():
            break
        level += 1
        halves = grid.points.join(todo.select(F.col("bcell").alias("cell")).distinct(), "cell", "left_semi").withColumn("sub", grid.cell(level))
        halves = halves.groupBy("cell", "sub").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), *_box(d))
        halves = halves.withColumn("within", F.transform("sub", lambda s: F.floor(s / 2)))
        of = _named(halves, "b", ["cell", "sub", "within", "n", "m", *grid.box])
        todo = todo.withColumnRenamed("bsub", "bwithin").join(of, ["bcell", *(["bwithin"] if level > 1 else [])])
        todo = todo.select("*", *[F.col(f"ax{j}").alias(f"a{k}{j}") for j in range(d) for k in "lh"])
        ask = todo.where(grid.near("a", "b")).select(*point, "bcell", "bsub", "bn", "bm", grid.whole("a", "b").alias("whole"))
        ask, key = scratch.table(ask, "asked"), ["cell", "sub"]
    out = counted[0]
    for c in counted[1:]:
        out = out.union(c)
    return out.groupBy(F.col("aid").alias("id")).agg(F.sum("w").alias("around"))


def _core_ids(grid: _Grid, pairs: DataFrame, min_samples: int) -> DataFrame:
    """The points with is_core: all of full cells, others if they and what is around add up to min_samples."""
    sized = grid.points.join(grid.cells.select("cell", "n"), "cell")
    counted = _around(grid, _named(sized.where(F.col("n") < min_samples), "a", ["id", "cell", *grid.x]), pairs)
    out = sized.join(counted, "id", "left")
    out = out.select("id", *grid.x, "w", "cell", (F.col("n") + F.coalesce("around", F.lit(0)) >= min_samples).alias("is_core"))
    return grid.scratch.table(out, "judged")


def neighbor_counts(df: DataFrame, id_col: str, features: list[str], eps: float) -> DataFrame:
    """(id, n_neighbors): how many rows lie within eps of each row with all features present, itself counted.

    The counts of neighbors.neighbor_counts(), without a list of pairs: full cells count as a whole.
    """
    rows, grid = _gridded(df, id_col, features, eps, False)
    sized = grid.points.join(grid.cells.select("cell", "n"), "cell")
    around = _around(grid, _named(grid.points, "a", ["id", "cell", *grid.x]), grid.adjoining())
    counts = sized.join(around, "id", "left").select(*grid.x, (F.col("n") + F.coalesce("around", F.lit(0))).alias("n_neighbors"))
    return rows.join(grid.scratch.table(counts, "counts"), grid.x).select("id", "n_neighbors")


def _gridded(df: DataFrame, id_col: str, features: list[str], eps: float, scale: bool) -> tuple[DataFrame, _Grid]:
    """The complete rows (id, x0, x1, ...) and a grid of them, in which equal rows are one point."""
    if not eps > 0:
        raise ValueError("eps has to be above 0")
    scratch, d = Scratch(df.sparkSession), len(features)
    names = [f"x{j}" for j in range(d)]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(features, names)]).dropna()
    rows = scratch.table(standardise(rows, names) if scale else rows, "rows")
    return rows, _Grid(rows.groupBy(*names).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), d, float(eps), scratch)


def _links(grid: _Grid, core: DataFrame, boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the least core ids of two cells that hold core points within eps of each other."""
    scratch, d, found = grid.scratch, grid.d, []
    columns = ["cell", "low", "m", *grid.box]
    open_ = pairs.select("acell", "bcell").join(_named(boxes, "a", columns), "acell").join(_named(boxes, "b", columns), "bcell")
    open_ = open_.where((F.col("alow") < F.col("blow")) & grid.near("a", "b")).withColumn("whole", grid.whole("a", "b"))
    open_, level, key = scratch.table(open_, "open"), 0, ["cell"]
    while True:
        found.append(open_.where("whole").select("alow", "blow").distinct())
        left = open_.where("not whole").join(found[-1], ["alow", "blow"], "left_anti") if level else open_.where("not whole")
        few = F.col("am") * F.col("bm") <= LISTED
        names = [*[f"a{k}" for k in key], *[f"b{k}" for k in key]]
        side = core.select(*grid.x, "cell", *([grid.cell(level).alias("sub")] if level else []))
        one, other = (_named(side, p, [*key, *grid.x]) for p in "ab")
        listed = left.where(few).select("alow", "blow", *names).join(one, [f"a{k}" for k in key]).join(other, [f"b{k}" for k in key])
        found.append(scratch.table(listed.where(grid.exact("a", "b")).select("alow", "blow").distinct(), "links"))
        todo = left.where(~few).join(found[-1], ["alow", "blow"], "left_anti").select("alow", "blow", *names)
        if todo.isEmpty():
            break
        level += 1
        # the boxes of the next level, by those they lie in
        keep = todo.select(F.col("acell").alias("cell")).union(todo.select(F.col("bcell").alias("cell"))).distinct()
        halves = core.join(keep, "cell", "left_semi").withColumn("sub", grid.cell(level)).groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("m"), *_box(d))
        halves = scratch.table(halves.withColumn("within", F.transform("sub", lambda s: F.floor(s / 2))), "halves")
        for p in "ab":
            of = _named(halves, p, ["cell", "sub", "within", "m", *grid.box])
            todo = todo.withColumnRenamed(f"{p}sub", f"{p}within").join(of, [f"{p}cell", *([f"{p}within"] if level > 1 else [])])
        open_ = todo.where(grid.near("a", "b")).withColumn("whole", grid.whole("a", "b")).select("alow", "blow", "whole", *[f"{p}{c}" for p in "ab" for c in ("cell", "sub", "m")])
        open_, key = scratch.table(open_, "open"), ["cell", "sub"]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.select(F.col("alow").alias("a"), F.col("blow").alias("b"))


def dbscan(df: DataFrame, id_col: str, features: list[str], eps: float = 0.5, min_samples: int = 10, scale: bool = True) -> DataFrame:
    """(id, cluster, is_core) for rows with all features present; -1 is noise.

    A core point has min_samples rows within eps, itself counted. Clusters are the components of core points within eps
    of each other, numbered by their smallest id; a border point joins the lowest-numbered cluster of the core points near
    it. Ids have to be unique and may be of any type with an order.
    """
    if min_samples < 1:
        raise ValueError("min_samples has to be 1 at least")
    rows, grid = _gridded(df, id_col, features, eps, scale)
    scratch, d, names = grid.scratch, grid.d, grid.x
    pairs = grid.adjoining()
    points = _core_ids(grid, pairs, min_samples)
    core = points.where("is_core")
    boxes = scratch.table(core.groupBy("cell").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("m"), *_box(d)), "boxes")
    parts = components(scratch, _links(grid, core, boxes, pairs).union(boxes.select(F.col("low").alias("a"), F.col("low").alias("b"))))
    # numbering needs an order of clusters, not of points: a row for each cluster
    number = parts.select("component").distinct().withColumn("cluster", (F.dense_rank().over(Window.orderBy("component")) - 1).cast("int"))
    boxes = scratch.table(boxes.join(parts.join(number, "component").select(F.col("id").alias("low"), "cluster"), "low"), "clusters")
    # border points: of their own cell, of boxes wholly near, of listed core points
    other = points.where("not is_core")
    near = pairs.select("acell", "bcell").join(_named(boxes, "b", ["cell", "m", "cluster", *grid.box]), "bcell")
    ask = grid.asked(_named(other, "a", ["id", "cell", *names]), near).select("aid", *[f"ax{j}" for j in range(d)], "bcell", "bm", "bcluster", grid.whole("a", "b").alias("whole"))
    ask = scratch.table(ask, "border")
    right = _named(core.join(boxes.select("cell", "m"), "cell"), "b", ["id", "cell", "m", *names])
    reach = ask.where("whole").select("aid", "bcluster").union(grid.listed(ask.where("not whole"), right).select("aid", "bcluster"))
    reach = reach.groupBy(F.col("aid").alias("id")).agg(F.min("bcluster").alias("low"))
    own = boxes.select("cell", F.col("cluster").alias("own"))
    labels = points.join(own, "cell", "left").join(reach, "id", "left")
    labels = labels.select(*names, F.when(F.col("is_core"), F.col("own")).otherwise(F.coalesce(F.least("own", "low"), F.lit(-1))).alias("cluster"), "is_core")
    return rows.join(scratch.table(labels, "labels"), names).select("id", "cluster", "is_core")


def dbscan_attach(df: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """All input rows with cluster_label; null where a row could not be clustered."""
    return attach_labels(df, labels.select(F.col("id").alias(id_col), F.col("cluster").alias("cluster_label")), id_col)
