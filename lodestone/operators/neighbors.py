"""Neighbourhoods: pairs within a distance by a grid join, core and reachability distances, k nearest neighbours.

A distance predicate alone would compare every row with every other. Rows are keyed by the grid cell (side eps) of their
first features; a row meets only rows of its own and the adjoining cells, by an equi-join on the cell. What comes out is a
sparse list of pairs, never a full matrix; full cells are dealt out by a second key, so that no task has more than a
bounded share of it. Core distances need no pairs: cores_within() looks at cells of few points. nearest() is in knn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.scalars import squared_distance
from ..functions.scratch import Scratch
from .knn import nearest

__all__ = [
    "core_distances", "cores_within", "eps_pairs", "first_side", "mutual_reachability", "mutual_reachability_within", "nearest", "neighbor_counts", "pairs_between",
    "reachability", "reachability_within",
]

GRID_FEATURES = 3  # 27 cells meet; more features only filter
SPAN = {1: 64, 2: 12, 3: 5}  # cells of a block along each of as many features
CHUNK = 1_000_000  # pairs of rows of a block that are held at once
COMPARED = 8_000_000  # pairs of rows that a task, and a key of the join, compares
TASKS = 2_000  # from so many tasks on, these compare more


def _points(df: DataFrame, id_col: str, features: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"x{k}" for k in range(len(features))]
    return df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(features, names)]).dropna(), names


def _cell(names: list[str], side: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(side))).alias(f"c{k}") for k, c in enumerate(names[:GRID_FEATURES])]


def eps_pairs(df: DataFrame, id_col: str, features: list[str], eps: float) -> DataFrame:
    """(src, dst, dist) for all pairs with Euclidean distance <= eps, both directions, each point with itself as well.

    Rows with a null id or feature have no neighbours. Ids have to be unique.
    """
    if not eps > 0:
        raise ValueError("eps has to be above 0")
    pts, names = _points(df, id_col, features)
    return pairs_between(pts, pts, names, eps, dealt=True)


def pairs_between(left: DataFrame, right: DataFrame, names: list[str], eps: float, keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """(src, dst, dist) for the rows of left and of right (id and the features `names`) within eps of each other.

    keep: further columns of both, as src_ and dst_ with their names. dealt: the rows of right are counted first, and full
    cells dealt out.
    """
    cell, keys = _cell(names, eps), [f"c{k}" for k in range(min(GRID_FEATURES, len(names)))]
    a = left.select(F.col("id").alias("src"), *[F.col(c).alias(f"a{k}") for k, c in enumerate(names)], *[F.col(c).alias(f"src_{c}") for c in keep], *cell)
    for k in keys:
        a = a.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
    b = right.select(F.col("id").alias("dst"), *[F.col(c).alias(f"b{k}") for k, c in enumerate(names)], *[F.col(c).alias(f"dst_{c}") for c in keep], *cell)
    if dealt:
        a, b, keys = _dealt(a, b, keys)
    dist = F.sqrt(squared_distance([F.col(f"a{k}") for k in range(len(names))], [F.col(f"b{k}") for k in range(len(names))]))
    return a.join(b, keys).select("src", "dst", dist.alias("dist"), *[f"{p}_{c}" for c in keep for p in ("src", "dst")]).where(F.col("dist") <= eps)


def _dealt(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on the keys, laid out so that tasks compare about as many pairs each, however full a cell is.

    In a full cell the rows of a and of b are dealt out to the rows and columns of a grid, so each row goes to one line of it
    only; from TASKS tasks on these grow, not their number, and what is sent grows with the rows. What few rows make many
    pairs looks small to Spark, which would put it into few tasks; so the number of tasks is given.
    """
    met = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
    met = met.select(*keys, "n", "m", (F.col("n").cast("double") * F.col("m")).alias("pairs"))
    total = met.agg(F.max("pairs").alias("most"), F.sum("pairs").alias("pairs")).first()
    spark, each = b.sparkSession, max(COMPARED, (total["pairs"] or 0) / TASKS)
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-(total["pairs"] or 0) // each)))
    if (total["most"] or 0) > each:
        deals = F.ceil(F.col("pairs") / F.lit(float(each)))
        met = met.withColumn("right", F.greatest(F.lit(1).cast("long"), F.round(F.sqrt(deals * F.col("n") / F.col("m"))).cast("long")))
        met = met.select(*keys, "right", F.ceil(deals / F.col("right")).alias("left"))
        line = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        one = lambda c, id_: F.pmod(F.xxhash64(id_), F.col(c))
        a = a.join(met, keys).withColumn("of_a", one("left", "src")).withColumn("of_b", line("right")).drop("left", "right")
        b = b.join(met, keys).withColumn("of_a", line("left")).withColumn("of_b", one("right", "dst")).drop("left", "right")
        keys = [*keys, "of_a", "of_b"]
    return a.repartition(parts, *keys), b.repartition(parts, *keys), keys


def neighbor_counts(pairs: DataFrame) -> DataFrame:
    """(id, n_neighbors) with the point itself counted."""
    return pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_neighbors"))


def core_distances(pairs: DataFrame, min_pts: int) -> DataFrame:
    """(id, core_distance): the min_pts-th smallest distance in the neighbourhood, the point itself first; null if it has fewer."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    kth = pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= min_pts)
    return kth.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("_k") == min_pts, F.col("dist"))).alias("core_distance"))


def first_side(pts: DataFrame, names: list[str], k: int) -> float:
    """A grid side at which a cell of an even table has some k rows; halved while the fullest cell has over 50 times that."""
    grid = names[:GRID_FEATURES]
    r = pts.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in grid]).first()
    spread = [r[c] for c in grid if r[c]]
    if not spread:
        return 1.0
    side = float(np.exp((np.log(spread).sum() + np.log(min(1.0, 4 * k / r["n"]))) / len(spread)))
    fullest = None
    for _ in range(30):
        cells = pts.groupBy(*[F.floor(F.col(c) / side).alias(c) for c in grid]).count()
        now = cells.agg(F.max("count")).first()[0]
        if now <= 50 * k or now == fullest:  # equal rows stay together at any side
            break
        side, fullest = side / 2, now
    return side


def cores_within(df: DataFrame, id_col: str, features: list[str], eps: float, min_pts: int) -> DataFrame:
    """(id, core_distance) as core_distances() has them of eps_pairs(), without a list of pairs.

    Equal rows are one point with a weight. A grid whose side grows up to eps settles the points of full places first, so a
    point is compared with few more than it needs.
    """
    if not eps > 0:
        raise ValueError("eps has to be above 0")
    pts, names = _points(df, id_col, features)
    rows = pts.where(reduce(Column.__and__, [F.abs(x) < F.lit(float("inf")) for x in names]))  # others are near nothing, not even themselves
    scratch = Scratch(df.sparkSession)
    places = scratch.table(rows.groupBy(*names).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "places")
    found = cores_of_places(places, names, min_pts, scratch, eps)
    near = places.join(found, "id", "left").select(*names, F.col("core").alias("core_distance"))
    return rows.join(scratch.table(near, "near"), names).select("id", "core_distance")


def cores_of_places(places: DataFrame, names: list[str], k: int, scratch: Scratch, eps: float = float("inf"), side: float | None = None) -> DataFrame:
    """(id, core): distance within which lie k rows, of places (id, features, w rows each) that have them within eps."""
    found = places.where(F.col("w") >= k).select("id", F.lit(0.0).alias("core"))
    todo = places.where(F.col("w") < k)
    if todo.isEmpty():
        return found
    side, grid = min(eps, side or first_side(places, names, k)), names[:GRID_FEATURES]
    schema, right = f"id {places.schema['id'].dataType.simpleString()}, core double", places.withColumn("todo", F.col("w") < k)
    while True:

        def run(pdf: pd.DataFrame, *, side: float = side) -> pd.DataFrame:
            got = block_cores(pdf[names].to_numpy(float), pdf["w"].to_numpy(), np.flatnonzero(pdf["own"] & pdf["todo"]), side, k)
            return pd.DataFrame({"id": pdf["id"].to_numpy(), "core": got})[~np.isnan(got)]

        got = scratch.table(in_blocks(right, names, side).applyInPandas(run, schema), "cores")
        found = found.union(got)
        todo = scratch.table(todo.join(got, "id", "left_anti"), "sparse")
        if side >= eps or todo.isEmpty():
            return found
        side = min(eps, 2 * side)
        keys = [f"c{j}" for j in range(len(grid))]
        around = todo.select(*_cell(names, side)).distinct()
        for c in keys:
            around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        right = places.select("*", *_cell(names, side)).join(around.distinct(), keys, "left_semi").drop(*keys)
        right = right.join(todo.select("id", F.lit(True).alias("todo")), "id", "left").withColumn("todo", F.coalesce("todo", F.lit(False)))


def in_blocks(pts: DataFrame, names: list[str], side: float) -> GroupedData:
    """The rows grouped by blocks of grid cells, each with the rows of the cells around it, whose `own` is false.

    What few rows make many pairs looks small to Spark, which would put it into few tasks; so the number of tasks is given.
    """
    grid, out, own = names[:GRID_FEATURES], pts, F.lit(True)
    for j, c in enumerate(grid):
        at = [F.floor((F.floor(F.col(c) / F.lit(float(side))) + s) / F.lit(SPAN[len(grid)])) for s in (-1, 0, 1)]
        out = out.withColumn(f"h{j}", at[1]).withColumn(f"b{j}", F.explode(F.array_distinct(F.array(*at))))
        own = own & (F.col(f"b{j}") == F.col(f"h{j}"))
    keys, spark = [f"b{j}" for j in range(len(grid))], pts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, pts.count() // 50_000)
    return out.select(*pts.columns, *keys, own.alias("own")).repartition(parts, *keys).groupBy(*keys)


def block_pairs(x: np.ndarray, left: np.ndarray, side: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the rows `left` of x with all rows within `side`, some CHUNK comparisons at a time; all of an i come together."""
    if not len(left):
        return
    cells = np.floor(x[:, :GRID_FEATURES] / side).astype(np.int64)
    cells -= cells.min(axis=0) - 1
    stride = np.r_[np.cumprod((cells.max(axis=0) + 2)[:0:-1])[::-1], 1]  # cells that follow each other along the last feature have following keys
    key = cells @ stride
    order = np.argsort(key, kind="stable")
    keys = key[order]
    steps = np.array([sum(t * u for t, u in zip(s, stride.tolist())) for s in product((-1, 0, 1), repeat=cells.shape[1] - 1)], np.int64)
    home = key[left][:, None] + steps
    low, high = keys.searchsorted(home - 1, "left"), keys.searchsorted(home + 1, "right")
    ends = np.cumsum((high - low).sum(axis=1))
    at = 0
    while at < len(left):
        to = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + CHUNK, "right")))
        n = (high[at:to] - low[at:to]).ravel()
        i = np.repeat(left[at:to], n.reshape(to - at, -1).sum(axis=1))
        j = order[np.arange(n.sum()) + np.repeat(low[at:to].ravel() - np.r_[0, np.cumsum(n)[:-1]], n)]
        d = x[i, 0] - x[j, 0]
        d = d * d
        for c in range(1, x.shape[1]):
            e = x[i, c] - x[j, c]
            d += e * e
        d = np.sqrt(d)
        near = d <= side
        yield i[near], j[near], d[near]
        at = to


def block_cores(x: np.ndarray, w: np.ndarray, left: np.ndarray, side: float, k: int) -> np.ndarray:
    """The distance within which lie k rows, for the places `left` that have them within side; others are not a number."""
    core = np.full(len(x), np.nan)
    for i, j, d in block_pairs(x, left, side):
        order = np.lexsort((d, i))
        i, d, rows = i[order], d[order], np.cumsum(w[j[order]])
        heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        rows = rows - np.repeat(np.r_[0, rows[heads[1:] - 1]], np.diff(np.r_[heads, len(i)])) if len(i) else rows
        enough = rows >= k
        core[i[enough][::-1]] = d[enough][::-1]  # the first of each stays
    return core


def _with_cores(df: DataFrame, id_col: str, features: list[str], eps: float, min_pts: int) -> tuple[DataFrame, list[str]]:
    """The rows that have a core distance, with it."""
    pts, names = _points(df, id_col, features)
    cores = cores_within(df, id_col, features, eps, min_pts).where("core_distance is not null").withColumnRenamed("core_distance", "core")
    return Scratch(df.sparkSession).table(pts.join(cores, "id"), "points"), names


def reachability_within(df: DataFrame, id_col: str, features: list[str], eps: float, min_pts: int) -> DataFrame:
    """reachability() of the pairs within eps; core distances travel with the rows, so pairs are not shuffled again."""
    cored, names = _with_cores(df, id_col, features, eps, min_pts)
    pts, _ = _points(df, id_col, features)
    pairs = pairs_between(cored, pts.withColumn("core", F.lit(None).cast("double")), names, eps, ("core",), dealt=True)
    return pairs.select("src", "dst", F.greatest("src_core", "dist").alias("reach"))


def mutual_reachability_within(df: DataFrame, id_col: str, features: list[str], eps: float, min_pts: int) -> DataFrame:
    """mutual_reachability() of the pairs within eps, in the same way."""
    cored, names = _with_cores(df, id_col, features, eps, min_pts)
    pairs = pairs_between(cored, cored, names, eps, ("core",), dealt=True)
    return pairs.where("src < dst").select("src", "dst", F.greatest("src_core", "dst_core", "dist").alias("reach"))


def reachability(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """(src, dst, reach) = max(core distance of src, dist) for sources that have a core distance."""
    c = cores.where(F.col("core_distance").isNotNull()).withColumnRenamed("id", "src")
    return pairs.join(c, "src").select("src", "dst", F.greatest("core_distance", "dist").alias("reach"))


def mutual_reachability(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """(src, dst, reach) = max(both core distances, dist), each pair once (src < dst)."""
    c = cores.where(F.col("core_distance").isNotNull())
    a = c.select(F.col("id").alias("src"), F.col("core_distance").alias("ca"))
    b = c.select(F.col("id").alias("dst"), F.col("core_distance").alias("cb"))
    return pairs.where("src < dst").join(a, "src").join(b, "dst").select("src", "dst", F.greatest("ca", "cb", "dist").alias("reach"))
