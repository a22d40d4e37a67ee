"""HDBSCAN (Campello et al. 2013): one spanning tree over the whole table, one condensed tree.

Core distances and the minimum spanning tree of the mutual reachability graph come from joins on a grid whose side grows:
what lies within the side is settled first, and only points that still lack neighbours, or that have points of another
component near by, go on to the next. Within a side the tree grows by Boruvka's rounds: every component takes its least
edge, and what these join becomes one. The n - 1 edges of the tree, not the pairs, then go to one task that builds the
single-linkage hierarchy, condenses it and chooses clusters by excess of mass.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from .neighbors import CHUNK, GRID_FEATURES, block_pairs, cores_of_places, first_side, in_blocks
from .prepare import drop_missing, require_long_ids


def contracted(pts: DataFrame, names: list[str], k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): id, w, core and features of each node; id and node of the other rows that a node stands for.

    Equal rows, if there are k of them, are one node of weight w with the smallest of their ids: their core distance is 0,
    so in the tree they all hang on that id by edges of length 0, which come before all others. Other rows are nodes
    themselves. The core distance is that to the k-th nearest row, the row itself counted. There have to be k rows.
    """
    places = scratch.table(pts.groupBy(*names).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "places")
    cores = scratch.table(places.join(cores_of_places(places, names, k, scratch), "id").withColumnRenamed("id", "node"), "cores")
    full = F.col("w") >= k
    rows = scratch.table(pts.join(cores, names).select("id", "node", "w", "core", *names), "rows")
    nodes = rows.where(~full | (F.col("id") == F.col("node"))).select("id", F.when(full, F.col("w")).otherwise(1).alias("w"), "core", *names)
    return scratch.table(nodes, "nodes"), rows.where(full & (F.col("id") != F.col("node"))).select("id", "node")


def spanning_tree(pts: DataFrame, names: list[str], side: float, scratch: Scratch) -> DataFrame:
    """(src, dst, reach): the minimum spanning tree under mutual reachability, ties by src and dst. pts: id, core and features.

    A row reaches no other below its core distance, so a side concerns rows of at most that core distance. Of those, rows
    whose own and adjoining cells hold one component alone have no edge to find and are left out. Of the edges of a block of
    cells only its own minimum spanning forest can be in the tree; so edges grow with the rows, not with the pairs.
    """
    grid = names[:GRID_FEATURES]
    nodes = scratch.table(pts.withColumn("comp", F.col("id")), "nodes")
    n, found, tree = nodes.count(), 0, None
    while found < n - 1:
        cells = [F.floor(F.col(c) / side).alias(f"c{k}") for k, c in enumerate(grid)]
        keys = [f"c{k}" for k in range(len(grid))]
        live = nodes.where(F.col("core") <= side).select("*", *cells)
        held = live.groupBy(*keys).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        for k in keys:
            held = held.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
        border = held.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select(*keys)
        live = scratch.table(live.join(border, keys, "left_semi"), "live")

        def prune(pdf: pd.DataFrame, *, side: float = side) -> pd.DataFrame:
            return block_edges(pdf, names, side)

        edges = in_blocks(live.drop(*keys), names, side).applyInPandas(prune, "src long, dst long, reach double, p long, q long")
        edges = scratch.table(edges, "edges")
        while not edges.isEmpty():  # Boruvka's rounds
            ends = edges.select("p", "q", "reach", "src", "dst").union(edges.select("q", "p", "reach", "src", "dst"))
            least = ends.groupBy("p").agg(F.min(F.struct("reach", "src", "dst", "q")).alias("e")).select("p", "e.*")
            least = scratch.table(least, "least")
            took = scratch.table(least.select("src", "dst", "reach").distinct(), "tree")
            tree, found = took if tree is None else tree.union(took), found + took.count()
            # each component points along its edge; the only circles are pairs, whose smaller id is the root
            back = least.select(F.col("p").alias("q"), F.col("q").alias("back"))
            up = least.join(back, "q", "left").select(F.col("p").alias("comp"), F.when((F.col("back") == F.col("p")) & (F.col("p") < F.col("q")), F.col("p")).otherwise(F.col("q")).alias("root"))
            up = scratch.table(up, "up")
            while True:  # pointers jump to the roots
                far = up.select(F.col("comp").alias("root"), F.col("root").alias("next"))
                new = scratch.table(up.join(far, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("far")), "up")
                still = not new.where("far").isEmpty()
                up = new.select("comp", "root")
                if not still:
                    break
            for c in ("p", "q"):
                edges = edges.join(up.select(F.col("comp").alias(c), F.col("root").alias(f"{c}r")), c, "left").withColumn(c, F.coalesce(f"{c}r", c)).drop(f"{c}r")
            edges = scratch.table(edges.where("p <> q"), "edges")
            nodes = nodes.join(up, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        nodes = scratch.table(nodes, "nodes")
        side *= 2
    return tree if tree is not None else nodes.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("core").alias("reach"))


def forest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places of the edges (p, q), given in rising order, that make up the minimum spanning forest; Boruvka's rounds."""
    ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b, left, kept = at[: len(p)], at[len(p) :], np.arange(len(p)), [np.zeros(0, np.int64)]
    while len(left):
        best = np.full((2, len(ids)), len(p))
        best[0, a[::-1]] = left[::-1]  # the first edge of each component stays
        best[1, b[::-1]] = left[::-1]
        best = best.min(axis=0)
        comps = np.flatnonzero(best < len(p))
        kept.append(np.unique(best[comps]))
        place = left.searchsorted(best[comps])
        up = np.arange(len(ids))
        up[comps] = np.where(a[place] == comps, b[place], a[place])
        root = (up[up] == np.arange(len(ids))) & (np.arange(len(ids)) < up)
        up[root] = np.flatnonzero(root)
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b, left = a[apart], b[apart], left[apart]
    return np.sort(np.concatenate(kept))


def block_edges(pdf: pd.DataFrame, names: list[str], side: float) -> pd.DataFrame:
    """The minimum spanning forest of the edges up to `side` whose smaller id is the block's own."""
    ids, core, comp = (pdf[c].to_numpy() for c in ("id", "core", "comp"))
    x = pdf[names].to_numpy(float)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def least(i: np.ndarray, j: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids[j], ids[i], reach))
        i, j, reach = i[order], j[order], reach[order]
        kept = forest(comp[i], comp[j])
        return i[kept], j[kept], reach[kept]

    for i, j, d in block_pairs(x, np.flatnonzero(pdf["own"]), side):
        reach = np.maximum(np.maximum(core[i], core[j]), d)
        open_ = (ids[i] < ids[j]) & (comp[i] != comp[j]) & (reach <= side)
        held = tuple(np.concatenate([h, n[open_]]) for h, n in zip(held, (i, j, reach)))
        if len(held[0]) > max(CHUNK // 4, 4 * len(ids)):
            held = least(*held)
    i, j, reach = least(*held)
    return pd.DataFrame({"src": ids[i], "dst": ids[j], "reach": reach, "p": comp[i], "q": comp[j]})


def _raised(up: np.ndarray) -> np.ndarray:
    """Where each pointer ends; those that end point at themselves."""
    while True:
        far = up[up]
        if np.array_equal(far, up):
            return up
        up = far


def condense(tree, n: int, least: int, weights: list[int] | np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, probability) of each point: -1 and 0 for noise, else 0, 1, ... in no special order. weights: rows a point stands for.

    tree: (height, a, b) of each edge by rising height, or three arrays of these. The hierarchy is arrays with a place for
    each node; clusters are found by pointers that jump, not by walks.
    """
    weights = np.ones(n, np.int64) if weights is None else np.asarray(weights, np.int64)
    label, strength = np.full(n, -1), np.zeros(n)
    if weights.sum() < least or n < 2:
        return label, strength
    height, ends_a, ends_b = (np.asarray(c) for c in (tree if isinstance(tree, tuple) else zip(*tree)))
    height = height.astype(float)
    # single linkage: node n + k joins two earlier nodes at height[k]
    root, node = array("i", range(n)), array("i", range(n))
    rows = array("q", weights.tobytes())
    left, right, size = array("i", bytes(4 * (n - 1))), array("i", bytes(4 * (n - 1))), array("q", bytes(8 * (n - 1)))
    for k, (a, b) in enumerate(zip(array("i", ends_a.astype(np.int32).tobytes()), array("i", ends_b.astype(np.int32).tobytes()))):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if rows[a] < rows[b]:
            a, b = b, a
        left[k], right[k] = node[a], node[b]
        rows[a] += rows[b]
        size[k], root[b], node[a] = rows[a], a, n + k
    del root, node, rows
    left, right, size = np.frombuffer(left, np.int32), np.frombuffer(right, np.int32), np.r_[weights, np.frombuffer(size, np.int64)]
    total = 2 * n - 1
    parent = np.full(total, total - 1, np.int32)
    parent[left] = parent[right] = np.arange(n, total)
    with np.errstate(divide="ignore"):
        lam = np.r_[np.full(n, np.inf), np.where(height > 0, 1 / height, np.inf)]  # a point of weight enough never falls
    big = size >= least
    del size
    # a point falls at the lowest node above it that is large enough
    at = np.arange(total, dtype=np.int32)
    fell = _raised(np.where(big, at, parent))[:n].copy()
    # condensed tree: a cluster starts at the top and at either side of a split
    starts = np.zeros(total, bool)
    split = big[left] & big[right]
    starts[left[split]] = starts[right[split]] = True
    starts[-1] = True
    cluster = _raised(np.where(starts, at, parent))
    heads = np.flatnonzero(starts)[::-1]  # parents before children
    number = np.empty(total, np.int32)
    number[heads] = np.arange(len(heads))
    over_of = number[cluster[parent[heads]]]  # the cluster above; 0 for the top itself
    birth = lam[parent[heads]]
    birth[0] = 0.0
    c, v = number[cluster[fell]], lam[fell]
    finite = np.concatenate([v[np.isfinite(v)], birth[np.isfinite(birth)]])
    top = float(finite.max(initial=0.0)) or 1.0
    v, birth = np.where(np.isfinite(v), v, top), np.where(np.isfinite(birth), birth, top)
    m = len(heads)
    mass = np.bincount(c, weights * (v - birth[c]), m).tolist()
    inner = np.bincount(c, weights, m).tolist()
    deepest = np.zeros(m)
    np.maximum.at(deepest, c, v)
    np.maximum.at(deepest, over_of[1:], birth[1:])
    born, above = birth.tolist(), over_of.tolist()
    for k in range(m - 1, 0, -1):
        inner[above[k]] += inner[k]
        mass[above[k]] += inner[k] * (born[k] - born[above[k]])
    below, parted, chosen = [0.0] * m, np.bincount(over_of[1:], minlength=m).tolist(), [False] * m
    for k in range(m - 1, -1, -1):
        if k and not (parted[k] and below[k] > mass[k]):  # the whole is no cluster
            chosen[k], below[k] = True, mass[k]
        if k:
            below[above[k]] += below[k]
    over = [-1] * m  # the topmost chosen one above each cluster
    for k in range(m):
        up = over[above[k]] if k else -1
        over[k] = up if up >= 0 else (k if chosen[k] else -1)
    over = np.array(over)[c]
    held = over >= 0
    names, label[held] = np.unique(over[held], return_inverse=True)
    deep = deepest[over[held]]
    strength[held] = np.minimum(1.0, np.divide(v[held], deep, out=np.ones(len(deep)), where=deep > 0))
    return label, strength


def _contracted_tree(df: DataFrame, id_col: str, features: list[str], min_samples: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(tree, nodes, members): the spanning tree of the nodes that contracted() makes; None with too few rows."""
    names = [f"x{k}" for k in range(len(features))]
    pts = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(features, names)]).dropna()
    pts = scratch.table(pts, "points")
    if pts.count() < max(2, min_samples):
        return None
    nodes, members = contracted(pts, names, min_samples, scratch)
    side = first_side(nodes, names, min_samples)
    return scratch.table(spanning_tree(nodes.drop("w"), names, side, scratch), "tree"), nodes, members


def hierarchy(df: DataFrame, id_col: str, features: list[str], min_samples: int, scratch: Scratch) -> DataFrame:
    """(src, dst, reach): the spanning tree of the rows with all features present, whose ids have to be unique."""
    found = _contracted_tree(df, id_col, features, min_samples, scratch)
    if found is None:
        return df.sparkSession.createDataFrame([], "src long, dst long, reach double")
    tree, _, members = found
    return tree.union(members.select(F.col("node").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("reach")))


def hdbscan(df: DataFrame, id_col: str, features: list[str], min_cluster_size: int = 10, min_samples: int | None = None) -> DataFrame:
    """(id, cluster, probability) for rows with all features present; -1 with 0 is noise.

    Ids have to be whole numbers. min_samples (default min_cluster_size) counts the point itself. Clusters are numbered by their smallest id. The whole
    table is never one cluster; with fewer rows than min_samples all are noise.
    """
    if min_cluster_size < 2 or (min_samples is not None and min_samples < 1):
        raise ValueError("min_cluster_size has to be 2 at least and min_samples 1 at least")
    scratch = Scratch(require_long_ids(df, id_col).sparkSession)
    rows = drop_missing(df, features).select(F.col(f"`{id_col}`").alias("id"))
    made = _contracted_tree(df, id_col, features, min_samples or min_cluster_size, scratch)
    if made is None:
        return rows.select("id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("probability"))
    tree, nodes, members = made

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, reach = (pdf[c].to_numpy() for c in ("src", "dst", "reach"))
        alone = src == dst  # a node's weight, not an edge
        ids, weights = src[alone], reach[alone].astype(np.int64)
        order = np.argsort(ids)
        ids, weights = ids[order], weights[order]
        src, dst, reach = ids.searchsorted(src[~alone]).astype(np.int32), ids.searchsorted(dst[~alone]).astype(np.int32), reach[~alone]
        order = np.lexsort((dst, src, reach))
        src, dst, reach = src[order], dst[order], reach[order]
        got, strength = condense((reach, src, dst), len(ids), min_cluster_size, weights)
        first = np.full(len(ids) + 1, -1)  # by label; noise has the last place
        first[got[::-1]] = ids[::-1]
        return pd.DataFrame({"id": ids, "first": pd.Series(first[got], dtype="Int64").mask(got < 0), "probability": strength})

    # the tree's edges are three numbers for each node; its order is sequential
    sent = tree.union(nodes.select("id", F.col("id").alias("dst"), F.col("w").cast("double").alias("reach")))
    found = scratch.table(sent.groupBy((F.col("src") * 0).alias("all")).applyInPandas(label, "id long, first long, probability double"), "found")
    number = found.where("first is not null").select("first").distinct().withColumn("cluster", (F.dense_rank().over(Window.orderBy("first")) - 1).cast("int"))
    rows = rows.join(members, "id", "left").withColumn("node", F.coalesce("node", "id"))
    out = rows.join(found.withColumnRenamed("id", "node"), "node", "left").join(number, "first", "left")
    return out.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
