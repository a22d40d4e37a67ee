"""Exact k nearest neighbours: rows in blocks around pivots, blocks skipped by the triangle inequality.

Each row belongs to its nearest pivot and, where a pivot has many rows, to a ring of distances from it. The k best of a
row's own block bound how far its neighbours can be; by the distances to the pivots all other blocks but those that may
hold something as near are skipped (after Lu et al. 2012, "Efficient Processing of k Nearest Neighbor Joins using
MapReduce"). What cannot be skipped is compared in bounded groups, so vectors without structure cost all pairs, but no more.
A row is sent once to each bundle of blocks, not to each block, with the numbers of those it has to look at; there are some
BUNDLES of them however many rows there are, until a bundle is as large as a task may hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch

PIVOTS = 1024  # at most; their rings number RINGS at most, so tables of blocks have a bound
RINGS = 64
BLOCKS = 65_536  # more rows than this many blocks hold make larger blocks
BUNDLES = 8
HELD = 1 << 22  # numbers in the vectors of a bundle, at most
SLICE, SENT = 1 << 18, 1 << 20  # distances that are held, and numbers in vectors that are sent at once


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(float, copy=False).reshape(len(column), -1)


def _rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and for each row of a how far off they may be."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    return np.maximum(0.0, aa[:, None] - 2 * (a @ b.T) + bb), 1e-12 * (aa + bb.max(initial=0.0))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows one by one, squares added in the order of the components."""
    d = a - b
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1]) if d.shape[1] else np.zeros(len(d))


def _closest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The closest pivot of each row, with SLICE distances held at once."""
    step = max(1, SLICE // len(pivots))
    return np.concatenate([_rough(x[a : a + step], pivots)[0].argmin(axis=1) for a in range(0, max(1, len(x)), step)])


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, sizes: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k nearest ids of each row of q, by distance and id; only those within bound, if given.

    x are different vectors in the order of their least ids; ids are those of all x end to end, sizes how many each has.
    """
    found = []
    for a in range(0, len(q), 256):
        d2, off = _rough(q[a : a + 256], x)
        limit = np.full(len(d2), np.inf) if bound is None else bound[a : a + 256] ** 2 * (1 + 1e-12) + off
        near = d2 <= limit[:, None]
        if np.count_nonzero(near) > 4 * k * len(d2):  # the bound says little
            kth = np.partition(d2, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            near = d2 <= np.minimum(limit, kth + 2 * off)[:, None]
        r, c = np.nonzero(near)
        d = _distance(q[a + r], x[c])
        if bound is not None:
            near = d <= bound[a + r]
            r, c, d = r[near], c[near], d[near]
        order = np.lexsort((c, d, r))
        found.append(np.stack([a + r[order], c[order], d[order]]))
    r, c, d = np.concatenate(found, axis=1) if found else np.zeros((3, 0))
    r, c = r.astype(np.int64), c.astype(np.int64)
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    r, c, d = r[keep], c[keep], d[keep]
    n, starts = sizes[c], np.cumsum(sizes) - sizes
    at = np.repeat(starts[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    r, d, ids = np.repeat(r, n), np.repeat(d, n), ids[at]
    order = np.lexsort((ids, d, r))
    r, d, ids = r[order], d[order], ids[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], ids[keep], d[keep]


class PivotSearch:
    """The tables of one search; result() are the neighbours, pairs() how many distances it takes.

    rows: (id, v), ids longs and vectors of floats or doubles of one length without nulls.
    """

    def __init__(self, rows: DataFrame, k: int, block: int):
        self.rows, self.k, self.scratch = rows, k, Scratch(rows.sparkSession)
        self.v = f"v {rows.schema['v'].dataType.simpleString()}"
        few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k)
        points = few.groupBy("v").agg(F.min("id").alias("r"), F.array_sort(F.collect_list("id")).alias("ids"))
        self.points = self.scratch.table(points, "points")  # equal rows are one, with the k least ids
        size = self.points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
        if size["low"] != size["high"]:
            raise ValueError("vectors have to be of one length")
        self.n = size["n"]
        self.block = max(block, -(-self.n // BLOCKS))
        self.visits = None
        if self.n > self.block:
            self._place()
            self._own()
            self._visit()
        elif self.n:  # one block has all
            self.placed = self.points.withColumn("block", F.lit(0).cast("long"))
            self._own()

    def _place(self) -> None:
        """placed: points with their block; cell, low, high: of each block the pivot and the range of distances from it."""
        taken = self.points.orderBy(F.xxhash64("r"), "r").limit(min(PIVOTS, -(-self.n // self.block))).select("v").collect()
        self.pivots = pivots = np.array([r["v"] for r in taken], float).reshape(len(taken), -1)

        def assign(batches):
            for batch in batches:
                x = _matrix(batch.column(1))
                cell = _closest(x, pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(_distance(x, pivots[cell]))], ["r", "v", "ids", "cell", "dp"])

        cells = self.scratch.table(self.points.select("r", "v", "ids").mapInArrow(assign, f"r long, {self.v}, ids array<long>, cell long, dp double"), "cells")
        marks = [i / RINGS for i in range(1, RINGS)]
        full = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dp", marks, 10_000).alias("cuts")).collect()
        spark = self.rows.sparkSession
        cuts = [(r["cell"], sorted({r["cuts"][-(-RINGS * i // parts) - 1] for i in range(1, parts)})) for r in full for parts in [min(RINGS, -(-r["n"] // self.block))]]
        # a row for each pivot, and below for each ring
        rings = cells.join(F.broadcast(spark.createDataFrame(cuts, "cell long, cuts array<double>")), "cell")
        rings = rings.withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dp")))).drop("cuts")
        held = rings.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dp").alias("low"), F.max("dp").alias("high")).collect()
        table, first = [], 0
        for r in sorted(held, key=lambda r: (r["cell"], r["ring"])):
            parts = -(-r["n"] // self.block)
            table.append((r["cell"], r["ring"], first, parts, r["low"], r["high"]))
            first += parts
        parts = np.array([t[3] for t in table], int)
        self.cell, self.low, self.high = (np.repeat(np.array([t[j] for t in table], kind), parts) for j, kind in ((0, int), (4, float), (5, float)))
        known = spark.createDataFrame([t[:4] for t in table], "cell long, ring int, first long, parts long")
        self.placed = rings.join(F.broadcast(known), ["cell", "ring"]).select("r", "v", "ids", (F.col("first") + F.pmod(F.xxhash64("r"), F.col("parts"))).alias("block"))

    def _own(self) -> None:
        """own: each point with the best of its block, and the distance within which the k nearest must lie."""
        k = self.k

        def search(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("r").combine_chunks()
            x, ids = _matrix(rows.column("v").combine_chunks()), rows.column("ids").combine_chunks()
            at, other, d = best(x, x, ids.flatten().to_numpy(), ids.value_lengths().to_numpy(), k)
            n = np.bincount(at, minlength=len(x))
            ends = np.cumsum(n)
            bound = np.where(n == k, d[ends - 1], np.inf)
            near = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.StructArray.from_arrays([pa.array(other), pa.array(d)], ["id", "dist"]))
            return pa.table([rows.column("r"), rows.column("v"), rows.column("block"), pa.array(bound), near], ["r", "v", "block", "bound", "near"])

        made = self.placed.groupBy("block").applyInArrow(search, f"r long, {self.v}, block long, bound double, near array<struct<id: long, dist: double>>")
        self.own = self.scratch.table(made, "own")

    def _visit(self) -> None:
        """visits: (bundle, r, v, bound, blocks) of the points that have to look at blocks besides their own; asks: how many of
        them each bundle has."""
        pivots, cell, low, high = self.pivots, self.cell, self.low, self.high
        self.held = max(self.block, min(-(-self.n // BUNDLES), HELD // max(32, pivots.shape[1])))
        self.each = each = max(1, self.held // self.block)
        # blocks of a cell are in a row
        start, count = np.searchsorted(cell, np.arange(len(pivots))), np.bincount(cell, minlength=len(pivots))
        near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        np.minimum.at(near, cell, low)
        np.maximum.at(far, cell, high)

        def opened(batch):
            """(rows of the batch, bundles, where their blocks begin, blocks), a slice of the batch at a time."""
            x, home, bound = _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            step = max(1, min(SLICE // max(len(pivots), len(cell)), SENT // (-(-len(cell) // each) * max(1, x.shape[1]))))
            for a in range(0, len(x), step):
                d2, off = _rough(x[a : a + step], pivots)
                # a root is off by no more than the root of what its square is off by
                d, slack, limit = np.sqrt(d2), np.sqrt(off), bound[a : a + step] * (1 + 1e-12)
                r, c = np.nonzero(np.maximum(d - far, near - d) - slack[:, None] <= limit[:, None])
                n = count[c]
                b = np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                d, r = np.repeat(d[r, c], n), np.repeat(r, n)
                open_ = (np.maximum(d - high[b], low[b] - d) - slack[r] <= limit[r]) & (b != home[a + r])
                r, b = a + r[open_], b[open_]
                if len(r):
                    new = np.ones(len(r), bool)
                    new[1:] = (np.diff(r) != 0) | (np.diff(b // each) != 0)
                    heads = np.flatnonzero(new)
                    yield r[heads], b[heads] // each, np.r_[heads, len(b)].astype(np.int32), b

        def look(batches):
            for batch in batches:
                for r, bundle, starts, b in opened(batch):
                    chosen, blocks = pa.array(r), pa.ListArray.from_arrays(pa.array(starts), pa.array(b))
                    yield pa.RecordBatch.from_arrays([pa.array(bundle), *(batch.column(k).take(chosen) for k in (0, 1, 3)), blocks], ["bundle", "r", "v", "bound", "blocks"])

        def tell(batches):
            for batch in batches:
                for _, bundle, _, _ in opened(batch):
                    which, n = np.unique(bundle, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n)], ["bundle", "n"])

        rows = self.own.select("r", "v", "block", "bound")
        self.visits = rows.mapInArrow(look, f"bundle long, r long, {self.v}, bound double, blocks array<long>")
        self.asks = rows.mapInArrow(tell, "bundle long, n long").groupBy("bundle").agg(F.sum("n").alias("n"))

    def pairs(self) -> int:
        if not self.n:
            return 0
        if self.visits is None:
            return self.n**2
        sizes = self.placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        looks = self.visits.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("v"))
        both = sizes.join(looks, "block", "left")
        return both.agg(F.sum(F.col("n") * (F.col("n") + F.coalesce("v", F.lit(0))))).first()[0] or 0

    def result(self) -> DataFrame:
        """(query, rank, neighbor, dist) for every row."""
        k = self.k
        if not self.n:
            return self.rows.select(F.col("id").alias("query"), F.lit(1).alias("rank"), F.col("id").alias("neighbor"), F.lit(0.0).alias("dist"))
        found = self.own.select("r", F.inline("near"))
        if self.visits is not None:
            found = found.union(self._abroad())
        rank = F.row_number().over(Window.partitionBy("r").orderBy("dist", "id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("r", "rank", F.col("id").alias("neighbor"), "dist")
        if self.rows.count() == self.n:  # all different: a point is a row
            return found.withColumnRenamed("r", "query")
        near = self.scratch.table(found, "found").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "dist"))).alias("near"))
        near = self.scratch.table(self.points.select("v", "r").join(near, "r").select("v", "near"), "near")
        return self.rows.join(near, "v").select(F.col("id").alias("query"), F.inline("near"))

    def _abroad(self) -> DataFrame:
        """(r, id, dist) that the blocks visited have for each point, the k best of each bundle."""
        k = self.k
        # a bundle that many look at is handed out once for each group of them
        groups = self.asks.select("bundle", F.ceil(F.col("n") / self.held).alias("groups"))
        groups = self.scratch.table(groups, "groups")
        asking = self.visits.join(F.broadcast(groups), "bundle").withColumn("g", F.pmod(F.xxhash64("r"), F.col("groups"))).drop("groups")
        asked = self.placed.withColumn("bundle", F.expr(f"block div {self.each}")).join(F.broadcast(groups), "bundle")
        asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["r", "id", "dist"])
            right = right.sort_by([("block", "ascending"), ("r", "ascending")])
            x, ids = _matrix(right.column("v").combine_chunks()), right.column("ids").combine_chunks()
            sizes, ids = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
            first = np.r_[0, np.cumsum(sizes)]
            q, bound, blocks = _matrix(left.column("v").combine_chunks()), left.column("bound").to_numpy(), left.column("blocks").combine_chunks()
            owner, wanted = np.repeat(np.arange(len(q)), blocks.value_lengths().to_numpy()), blocks.flatten().to_numpy()
            order = np.argsort(wanted, kind="stable")
            owner, wanted = owner[order], wanted[order]
            dist, other = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            held, at = np.unique(right.column("block").to_numpy(), return_index=True)
            for block, a, b in zip(held, at, [*at[1:], len(x)]):
                rows = owner[np.searchsorted(wanted, block) : np.searchsorted(wanted, block, side="right")]
                r, near, d = best(q[rows], x[a:b], ids[first[a] : first[b]], sizes[a:b], k, np.minimum(bound[rows], dist[rows, -1]))
                some, r = np.unique(r, return_inverse=True)
                rows, place = rows[some], np.arange(len(r)) - np.searchsorted(r, r)
                d_all, id_all = np.full((len(rows), 2 * k), np.inf), np.full((len(rows), 2 * k), np.iinfo(np.int64).max)
                d_all[:, :k], id_all[:, :k] = dist[rows], other[rows]
                d_all[r, k + place], id_all[r, k + place] = d, near
                least = np.lexsort((id_all, d_all))[:, :k]
                dist[rows], other[rows] = np.take_along_axis(d_all, least, 1), np.take_along_axis(id_all, least, 1)
            r, c = np.nonzero(dist < np.inf)
            return pa.table([left.column("r").take(pa.array(r)), pa.array(other[r, c]), pa.array(dist[r, c])], ["r", "id", "dist"])

        return asking.groupBy("bundle", "g").cogroup(asked.groupBy("bundle", "g")).applyInArrow(search, "r long, id long, dist double")


def search(df: DataFrame, id_col: str, vector_col: str, k: int = 2, block: int = 2048) -> PivotSearch:
    if k < 1:
        raise ValueError("k has to be 1 at least")
    v = F.col(f"`{vector_col}`")
    if df.select(v).schema[0].dataType.simpleString() != "array<float>":  # floats are sent as they are, and compared as doubles
        v = v.cast("array<double>")
    whole = F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & whole)
    return PivotSearch(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")), k, block)


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 2, block: int = 2048) -> DataFrame:
    """(query, rank, neighbor, dist): the k nearest rows of every row by Euclidean distance, ties by id.

    A row is normally its own first neighbour; with fewer than k rows all are. Ids are longs. Null ids, and vectors that are null
    or hold null or non-finite components, take no part. block: about how many rows are compared at once.
    """
    return search(df, id_col, vector_col, k, block).result()
