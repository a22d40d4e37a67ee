"""Embedding near-dedup: Int8 tile products with rigorous error bounds.

Vectors are dealt into stripes of a bounded size; each pair of stripes is one task's tile. In a tile unit vectors are
quantised to Int8, x = x' + e with x' = scale * q. Products q.q are exact integers, and |x.y - x'.y'| is at most
|e_x| |y'| + |x| |e_y| by Cauchy-Schwarz. Pairs whose interval lies on one side of the threshold are decided;
only the rest are computed in double precision. A tile returns for each vector its number of links and the least id
of its component within the tile, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

MOST_PARTITIONS = 100_000  # of tiles; beyond that a partition holds several


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled by their largest part first, so that no square overflows."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(Int8 codes, scale, length of the coded vector, length of the error) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    coded = q * scale[:, None]
    return q, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float, block: int = 256) -> np.ndarray:
    """Boolean matrix of cosine >= threshold for unit rows x and y."""
    qx, sx, cx, ex = quantise(x)
    qy, sy, cy, ey = quantise(y)
    # float32 holds integers exactly up to 2**24, so its fast products of Int8 codes are exact for that many parts
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left, right, sx, sy = qx.astype(kind), qy.T.astype(kind), sx.astype(kind)[:, None], sy.astype(kind)
    out = np.zeros((len(x), len(y)), bool)
    widest = ex.max() * cy.max() + (cx + ex).max() * ey.max() + 1e-5
    for a in range(0, len(x), block):
        near = left[a : a + block] @ right
        near *= sx[a : a + block]
        near *= sy
        r, c = np.nonzero(near >= threshold - widest)
        for k in range(0, len(r), 1 << 16):
            i, j = a + r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            # the last term covers the rounding of the scales and of the products with them
            slack, about = ex[i] * cy[j] + (cx[i] + ex[i]) * ey[j] + 1e-5, near[i - a, j]
            out[i, j] = sure = about - slack >= threshold
            doubt = ~sure & (about + slack >= threshold)
            i, j = i[doubt], j[doubt]
            out[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return out


def tile(reps: np.ndarray, copies: np.ndarray, x: np.ndarray, left: np.ndarray, same: bool, threshold: float) -> pd.DataFrame:
    """(rep, n, low) for the vectors of a tile that link with others in it.

    left: which rows are of the first stripe; same: whether the tile pairs a stripe with itself.
    """
    rows, cols = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
    if not len(rows) or not len(cols):
        return pd.DataFrame({"rep": reps[:0], "n": copies[:0], "low": reps[:0]})
    m = linked(x[rows], x[cols], threshold)
    if same:
        np.fill_diagonal(m, False)
    n = np.zeros(len(reps), np.int64)
    n[rows] += m @ copies[cols]
    if not same:
        n[cols] += copies[rows] @ m
    r, c = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
    low, m = reps.copy(), m[np.ix_(r, c)]
    top = np.iinfo(np.int64).max
    while len(r):  # least id in reach, step by step
        old = low.copy()
        for a in range(0, len(r), 256):
            k = rows[r[a : a + 256]]
            low[k] = np.minimum(low[k], np.where(m[a : a + 256], low[cols[c]], top).min(axis=1))
        for a in range(0, len(c), 256):
            k = cols[c[a : a + 256]]
            low[k] = np.minimum(low[k], np.where(m[:, a : a + 256].T, low[rows[r]], top).min(axis=1))
        if (low == old).all():
            break
    got = n > 0
    return pd.DataFrame({"rep": reps[got], "n": n[got], "low": low[got]})


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite parts."""
    big = F.lit(float("inf"))
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < big) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, stripe: int = 4096) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept.

    Links join vectors of one length with cosine >= threshold. Equal vectors are one node with a weight, found by
    a pre-aggregated grouping, so thousands of copies cost one row. Unusable vectors (see usable()) and rows with a null
    id have no links and are their own component. Rows that repeat an id and vector link with each other; an id with
    several vectors joins their components. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    reps = scratch.table(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    # a row for each length of vectors
    lengths = scratch.table(reps.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / stripe).alias("stripes")), "lengths")
    tiles = lengths.agg(F.sum(F.expr("stripes * (stripes + 1) / 2"))).first()[0] or 1
    dealt = reps.withColumn("dim", F.size("v")).join(lengths, "dim")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "v"), F.col("stripes")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)))
    # as stored, parts are mostly floats; they travel as such where nothing is lost
    small = dict(df.dtypes)[vector_col] == "array<float>"
    dealt = dealt.select("dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", F.col("v").cast("array<float>" if small else "array<double>").alias("v"))
    # dealt out by tile, in so many partitions: after the join rows lie by dim, and a few bytes are much work here
    dealt = dealt.repartition(int(min(tiles, MOST_PARTITIONS)), "dim", "i", "j")

    def run(rows: pa.Table) -> pa.Table:
        rep, copies, own, i, j = (rows.column(c).to_numpy() for c in ("rep", "copies", "own", "i", "j"))
        x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        return pa.Table.from_pandas(tile(rep, copies, unit(x), own == i, bool(i[0] == j[0]), threshold), preserve_index=False)

    found = scratch.table(dealt.groupBy("dim", "i", "j").applyInArrow(run, "rep long, n long, low long"), "found")
    parts = components(scratch, found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("id").alias("rep"), "component")
    reps = scratch.table(reps.join(links, "rep", "left").join(parts, "rep", "left").select(F.col("v").alias("_v"), "rep", "copies", "n", "component"), "reps")
    out = rows.withColumn("_key", F.when(F.col("vec_id").isNotNull() & usable(F.col("v")), F.col("v")))
    out = out.join(reps, F.col("_key") == F.col("_v"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").__add__(F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
