"""Vector code compression: product codes over integer parts, nearest entries by branch and bound in ball trees.

Vectors of integers are cut into parts; for each part position a codebook of entries is fitted by a few rounds of
assignment and averaging (product quantisation: Jegou, Douze and Schmid 2011). The entries of a position lie in a ball
tree (Omohundro 1989), built anew each round on the driver, as codebooks are of a fixed size. A row first goes down to
the leaf of the nearer centres, then visits every other ball that may hold an entry as near as the best so far: radii are
rounded up, distances to centres down, and a ball at just that distance is visited, as it may hold an equal entry of a
lower number. Distances to entries are exact integers, so nothing depends on rounding.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch

LEAF = 16  # entries
LARGEST = 1 << 26  # size of an integer component, so that sums of squares fit 64 bits


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to entries."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:  # then all sums are integers that doubles hold
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def below(d2: np.ndarray) -> np.ndarray:
    """An integer not above the root."""
    return np.floor(np.sqrt(d2.astype(np.float64)) * (1 - 2.0**-50)).astype(np.int64)


def above(d2: np.ndarray) -> np.ndarray:
    """An integer not below the root."""
    return np.ceil(np.sqrt(d2.astype(np.float64)) * (1 + 2.0**-50)).astype(np.int64)


@dataclass
class Ball:
    """Entries within an integer radius of a centre: a leaf with their numbers in ascending order, or two balls."""

    centre: np.ndarray
    radius: int
    numbers: np.ndarray
    inner: tuple[Ball, ...] = ()


def grown(entries: np.ndarray, numbers: np.ndarray | None = None) -> Ball:
    """The tree over entries. A ball is halved by which of two far entries its entries are nearer to."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    own = entries[numbers]
    centre = np.rint(own.mean(axis=0)).astype(np.int64)
    from_centre = squares(centre[None], own)[0]
    ball = Ball(centre, int(above(from_centre).max()), numbers)
    if len(numbers) > LEAF:
        one = squares(own[from_centre.argmax()][None], own)[0]
        other = squares(own[one.argmax()][None], own)[0]
        order = np.argsort(one - other, kind="stable")
        half = len(order) // 2
        ball.inner = tuple(grown(entries, np.sort(numbers[k])) for k in (order[:half], order[half:]))
    return ball


def nearest(tree: Ball, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest entry of each row, of equally near ones the lowest."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)

    def verify(leaf: Ball, rows: np.ndarray) -> None:
        d2 = squares(x[rows], entries[leaf.numbers])
        k = d2.argmin(axis=1)
        d2, number = d2[np.arange(len(rows)), k], leaf.numbers[k]
        better = (d2 < best[rows]) | (d2 == best[rows]) & (number < at[rows])
        best[rows[better]], at[rows[better]] = d2[better], number[better]

    home = np.zeros(len(x), np.int64)
    todo = [(tree, np.arange(len(x)))]
    while todo:  # down to the nearer centres
        ball, rows = todo.pop()
        if not len(rows):
            continue
        if ball.inner:
            left, right = (squares(x[rows], b.centre[None])[:, 0] for b in ball.inner)
            todo += [(ball.inner[0], rows[left <= right]), (ball.inner[1], rows[left > right])]
        else:
            verify(ball, rows)
            home[rows] = ball.numbers[0]
    todo = [(tree, np.arange(len(x)))]
    while todo:  # every other ball that may hold an entry as near
        ball, rows = todo.pop()
        if not ball.inner:
            rows = rows[home[rows] != ball.numbers[0]]
            if len(rows):
                verify(ball, rows)
            continue
        for b in ball.inner:
            near = below(squares(x[rows], b.centre[None])[:, 0]) - b.radius <= above(best[rows])
            if near.any():
                todo.append((b, rows[near]))
    return at, best


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part position, and vectors of so many components as they are for."""

    entries: tuple[np.ndarray, ...]
    width: int
    scale: float
    trees: tuple[Ball, ...] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "trees", tuple(grown(e) for e in self.entries))

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each row of integers and part position."""
        cut = np.split(x, len(self.entries), axis=1)
        number, d2 = zip(*[nearest(t, e, p) for t, e, p in zip(self.trees, self.entries, cut)])
        return np.stack(number, axis=1), np.stack(d2, axis=1)

    def sha256(self) -> str:
        """Of all entries' integers, by part position, entry and place, as decimal text joined by commas."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()

    def encode(self, q: DataFrame) -> DataFrame:
        """q with `numbers` (array of an entry's number for each part) and `error` instead of q, an array of integers."""
        names = [c for c in q.columns if c != "q"]

        def run(batches):
            for batch in batches:
                number, d2 = self.search(matrix(batch.column(len(names)), self.width))
                flat = pa.ListArray.from_arrays(np.arange(len(number) + 1, dtype=np.int32) * len(self.entries), pa.array(number.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], flat, pa.array(d2.sum(axis=1))], [*names, "numbers", "error"])

        return q.select(*names, "q").mapInArrow(run, StructType([*[q.schema[c] for c in names], *StructType.fromDDL("numbers array<int>, error long").fields]))

    def decode(self, coded: DataFrame, out: str = "embedding") -> DataFrame:
        """Adds the vector that `numbers` stand for: the middles of the integers' cells, end to end."""
        kept = [F.array(*[F.array(*[F.lit((v + 0.5) / self.scale) for v in e]) for e in part.tolist()]) for part in self.entries]
        return coded.withColumn(out, F.flatten(F.array(*[F.get(k, F.get("numbers", F.lit(j))) for j, k in enumerate(kept)])))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    flat = column.flatten().to_numpy()
    size = pc.list_value_length(column).to_numpy()
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def whole_numbers(df: DataFrame, vector_col: str, scale: float, keep: list[str]) -> DataFrame:
    """keep and q, the integers floor(scale * x); vectors that are null or hold null or non-finite components go."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    rows = df.where(v.isNotNull() & fine)
    return rows.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))


def averaged(q: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of the parts nearest to it. Tasks send a row for each entry."""
    parts, width = len(books.entries), books.width // len(books.entries)

    def partial(batches):
        n = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            x = matrix(batch.column(0), books.width)
            number, _ = books.search(x)
            for k, part in enumerate(np.split(x, parts, axis=1)):
                order = np.argsort(number[:, k], kind="stable")
                which, first = np.unique(number[order, k], return_index=True)
                if len(which):
                    n[k][which] += np.diff(np.r_[first, len(order)])
                    total[k][which] += np.add.reduceat(part[order], first, axis=0)
        used = [np.flatnonzero(c) for c in n]
        flat = np.concatenate([t[u] for t, u in zip(total, used)])
        sums = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * width, pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts, dtype=np.int32), [len(u) for u in used])), pa.array(np.concatenate(used).astype(np.int32)), pa.array(np.concatenate([c[u] for c, u in zip(n, used)])), sums], ["part", "entry", "n", "sums"])

    made = q.select("q").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    got = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums")).collect()
    new = [e.copy() for e in books.entries]
    for r in got:
        new[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return Codebooks(tuple(new), books.width, books.scale)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> tuple[DataFrame, Codebooks]:
    """((vec_id, numbers, error, label_error), codebooks): one row for each vector that is kept.

    Components become floor(scale * x); vectors are cut into equal consecutive parts. The first codebooks are the parts of the
    `entries` smallest ids; in each round parts go to the nearest entry, ties to the lower number, and entries become the
    floors of their parts' means; unused ones stay. error: the final squared distances of a vector's parts, summed;
    label_error: their sum over all rows of that label, rows without a label together (null if there is no label_col).

    Vectors that are null or hold null or non-finite components are dropped. Null ids come after all others; rows that share
    an id go by their integers, repeated rows count each. Vectors shorter than the longest, or whose length the parts do not
    divide, are taken to end in zeros. A component of LARGEST or more after scaling is a ValueError. A table without usable
    vectors gives no rows; other columns are left out.
    """
    scratch = Scratch(df.sparkSession)
    q = scratch.table(whole_numbers(df, vector_col, scale, [id_col, *([label_col] if label_col else [])]), "whole")
    most = q.agg(F.max(F.size("q")).alias("size"), F.max(F.array_max(F.transform("q", lambda x: F.greatest(x, -x)))).alias("top")).first()
    if (most["top"] or 0) >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling")
    width = -(-(most["size"] or 0) // parts) * parts
    first = q.orderBy(F.col("c0").asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = np.array([r["q"] + [0] * (width - len(r["q"])) for r in first], np.int64).reshape(len(first), width)
    if not width:  # no vectors, or none with a component: nothing to tell apart
        books = Codebooks(tuple(np.zeros((1, 0), np.int64) for _ in range(parts)), 0, scale)
    else:
        books = Codebooks(tuple(np.split(start, parts, axis=1)), width, scale)
        for _ in range(rounds):
            books = averaged(q, books)
    coded = scratch.table(books.encode(q), "coded")
    out = coded.select(F.col("c0").alias("vec_id"), "numbers", "error", *(["c1"] if label_col else []))
    if not label_col:
        return out.withColumn("label_error", F.lit(None).cast("long")), books
    # a row for each label; Spark broadcasts the table if its files are small
    sums = scratch.table(coded.groupBy(F.col("c1").alias("label")).agg(F.sum("error").alias("label_error")), "label_errors")
    out = out.join(sums, F.col("c1").eqNullSafe(F.col("label")), "left").select("vec_id", "numbers", "error", "label_error")
    return out, books
