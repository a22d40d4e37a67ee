"""k-means by Lloyd's rounds as grouped averages, deterministic whatever the partitioning.

Several starts, or several numbers of clusters, share their rounds: a round is one job over the rows, whatever the number
of starts. Starts are spread along the first feature, drawn by hash, or seeded by k-means|| (Bahmani et al. 2012), which
draws rows in proportion to their squared distance from what is drawn already, many at a time, and thins them out by k-means++.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import squared_distance
from .profile import quantiles

Centres = list[tuple[float, ...]]

EXPRESSED = 16  # centres that make an expression; more are compared in batches, as compiling them takes longer
UNITS = 1 << 48  # of drawn numbers: twelve hexadecimal digits of a digest


def _cols(features: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in features]


def nearest_centre(features: Sequence[str], centres: Centres) -> Column:
    """Struct (d2, cluster) of the nearest centre; ties go to the lower number. Features must not be null."""
    if len(centres) <= EXPRESSED:
        at = [F.struct(squared_distance(_cols(features), [F.lit(float(v)) for v in c]).alias("d2"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)]
        return F.array_min(F.array(*at))
    table = np.array(centres, float)

    @F.pandas_udf("d2 double, cluster int")
    def run(*x: pd.Series) -> pd.DataFrame:
        d2 = np.zeros((len(x[0]), len(table)))
        for j, column in enumerate(x):  # in the order of the features, as the expression adds them
            d = column.to_numpy(float)[:, None] - table[:, j]
            d2 += d * d
        at = d2.argmin(axis=1)
        return pd.DataFrame({"d2": d2[np.arange(len(at)), at], "cluster": at.astype(np.int32)})

    return run(*_cols(features))


@dataclass(frozen=True)
class KMeansModel:
    """Centres in ascending order, the sum of squared distances to them, and the rounds taken."""

    features: tuple[str, ...]
    centres: tuple[tuple[float, ...], ...]
    inertia: float
    rounds: int

    def transform(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        """Adds the number of the nearest centre; null where a feature is. Works on a stream as well."""
        full = reduce(lambda a, b: a & b, [c.isNotNull() for c in _cols(self.features)])
        if len(self.centres) <= EXPRESSED:
            return df.withColumn(out, F.when(full, nearest_centre(self.features, list(self.centres))["cluster"]))

        table, features = list(self.centres), [F.coalesce(c, F.lit(0.0)) for c in _cols(self.features)]
        names = [f"_{out}_{j}" for j in range(len(features))]  # a batch function sees every row
        near = df.withColumns(dict(zip(names, features))).withColumn(out, nearest_centre(names, table)["cluster"]).drop(*names)
        return near.withColumn(out, F.when(full, F.col(f"`{out}`")))

    def summary(self, df: DataFrame) -> DataFrame:
        """(cluster, n_points, c0, c1, ...) for every cluster, empty ones with 0."""
        rows = [(k, *map(float, c)) for k, c in enumerate(self.centres)]
        keys = df.sparkSession.createDataFrame(rows, "cluster int, " + ", ".join(f"c{j} double" for j in range(len(self.features))))
        n = self.transform(df).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_points"))
        return keys.join(n, "cluster", "left").select("cluster", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), *[f"c{j}" for j in range(len(self.features))])


# ---- starts


def drawn(seed: int, step: str, row_id: Column) -> Column:
    """An even number from 0 up to 1 that depends on seed, step and row only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{step}:"), row_id.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(UNITS))


def _drawn(seed: int, step: str, row_id) -> float:
    return int(hashlib.md5(f"{seed}:{step}:{row_id}".encode()).hexdigest()[:12], 16) / UNITS


def spread_starts(df: DataFrame, features: Sequence[str], ks: Sequence[int]) -> list[Centres]:
    """For each k the even quantiles of the first feature and the means of the others, looked up together."""
    mean = df.agg(*[F.avg(c).alias(f"m{j}") for j, c in enumerate(_cols(features))]).first()
    at = sorted({(i + 0.5) / k for k in ks for i in range(k)})
    value = dict(zip(at, quantiles(df, features[0], at)))
    return [[(value[(i + 0.5) / k], *mean[1:]) for i in range(k)] for k in ks]


def random_starts(df: DataFrame, features: Sequence[str], k: int, seeds: Sequence[int], id_col: str) -> list[Centres]:
    """For each seed the k rows of least md5(seed:id), in one job."""
    row_id = F.col(f"`{id_col}`")

    def least(n: int, seed: int) -> DataFrame:
        order = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
        return df.orderBy(order, row_id).limit(k).select(F.lit(n).alias("n"), order.alias("o"), row_id.alias("id"), F.array(*_cols(features)).alias("x"))

    got = reduce(DataFrame.union, [least(n, s) for n, s in enumerate(seeds)]).collect()
    return [[tuple(r["x"]) for r in sorted((r for r in got if r["n"] == n), key=lambda r: (r["o"], r["id"]))] for n in range(len(seeds))]


def thinned(candidates: list[tuple[object, tuple[float, ...], int]], k: int, seed: int) -> Centres:
    """k of the candidates (id, centre, weight) by weighted k-means++; fewer different ones are repeated.

    A candidate wins a draw with a chance in proportion to its weight times the squared distance from those taken: of
    exponential waiting times at these rates the shortest is taken.
    """
    x = np.array([c for _, c, _ in candidates], float)
    rate = np.array([w for _, _, w in candidates], float)
    near, out = np.full(len(x), np.inf), []
    for j in range(k):
        chance = rate * near if j else rate
        if not (chance > 0).any():
            break
        wait = [-math.log1p(-_drawn(seed, f"pick {j}", i)) / c if c > 0 else math.inf for (i, _, _), c in zip(candidates, chance)]
        at = int(np.argmin(wait))
        out.append(tuple(x[at].tolist()))
        near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))
    return [out[j % len(out)] for j in range(k)]


def seeded_starts(df: DataFrame, features: Sequence[str], k: int, seeds: Sequence[int], id_col: str, rounds: int = 5, oversampling: float = 2.0) -> list[Centres]:
    """Starts by k-means||, for all seeds in the same jobs.

    The first candidate of a seed is the row of the least drawn number. In each round a row becomes a candidate with the
    chance oversampling * k * d2 / total, d2 being its squared distance from the candidates so far and total their
    sum. Candidates, about oversampling * k a round, are weighted by the rows nearest to them (ties to the smaller id) and
    thinned out on the driver. Rounds go on while there are fewer than k candidates and other rows. Features must not be
    null, ids must be unique; where rows lie, and their order, only move the last digits of the totals.
    """
    row_id, x = F.col(f"`{id_col}`"), F.array(*_cols(features))
    first = df.agg(*[F.min_by(F.struct(row_id.alias("id"), x.alias("x")), F.struct(drawn(s, "first", row_id), row_id)).alias(f"s{n}") for n, s in enumerate(seeds)]).first()
    found: list[dict] = [{r["id"]: tuple(r["x"])} for r in first]
    near = lambda n: nearest_centre(features, [found[n][i] for i in sorted(found[n])])
    todo, turn = list(range(len(seeds))), 0
    while todo:
        turn += 1
        total = df.agg(*[F.sum(near(n)["d2"]).alias(f"s{n}") for n in todo]).first()
        todo = [n for n in todo if total[f"s{n}"] > 0]
        if not todo:
            break
        hit = [F.when(drawn(seeds[n], f"round {turn}", row_id) * F.lit(total[f"s{n}"]) < F.lit(float(oversampling * k)) * near(n)["d2"], F.lit(n)) for n in todo]
        for r in df.select(F.explode(F.array_compact(F.array(*hit))).alias("n"), row_id.alias("id"), x.alias("x")).collect():
            found[r["n"]][r["id"]] = tuple(r["x"])
        todo = [n for n in todo if turn < rounds or len(found[n]) < k]
    nearest = F.array(*[F.struct(F.lit(n).alias("n"), near(n)["cluster"].alias("c")) for n in range(len(seeds))])
    weights = df.select(F.explode(nearest).alias("at")).groupBy("at.n", "at.c").agg(F.count(F.lit(1)).alias("w")).collect()
    out = []
    for n, seed in enumerate(seeds):
        ids, w = sorted(found[n]), {r["c"]: r["w"] for r in weights if r["n"] == n}
        out.append(thinned([(i, found[n][i], w.get(c, 0)) for c, i in enumerate(ids)], k, seed))
    return out


def starts(df: DataFrame, features: Sequence[str], k: int, init: Centres | str | None, n_init: int, seed: int, id_col: str | None) -> list[Centres]:
    if isinstance(init, list):
        return [init]
    kind = init or ("random" if n_init > 1 else "spread")
    if kind == "spread":
        return spread_starts(df, features, [k])
    makers = {"random": random_starts, "k-means++": seeded_starts}
    if kind not in makers:
        raise ValueError(f"init has to be centres, spread, {' or '.join(makers)}")
    if id_col is None:
        raise ValueError(f"{kind} starts need id_col")
    return makers[kind](df, features, k, range(seed, seed + n_init), id_col)


# ---- rounds


def lloyd_all(df: DataFrame, features: Sequence[str], runs: list[Centres], max_iter: int = 300, tol: float = 1e-9) -> list[tuple[Centres, float, int]]:
    """(centres, inertia, rounds) of each run: rounds until none of its centres moves by more than tol, or max_iter.

    A round is one job for all runs that still move; what reaches the driver is a row for each run and cluster. A centre
    without points stays.
    """
    runs, taken, todo = [list(r) for r in runs], [0] * len(runs), list(range(len(runs)))
    x = [c.alias(f"x{j}") for j, c in enumerate(_cols(features))]
    for turn in range(1, max_iter + 1):
        if not todo:
            break
        near = F.array(*[F.struct(F.lit(n).alias("n"), nearest_centre(features, runs[n])["cluster"].alias("c")) for n in todo])
        got = df.select(F.explode(near).alias("at"), *x).groupBy("at.n", "at.c").agg(*[F.avg(f"x{j}").alias(f"m{j}") for j in range(len(x))]).collect()
        new = {n: list(runs[n]) for n in todo}
        for r in got:
            new[r["n"]][r["c"]] = tuple(r[f"m{j}"] for j in range(len(x)))
        moved = {n: max(abs(a - b) for p, q in zip(new[n], runs[n]) for a, b in zip(p, q)) for n in todo}
        for n in todo:
            runs[n], taken[n] = new[n], turn
        todo = [n for n in todo if moved[n] > tol]
    sums = df.agg(*[F.sum(nearest_centre(features, r)["d2"]).alias(f"s{n}") for n, r in enumerate(runs)]).first()
    return [(r, float(s or 0.0), t) for r, s, t in zip(runs, sums, taken)]


def lloyd(df: DataFrame, features: Sequence[str], centres: Centres, max_iter: int = 300, tol: float = 1e-9) -> tuple[Centres, float, int]:
    """lloyd_all() for one run."""
    return lloyd_all(df, features, [centres], max_iter, tol)[0]


def complete(df: DataFrame, features: Sequence[str], id_col: str | None = None) -> DataFrame:
    """(id, x0, x1, ...): the features as doubles, of the rows that have all; without id_col no id."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in _cols(features)])
    key = [F.col(f"`{id_col}`").alias("id")] if id_col else []
    return df.where(known).select(*key, *[c.alias(f"x{j}") for j, c in enumerate(_cols(features))])


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, init: Centres | str | None = None, n_init: int = 1, seed: int = 42, id_col: str | None = None, max_iter: int = 300, tol: float = 1e-9) -> KMeansModel:
    """Fits k centres to rows with all features present.

    init: centres, "spread" (even quantiles of the first feature, the default), "random" (the default with n_init > 1) or
    "k-means++". Of n_init seeded starts the one of least inertia wins. Raises ValueError unless 0 < k <= rows.
    """
    return _fitted(df, features, [k], init, n_init, seed, id_col, max_iter, tol)[0]


def elbow(df: DataFrame, features: Sequence[str], ks: range = range(1, 6), **params) -> DataFrame:
    """(k, sse) for each k; all of them take their rounds together. params are those of kmeans()."""
    models = _fitted(df, features, list(ks), **params)
    return df.sparkSession.createDataFrame([(k, m.inertia) for k, m in zip(ks, models)], "k int, sse double")


def _fitted(df, features, ks, init=None, n_init=1, seed=42, id_col=None, max_iter=300, tol=1e-9) -> list[KMeansModel]:
    rows = complete(df, features, id_col).persist()  # each round reads them
    try:
        n = rows.count()
        if not ks or not all(0 < k <= n for k in ks):
            raise ValueError(f"k has to be between 1 and the number of rows, {n}")
        x, key = [f"x{j}" for j in range(len(features))], "id" if id_col else None
        if init == "spread" or init is None and n_init == 1:
            begun = [[s] for s in spread_starts(rows, x, ks)]
        else:
            begun = [starts(rows, x, k, init, n_init, seed, key) for k in ks]
        done = lloyd_all(rows, x, [s for runs in begun for s in runs], max_iter, tol)
    finally:
        rows.unpersist()
    models = []
    for runs in begun:
        own, done = done[: len(runs)], done[len(runs) :]
        centres, inertia, rounds = min(own, key=lambda r: r[1])
        models.append(KMeansModel(tuple(features), tuple(sorted(centres)), inertia, rounds))
    return models
