import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dbscan


def points(spark, xs, parts=3):
    cols = ", ".join(f"`f.{k}` double" for k in range(len(xs[0])))
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xs)], f"id long, {cols}").repartition(parts)


def plain(xs, eps, least):
    """Components of core points by spreading the least number; borders take the least cluster."""
    x = np.array(xs, float)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    low = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core, low, len(x)).min(1), len(x))
        if (new == low).all():
            break
        low = new
    number = {c: k for k, c in enumerate(sorted(set(low[core])))} | {len(x): -1}
    border = np.where(near & core, low, len(x)).min(1)
    return [number[c] for c in np.where(core, low, border)], core.tolist()


def check(spark, xs, eps, least, parts=3):
    d = len(xs[0])
    got = dbscan.dbscan(points(spark, xs, parts), "id", [f"f.{k}" for k in range(d)], eps=eps, min_samples=least, scale=False).orderBy("id").collect()
    assert ([r.cluster for r in got], [r.is_core for r in got]) == plain(xs, eps, least)


@pytest.mark.parametrize(("seed", "d", "eps", "least"), [(1, 1, 0.02, 4), (2, 2, 0.2, 5), (3, 3, 0.45, 6), (4, 5, 0.9, 5)])
def test_matches_plain(spark, seed, d, eps, least):
    rng = np.random.default_rng(seed)
    homes = rng.uniform(-2, 2, (6, d))
    xs = np.round(homes[rng.integers(6, size=350)] + rng.normal(size=(350, d)) * rng.choice([0.05, 0.3, 1], (350, 1)), 2)
    check(spark, [*xs.tolist(), *xs[:40].tolist()], eps, least)


def test_large_boxes_are_halved(spark, monkeypatch):
    monkeypatch.setattr(dbscan, "LISTED", 1)
    monkeypatch.setattr(dbscan, "DEALT", 3)
    monkeypatch.setattr(dbscan, "FEW", 2)
    rng = np.random.default_rng(9)
    # two strips whose nearest points are eps apart or a little more
    strip = rng.uniform(0, 1, (60, 2)) * [0.3, 0.5]
    for gap in (0.5, 0.5001):
        other = rng.uniform(0, 1, (60, 2)) * [0.3, 0.5] + [0.3 + gap, 0]
        xs = [*strip.tolist(), *other.tolist(), (0.3, 0.25), (0.3 + gap, 0.25), (3, 3), (0.15, -0.45)]
        check(spark, xs, 0.5, 4)


def test_a_hundred_thousand_equal_rows(spark):
    df = spark.range(100_000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    df = df.union(spark.createDataFrame([(100_000, 1.3, 2.0), (100_001, 9.0, 9.0)], "id long, x double, y double"))
    got = dbscan.dbscan(df, "id", ["x", "y"], eps=0.5, min_samples=10, scale=False)
    assert sorted(map(tuple, got.groupBy("cluster", "is_core").count().collect())) == [(-1, False, 1), (0, True, 100_001)]
    counts = dbscan.neighbor_counts(df, "id", ["x", "y"], 0.5).groupBy("n_neighbors").count()
    assert sorted(map(tuple, counts.collect())) == [(1, 1), (100_001, 100_001)]


@pytest.mark.parametrize("few", [1, 64])
def test_neighbor_counts(spark, monkeypatch, few):
    monkeypatch.setattr(dbscan, "FEW", few)
    rng = np.random.default_rng(12)
    x = np.round(np.concatenate([rng.normal(size=(200, 2)) * 0.2, rng.uniform(-2, 2, (60, 2))]), 2)
    x = np.concatenate([x, x[:20]])
    got = dbscan.neighbor_counts(points(spark, x.tolist()), "id", ["f.0", "f.1"], 0.3).orderBy("id").collect()
    assert [r.n_neighbors for r in got] == (np.sqrt(((x[:, None] - x) ** 2).sum(-1)) <= 0.3).sum(1).tolist()


def test_full_cells_side_by_side(spark):
    """40,000 different points in a strip: all core, one cluster, though their pairs are 10^9."""
    df = spark.range(40_000).select("id", (F.col("id") / 40_000).alias("x"), F.pmod(F.xxhash64("id"), F.lit(1000)).__truediv__(1000).alias("y"))
    got = dbscan.dbscan(df, "id", ["x", "y"], eps=0.4, min_samples=10, scale=False)
    assert [tuple(r) for r in got.groupBy("cluster", "is_core").count().collect()] == [(0, True, 40_000)]


def test_ids_and_missing(spark):
    df = spark.createDataFrame([("b", 0.0), ("a", 0.1), ("c", None), ("d", float("nan")), ("e", 5.0), ("f", 5.1)], "id string, `x.y` double")
    got = dbscan.dbscan(df, "id", ["x.y"], eps=0.2, min_samples=2, scale=False)
    assert sorted((r.id, r.cluster) for r in got.collect()) == [("a", 0), ("b", 0), ("e", 1), ("f", 1)]
    assert dbscan.dbscan(df.limit(0), "id", ["x.y"], scale=False).count() == 0
    for params in ({"eps": 0.0}, {"min_samples": 0}):
        with pytest.raises(ValueError):
            dbscan.dbscan(df, "id", ["x.y"], **params)
