import tracemalloc

import numpy as np
import pytest

from lodestone.operators import knn


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "`i.d` long, v array<double>").repartition(parts)


def plain(rows, k):
    x = np.array([v for _, v in rows], float)
    ids = [i for i, _ in rows]
    out = {}
    for i, a in zip(ids, x):
        d = np.sqrt(np.cumsum((a - x) ** 2, axis=1)[:, -1])
        out[i] = [(j, float(v)) for v, j in sorted(zip(d.tolist(), ids))[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query, []).append((r.neighbor, r.dist))
        assert len(out[r.query]) == r.rank
    return out


@pytest.mark.parametrize(("seed", "dim", "k", "block"), [(1, 2, 3, 20), (2, 16, 2, 16), (3, 1, 5, 8)])
def test_matches_plain(spark, seed, dim, k, block):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, dim)) + 5 * rng.integers(0, 3, (300, 1))
    x[250:] = x[rng.integers(0, 30, 50)]  # some equal, one of them often
    x[280:] = x[0]
    if dim == 1:
        x = np.round(x, 1)
    rows = list(zip(rng.permutation(300).tolist(), x.tolist()))
    assert got(knn.nearest(frame(spark, rows), "i.d", "v", k, block)) == plain(rows, k)


def test_blocks_are_skipped(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, (3000, 2))
    rows = list(zip(range(3000), x.tolist()))
    s = knn.search(frame(spark, rows), "i.d", "v", 2, 100)
    assert s.pairs() < 0.2 * 3000**2
    assert got(s.result()) == plain(rows, 2)


def test_rings_of_a_full_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "PIVOTS", 1)
    monkeypatch.setattr(knn, "RINGS", 4)
    rng = np.random.default_rng(5)
    rows = list(zip(range(400), rng.uniform(0, 10, (400, 1)).tolist()))
    s = knn.search(frame(spark, rows), "i.d", "v", 2, 50)
    assert s.visits.count() and s.pairs() < 400**2 and len(s.cell) >= 8
    assert got(s.result()) == plain(rows, 2)


def test_edges(spark):
    nan = float("nan")
    rows = [(1, [0, 0]), (2, [3, 4]), (3, None), (4, [None, 1]), (5, [nan, 1]), (None, [0, 0])]
    assert got(knn.nearest(frame(spark, rows), "i.d", "v", 3)) == {1: [(1, 0.0), (2, 5.0)], 2: [(2, 0.0), (1, 5.0)]}
    assert knn.nearest(frame(spark, rows[2:3]), "i.d", "v").count() == 0
    same = [(i, [1, 2]) for i in range(500)]
    assert got(knn.nearest(frame(spark, same), "i.d", "v", 2, 8)) == {i: [(0, 0.0), (1, 0.0)] for i in range(500)}
    with pytest.raises(ValueError):
        knn.nearest(frame(spark, rows), "i.d", "v", 0)
    with pytest.raises(ValueError):
        knn.nearest(frame(spark, [(1, [1]), (2, [1, 2])]), "i.d", "v")


def test_rows_without_structure_are_sent_to_few_bundles(spark):
    """A row was sent to every block it had to look at, some 100 here, so that what was sent grew with the square of the rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = list(zip(range(1500), x.tolist()))
    frames = [frame(spark, rows), spark.createDataFrame(rows, "`i.d` long, v array<float>").repartition(3)]
    for df in frames:
        s = knn.search(df, "i.d", "v", 3, 16)
        assert s.visits.count() <= 25 * 1500 and len(s.cell) > 90
        assert got(s.result()) == plain(rows, 3)


def test_pivots_take_bounded_memory():
    rng = np.random.default_rng(7)
    x, pivots = rng.normal(size=(10_000, 2)), rng.normal(size=(knn.PIVOTS, 2))
    tracemalloc.start()
    cell = knn._closest(x, pivots)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 << 20  # all at once, 250 MB
    assert cell[::1000].tolist() == [int(((a - pivots) ** 2).sum(axis=1).argmin()) for a in x[::1000]]
