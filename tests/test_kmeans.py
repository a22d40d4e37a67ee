import hashlib
import math

import numpy as np
import pytest

from lodestone.operators import kmeans


def frame(spark, xs, parts=3):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xs)], "id long, `a.b` double, `c d` double").repartition(parts)


def drawn(seed, step, i):
    return int(hashlib.md5(f"{seed}:{step}:{i}".encode()).hexdigest()[:12], 16) / 2**48


def plain_seeds(xs, k, seed, rounds=5):
    """k-means|| and weighted k-means++ by plain loops."""
    n = len(xs)
    d2 = lambda i, js: min(((xs[i] - xs[j]) ** 2).sum() for j in js)
    found, turn = {min(range(n), key=lambda i: (drawn(seed, "first", i), i))}, 0
    while True:
        turn += 1
        d = [d2(i, found) for i in range(n)]
        if not sum(d):
            break
        found |= {i for i in range(n) if drawn(seed, f"round {turn}", i) * sum(d) < 2.0 * k * d[i]}
        if turn >= rounds and len(found) >= k:
            break
    ids = sorted(found)
    weight = dict.fromkeys(ids, 0)
    for i in range(n):
        weight[min(ids, key=lambda j: (((xs[i] - xs[j]) ** 2).sum(), j))] += 1
    picks = []
    for j in range(k):
        rate = {i: weight[i] * (d2(i, picks) if picks else 1) for i in ids}
        open_ = [i for i in ids if rate[i] > 0]
        if not open_:
            break
        picks.append(min(open_, key=lambda i: -math.log1p(-drawn(seed, f"pick {j}", i)) / rate[i]))
    return [tuple(xs[picks[j % len(picks)]]) for j in range(k)]


@pytest.mark.parametrize("k", [3, 9])
def test_seeds_match_plain_loops(spark, k):
    xs = np.random.default_rng(k).normal(size=(150, 2)) * [1, 5]
    for parts in (1, 4):
        got = kmeans.seeded_starts(frame(spark, xs, parts), ["a.b", "c d"], k, [7, 8], "id")
        assert [np.allclose(g, plain_seeds(xs, k, s)) for g, s in zip(got, (7, 8))] == [True, True]


def test_candidates_are_drawn_by_squared_distance(spark):
    """A row at ten times the distance is a hundred times as likely."""
    candidates = [(0, (0.0,), 1), (1, (1.0,), 1), (2, (-10.0,), 1), (3, (2.0,), 1)]
    second = [kmeans.thinned(candidates, 2, s) for s in range(4000)]
    after_zero = [p[1][0] for p in second if p[0] == (0.0,)]
    share = np.array([after_zero.count(v) for v in (1.0, -10.0, 2.0)]) / len(after_zero)
    assert np.allclose(share, np.array([1, 100, 4]) / 105, atol=0.03)
    assert abs(np.mean([p[0] == (0.0,) for p in second]) - 0.25) < 0.03
    heavy = [kmeans.thinned([(0, (0.0,), 9), (1, (5.0,), 1)], 1, s)[0][0] for s in range(2000)]
    assert abs(np.mean(np.array(heavy) == 0) - 0.9) < 0.03


def test_few_different_rows(spark):
    same = frame(spark, [(1, 2)] * 30)
    assert kmeans.seeded_starts(same, ["a.b", "c d"], 3, [1], "id") == [[(1.0, 2.0)] * 3]
    two = frame(spark, [(1, 2)] * 30 + [(5, 5)])
    assert set(kmeans.seeded_starts(two, ["a.b", "c d"], 4, [1], "id")[0]) == {(1.0, 2.0), (5.0, 5.0)}
    assert kmeans.kmeans(two, ["a.b", "c d"], 4, init="k-means++", id_col="id").inertia == 0


def plain_lloyd(xs, centres, rounds=300):
    c = np.array(centres)
    for _ in range(rounds):
        at = ((xs[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([xs[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() <= 1e-9:
            break
        c = new
    return c, ((xs[:, None] - c) ** 2).sum(2).min(1).sum()


def test_runs_share_their_rounds(spark):
    xs = np.random.default_rng(3).normal(size=(200, 2))
    df = frame(spark, xs)
    runs = [[tuple(r) for r in xs[:k]] for k in (1, 2, 4, 7)]
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = kmeans.lloyd_all(df, ["a.b", "c d"], runs)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
    for (centres, inertia, rounds), start in zip(got, runs):
        want, sse = plain_lloyd(xs, start)
        assert np.allclose(centres, want) and inertia == pytest.approx(sse)
    longest = max(r for _, _, r in got)
    assert jobs <= 3 * (longest + 1)  # AQE runs a shuffle as two jobs


def test_restarts_and_elbow_agree_with_single_runs(spark):
    xs = np.random.default_rng(4).normal(size=(120, 2))
    df = frame(spark, xs)
    params = {"init": "k-means++", "id_col": "id"}
    each = [kmeans.kmeans(df, ["a.b", "c d"], 3, seed=s, **params).inertia for s in (42, 43)]
    sse = {r.k: r.sse for r in kmeans.elbow(df, ["a.b", "c d"], range(1, 4, 2), n_init=2, **params).collect()}
    assert sse == pytest.approx({1: ((xs - xs.mean(0)) ** 2).sum(), 3: min(each)})


def test_many_centres(spark):
    xs = np.random.default_rng(5).normal(size=(400, 2))
    df = frame(spark, xs).union(spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 1.0)], "id long, a double, b double"))
    model = kmeans.kmeans(df, ["a.b", "c d"], 100, init="k-means++", id_col="id", max_iter=3)
    assert len(model.centres) == 100
    got = {r.id: r.cluster for r in model.transform(df.where("id <> 901")).collect()}
    d = ((xs[:, None] - np.array(model.centres)) ** 2).sum(2)
    assert got == dict(enumerate(d.argmin(1).tolist())) | {900: None}
    assert model.inertia == pytest.approx(d.min(1).sum())


def test_errors(spark):
    df = frame(spark, [(1, 2), (3, 4)])
    for params in ({"init": "k-means++"}, {"init": "random"}, {"init": "other", "id_col": "id"}, {"k": 0}, {"k": 3}, {"n_init": 2}):
        with pytest.raises(ValueError):
            kmeans.kmeans(df, ["a.b"], **({"k": 2} | params))
