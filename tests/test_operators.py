import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.functions.scratch import Scratch
from lodestone.operators import dbscan, graph, hdbscan, kmeans, mlp, neighbors, optics, pca, prepare, profile, sentiment
from lodestone.streaming import scoring


def points(spark, xs, parts=3):
    cols = ", ".join(f"x{k} double" for k in range(len(xs[0])))
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xs)], f"id long, {cols}").repartition(parts)


def scattered(seed, n, spread=0.35):
    rng = random.Random(seed)
    homes = [(0, 0), (4, 0), (2, 3)]
    return [(round(h[0] + rng.gauss(0, spread), 2), round(h[1] + rng.gauss(0, spread), 2)) if rng.random() < 0.85 else (round(rng.uniform(-2, 6), 2), round(rng.uniform(-2, 5), 2)) for h in (rng.choice(homes) for _ in range(n))]


def distances(xs):
    a = np.array(xs, float)
    return np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))


# ---- profiles and preparation


def test_describe_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,), (float("nan"),)], "x double")
    r = profile.describe(df).first()
    assert (r["count"], r.p25, r.p50, r.p75, r["max"]) == (4, 1.75, 3.0, 5.0, 8.0)
    s = prepare.standardise(df, ["x"]).where("x is not null").collect()
    assert s[0].x == pytest.approx((1 - 3.75) / 2.680951323690902)


def test_distributed_quantiles(spark):
    rng = random.Random(4)
    xs = [float(rng.randrange(40)) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in xs] + [(None,)], "x double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert profile.quantiles(df, "x", qs) == pytest.approx(np.quantile(xs, qs).tolist())
    assert profile.describe(df, in_one_pass=0).collect() == profile.describe(df).collect()
    assert profile.quantiles(df.limit(0), "x", [0.5]) == [None]
    assert prepare.fill_statistics(df, ["x"], "median", in_one_pass=0) == {"x": float(np.median(xs))}


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "a double, b double")
    for f in (prepare.standardise, prepare.min_max):
        assert {r.a for r in f(df, ["a", "b"]).collect()} == {0.0}


def test_coercion(spark):
    raw = ["3.82", "", "n/a", "NA", "4,0", "1e3", "3d", " 7 ", "NaN", "inf", "1_000", "0x10", None]
    df = prepare.coerce(spark.createDataFrame([(v,) for v in raw], "v string"), ["v"])
    assert [r.v for r in df.collect()] == [3.82, None, None, None, None, 1000.0, None, 7.0, None, None, None, None, None]


def test_pairwise_complete_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 5.0), (3.0, None), (4.0, 4.0)], "a double, b double")
    got = {(r.col_a, r.col_b): r.r for r in profile.correlations(df).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 5, 4])[0, 1]) and got["a", "a"] == 1


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None)], "x double, y double")
    assert prepare.impute(df, ["x"], "median").where("x = 2.5").count() == 1
    with pytest.raises(ValueError, match="y"):
        prepare.impute(df, ["y"])
    assert prepare.dropped_rows(df, ["x"]).first().n_dropped == 1
    with pytest.raises(ValueError):
        prepare.prepare_features(df, ["y"])


def test_encoding_and_choice(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "g string")
    assert sorted(map(tuple, prepare.one_hot(df, ["g"]).collect())) == [(0, 0), (0, 1), (1, 0)]
    assert prepare.pick_features(" a, 2,,", ["a", "b", "c"]) == ["a", "c"] and prepare.pick_features("", ["a"], ["z"]) == ["z"]
    with pytest.raises(ValueError):
        prepare.pick_features("9", ["a"])
    with pytest.raises(ValueError):
        prepare.rename_all(df, ["a", "b"])
    with pytest.raises(ValueError):
        prepare.require_numeric(df, ["g"])
    assert [r[0] for r in df.select(scalars.recode(F.col("g"), "a")).collect()] == [0, 1, 0]


def test_positions_and_fixed_labels(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "id long").repartition(6)
    assert all(r.pos == r.id for r in prepare.row_positions(df, "id", Scratch(spark)).collect())
    d = sentiment.distribution(spark.createDataFrame([("positive",)] * 3 + [("negative",)], "label string"))
    assert {r.label: (r.n, r.percent) for r in d.collect()} == {"positive": (3, 75.0), "neutral": (0, 0.0), "negative": (1, 25.0)}
    empty = sentiment.distribution(spark.createDataFrame([], "label string"))
    assert {r.percent for r in empty.collect()} == {0.0}


# ---- neighbourhoods and clusters


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbourhoods(spark, seed):
    xs = scattered(seed, 70)
    d = distances(xs)
    pairs = neighbors.eps_pairs(points(spark, xs), "id", ["x0", "x1"], 0.4)
    got = {(r.src, r.dst) for r in pairs.collect()}
    want = {(a, b) for a in range(70) for b in range(70) if math.sqrt((xs[a][0] - xs[b][0]) ** 2 + (xs[a][1] - xs[b][1]) ** 2) <= 0.4}
    assert got == want
    core = {r.id: r.core_distance for r in neighbors.core_distances(pairs, 4).collect()}
    for a in range(70):
        near = sorted(d[a][[b for _, b in sorted(want) if _ == a]])
        assert core[a] == (pytest.approx(near[3]) if len(near) >= 4 else None)
    knn = neighbors.nearest(points(spark, xs).select("id", F.array("x0", "x1").alias("v")), "id", "v", 3, block=16)
    for r in knn.collect():
        order = sorted(range(70), key=lambda b: (d[r.query][b], b))
        assert r.neighbor == order[r.rank - 1] or r.dist == pytest.approx(d[r.query][order[r.rank - 1]])


def test_boundary_is_inclusive_and_duplicates(spark):
    parts = lambda xs, eps: neighbors.neighbor_counts(neighbors.eps_pairs(points(spark, xs), "id", ["x0"], eps))
    assert sorted((r.id, r.n_neighbors) for r in parts([(0,), (1,), (2,), (10,), (11,)], 1.0).collect()) == [(0, 2), (1, 3), (2, 2), (3, 2), (4, 2)]
    same = neighbors.eps_pairs(points(spark, [(3,)] * 6), "id", ["x0"], 0.5)
    assert {r.core_distance for r in neighbors.core_distances(same, 6).collect()} == {0.0}
    with pytest.raises(ValueError):
        neighbors.eps_pairs(points(spark, [(1,)]), "id", ["x0"], 0)


def dbscan_by_queue(xs, eps, least):
    """Textbook expansion in order of ids."""
    d, n = distances(xs), len(xs)
    near = [[b for b in range(n) if d[a][b] <= eps] for a in range(n)]
    label, c = [None] * n, -1
    for a in range(n):
        if label[a] is not None or len(near[a]) < least:
            continue
        c += 1
        queue = [a]
        label[a] = c
        while queue:
            p = queue.pop(0)
            if len(near[p]) >= least:
                for q in near[p]:
                    if label[q] is None:
                        label[q] = c
                        queue.append(q)
    return [-1 if v is None else v for v in label]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_dbscan(spark, seed):
    xs = scattered(seed, 90)
    for parts in (1, 5):
        got = dbscan.dbscan(points(spark, xs, parts), "id", ["x0", "x1"], eps=0.45, min_samples=5, scale=False)
        assert [r.cluster for r in got.orderBy("id").collect()] == dbscan_by_queue(xs, 0.45, 5)


def optics_plain(xs, eps, least):
    d, n = distances(xs), len(xs)
    near = [[b for b in range(n) if d[a][b] <= eps] for a in range(n)]
    core = [sorted(d[a][near[a]])[least - 1] if len(near[a]) >= least else None for a in range(n)]
    reach, done, order = [None] * n, set(), []
    for a in range(n):
        if a in done:
            continue
        seeds = {a: -1.0}
        while seeds:
            p = min(seeds, key=lambda k: (seeds[k], k))
            del seeds[p]
            done.add(p)
            order.append(p)
            if core[p] is not None:
                for q in near[p]:
                    if q not in done and (reach[q] is None or max(core[p], d[p][q]) < reach[q]):
                        reach[q] = seeds[q] = max(core[p], d[p][q])
    return order, reach, core


@pytest.mark.parametrize("seed", [6, 7])
def test_optics(spark, seed):
    xs = scattered(seed, 80)
    got = optics.optics(points(spark, xs), "id", ["x0", "x1"], eps=0.7, min_pts=4).orderBy("ordering").collect()
    order, reach, core = optics_plain(xs, 0.7, 4)
    assert [r.ordering for r in got] == list(range(80)) and [r.id for r in got] == order
    for r in got:
        assert (r.reachability is None) == (reach[r.id] is None) and (reach[r.id] is None or r.reachability == pytest.approx(reach[r.id]))
        assert (r.core_distance is None) == (core[r.id] is None)
    with pytest.raises(ValueError):
        optics.optics(points(spark, xs), "id", ["x0"], eps=1.0, min_pts=1)


def test_optics_orders_points_without_pairs():
    """50,000 equal rows, whose pairs are 2.5 * 10^9, and 40 others in any dimension with ties."""
    same = pd.DataFrame({"id": np.arange(50_000), "x0": 1.0, "core": 0.0})
    got = optics.order_component(pd.concat([same, pd.DataFrame({"id": [50_000, 50_001], "x0": [1.5, 9.0], "core": [0.5, np.nan]})]), ["x0"], 2.0)
    assert got.id.tolist() == list(range(50_002)) and got.run_start.tolist() == [0] * 50_001 + [50_001]
    assert np.isnan(got.reachability[0]) and set(got.reachability[1:50_000]) == {0.0} and got.reachability[50_000] == 0.5
    for d in (1, 2, 4):
        xs = np.round(np.random.default_rng(d).normal(size=(40, d)), 1).tolist()
        order, reach, core = optics_plain(xs + xs[:10], 1.5, 4)
        frame = pd.DataFrame(xs + xs[:10], columns=[f"x{k}" for k in range(d)]).assign(id=range(50), core=[core[i] for i in range(50)])
        got = optics.order_component(frame.astype({"core": float}), [f"x{k}" for k in range(d)], 1.5)
        assert got.id.tolist() == order
        assert [None if np.isnan(r) else r for r in got.reachability] == pytest.approx([reach[i] for i in order])


def hdbscan_plain(xs, least, k):
    """Cluster (a set of points) and strength of each point: Prim's tree, split from the top."""
    d, n = distances(xs), len(xs)
    core = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, edges, best = {0}, [], {j: (w[0, j], 0, j) for j in range(1, n)}
    while best:
        e = best.pop(min(best, key=lambda j: (best[j][0], min(best[j][1:]), max(best[j][1:]))))
        edges.append(e)
        inside.add(e[2])
        best = {j: min(old, (w[e[2], j], e[2], j)) for j, old in best.items()}
    out = {}

    def split(points, es):
        """The two sides of the longest edge."""
        cut = max(es, key=lambda e: (e[0], min(e[1:]), max(e[1:])))
        side, grown = {cut[1]}, True
        while grown:
            grown = {p for e in es if e is not cut for p in e[1:] if (e[1] in side) != (e[2] in side)} - side
            side |= grown
        return 1 / cut[0], [(s, [e for e in es if e is not cut and e[1] in s]) for s in (side, points - side)]

    def cluster(points, es, born, top):
        """(excess of mass, chosen [(points, strength)]) of the best choice in a cluster."""
        mass, left, whole = 0.0, {}, points
        while True:
            if len(points) == 1:
                lam, sides = np.inf, []
            else:
                lam, sides = split(points, es)
            big = [s for s in sides if len(s[0]) >= least]
            if len(big) == 2:
                mass += len(points) * (lam - born)
                below = [cluster(*s, lam, False) for s in big]
                if top or sum(m for m, _ in below) > mass:
                    return sum(m for m, _ in below), [c for _, cs in below for c in cs]
                return mass, [(whole, {p: min(left.get(p, lam), lam) / lam for p in whole})]
            for s, _ in sides:
                if len(s) < least:
                    mass += len(s) * (lam - born)
                    left |= dict.fromkeys(s, lam)
            if not big:
                return (0, []) if top else (mass, [(whole, {p: left[p] / lam for p in whole})])
            points, es = big[0]

    for points, strength in cluster(set(range(n)), edges, 0.0, True)[1]:
        out |= {p: (min(points), strength[p]) for p in points}
    return out


@pytest.mark.parametrize("seed", range(8))
def test_hdbscan(spark, seed):
    rng = random.Random(seed)
    homes = [(0, 0), (3, 1), (10, 10), (300, -200)][: 2 + seed % 3]
    xs = [(h[0] + rng.gauss(0, 1), h[1] + rng.gauss(0, 1)) for h in homes for _ in range(25)] + [(rng.uniform(-9, 19), rng.uniform(-9, 19)) for _ in range(6)]
    least, k = rng.choice([4, 6, 9]), rng.choice([2, 4, 6])
    got = {r.id: r for r in hdbscan.hdbscan(points(spark, xs), "id", ["x0", "x1"], min_cluster_size=least, min_samples=k).collect()}
    want = hdbscan_plain(xs, least, k)
    first = {}
    for i in sorted(got):
        if got[i].cluster >= 0:
            first.setdefault(got[i].cluster, i)
    assert {i: first[r.cluster] for i, r in got.items() if r.cluster >= 0} == {i: f for i, (f, _) in want.items()}
    assert all(r.probability == pytest.approx(want[i][1] if i in want else 0) for i, r in got.items())
    assert list(first.values()) == sorted(first.values())


def test_hdbscan_edges(spark):
    with pytest.raises(ValueError):
        hdbscan.hdbscan(points(spark, [(1,)]), "id", ["x0"], min_cluster_size=1)
    same = hdbscan.hdbscan(points(spark, [(3.0,)] * 6 + [(9.0,)] * 6), "id", ["x0"], min_cluster_size=3).collect()
    assert {r.cluster for r in same if r.id < 6} == {0} and {r.cluster for r in same if r.id >= 6} == {1}
    assert [r.cluster for r in hdbscan.hdbscan(points(spark, [(1.0,), (2.0,)]), "id", ["x0"], min_cluster_size=3).collect()] == [-1, -1]


@pytest.mark.parametrize(("k", "least"), [(4, 6), (2, 3), (1, 2)])
def test_hdbscan_takes_equal_rows_as_one_node(spark, monkeypatch, k, least):
    """The same tree, clusters and strengths as from all pairs of rows, ties by src and dst; the search sees k - 1 rows of a place."""
    rng = random.Random(k)
    places = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(40)]
    xs = [p for n, p in enumerate(places) for _ in range((1, 2, 3, 4, 9)[n % 5])]
    rng.shuffle(xs)
    d, n = distances(xs), len(xs)
    core = np.sort(d, axis=1)[:, k - 1]
    edges, root = [], list(range(n))
    for e in sorted((float(max(d[i, j], core[i], core[j])), i, j) for i in range(n) for j in range(i + 1, n)):
        if root[e[1]] != root[e[2]]:
            edges.append(e)
            root = [root[e[1]] if r == root[e[2]] else r for r in root]
    label, strength = hdbscan.condense(edges, n, least)
    seen, search = [], hdbscan.spanning_tree
    monkeypatch.setattr(hdbscan, "spanning_tree", lambda pts, *rest: seen.append(pts.count()) or search(pts, *rest))
    table = points(spark, xs)
    tree = hdbscan.hierarchy(table, "id", ["x0", "x1"], k, Scratch(spark)).collect()
    assert sorted((r.reach, r.src, r.dst) for r in tree) == [pytest.approx(e) for e in edges]
    assert seen == [sum(c if c < k else 1 for c in (xs.count(p) for p in set(xs)))]
    got = {r.id: r for r in hdbscan.hdbscan(table, "id", ["x0", "x1"], min_cluster_size=least, min_samples=k).collect()}
    first = [int(np.flatnonzero(label == c)[0]) if c >= 0 else None for c in label]
    numbers = {f: c for c, f in enumerate(sorted({f for f in first if f is not None}))}
    assert [got[i].cluster for i in range(n)] == [numbers.get(f, -1) for f in first]
    assert [got[i].probability for i in range(n)] == pytest.approx(strength.tolist())


def test_hdbscan_keeps_few_edges_of_dense_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    xs, kept, table = rng.random((900, 2)).round(4), [], Scratch.table

    def counted(self, df, name="t"):
        out = table(self, df, name)
        kept.extend([out.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    tree = hdbscan.hierarchy(points(spark, xs), "id", ["x0", "x1"], 5, Scratch(spark)).collect()
    d = distances(xs)
    core, root, want = np.sort(d, axis=1)[:, 4], list(range(900)), []
    reach = np.maximum(np.maximum(core[:, None], core), d)
    a, b = np.triu_indices(900, 1)
    for k in np.lexsort((b, a, reach[a, b])).tolist():
        i, j = int(a[k]), int(b[k])
        ends = []
        for x in (i, j):
            while root[x] != x:
                root[x] = x = root[root[x]]
            ends.append(x)
        if ends[0] != ends[1]:
            root[ends[0]] = ends[1]
            want.append((float(reach[i, j]), i, j))
    assert sorted((r.reach, r.src, r.dst) for r in tree) == [pytest.approx(e) for e in want]
    assert max(kept) < 4 * 900  # the pairs within the first side are some thirty for each row


def test_condense_takes_arrays():
    rng = np.random.default_rng(4)
    n = 3000
    height = np.sort(rng.exponential(size=n - 1))
    a = rng.permutation(n - 1)
    label, strength = hdbscan.condense((height, a, a + 1), n, 5)
    other, weak = hdbscan.condense(list(zip(height.tolist(), a.tolist(), (a + 1).tolist())), n, 5)
    assert (label == other).all() and (strength == weak).all() and label.max() > 10


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_pairs_of_blocks(monkeypatch, d):
    rng = np.random.default_rng(d)
    x, side = rng.normal(size=(150, d)).round(1), 0.7
    w = rng.integers(1, 3, 150)
    monkeypatch.setattr(neighbors, "CHUNK", 500)
    met = [(int(i), int(j)) for part in neighbors.block_pairs(x, np.arange(0, 150, 2), side) for i, j in zip(*part[:2])]
    dist = distances(x)
    assert sorted(met) == [(i, j) for i in range(0, 150, 2) for j in range(150) if dist[i, j] <= side]
    core = neighbors.block_cores(x, w, np.arange(150), side, 4)
    for i in range(150):
        near = [v for v, k in sorted(zip(dist[i].tolist(), w.tolist())) for _ in range(k)]
        assert core[i] == (pytest.approx(near[3]) if near[3] <= side else pytest.approx(np.nan, nan_ok=True))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(50)] + [(2000, 2000)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in graph.components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1051)} | {2000: 2000}
    assert graph.components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_kmeans(spark):
    xs = scattered(9, 150, 0.2)
    models = [kmeans.kmeans(points(spark, xs, p), ["x0", "x1"], 3, n_init=3, id_col="id") for p in (1, 4)]
    assert np.allclose(models[0].centres, models[1].centres)
    model = models[0]
    labels = [r.cluster for r in model.transform(points(spark, xs)).orderBy("id").collect()]
    d = np.linalg.norm(np.array(xs)[:, None] - np.array(model.centres)[None], axis=2)
    assert labels == d.argmin(1).tolist() and model.inertia == pytest.approx((d.min(1) ** 2).sum())
    sse = [r.sse for r in kmeans.elbow(points(spark, xs), ["x0", "x1"], range(1, 4)).collect()]
    assert sse[0] == pytest.approx(((np.array(xs) - np.mean(xs, 0)) ** 2).sum()) and sse[0] >= sse[1] >= sse[2]
    for k in (0, 151):
        with pytest.raises(ValueError):
            kmeans.kmeans(points(spark, xs), ["x0"], k)
    got = points(spark, [(1.0,)] * 4)
    assert kmeans.kmeans(got, ["x0"], 4).inertia == 0


def test_pca(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    model = pca.fit(df, "v", 2)
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt * np.sign(vt[np.arange(5), np.abs(vt).argmax(1)])[:, None]
    got = np.array([r.scores for r in model.transform(df, "v").orderBy("id").collect()])
    assert np.allclose(got, c @ vt[:2].T) and np.allclose(model.explained_variance, (s**2 / 199)[:2])


# ---- text, classifier, streams


def test_polarity_rules():
    lex = {"good": 1.9, "bad": -2.5, "great": 3.1}
    p = lambda t: sentiment.polarity(t, lex)[3]
    assert p("good") == pytest.approx(1.9 / math.sqrt(1.9**2 + 15))
    assert p("very good") > p("good") > p("slightly good") > 0 > p("not good")
    assert p("good!!!") > p("good!") > p("good") and p("this is GOOD") > p("this is good")
    assert p("good but bad") < 0 < p("bad but great") and p("nothing here") == 0 and p("GOOD") == p("good")
    assert sum(sentiment.polarity("a good thing and a bad thing", lex)[:3]) == pytest.approx(1)


def test_analyse_skips_blanks(spark):
    docs = spark.createDataFrame([(1, "good day"), (2, " \t\n"), (3, None), (4, "bad"), (5, "plain")], "doc_id long, text string")
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    assert {r.doc_id: r.label for r in sentiment.analyse(docs, lex).collect()} == {1: "positive", 4: "negative", 5: "neutral"}
    assert {r.doc_id: r.label for r in sentiment.lexicon_sums(docs, lex).collect()} == {1: "positive", 4: "negative", 5: "neutral"}
    assert sentiment.sample(docs, 9).count() == 5 and sentiment.sample(docs, 2).count() == 2


def test_mlp_gradient_and_fit(spark):
    rng = np.random.default_rng(5)
    sizes = [4, 6, 3]
    layers = mlp.initial_layers(sizes, 1)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    g, loss = mlp.gradient(layers, x, y)
    flat = mlp._flat(layers)
    for k in rng.integers(0, len(flat), 12):
        step = flat.copy()
        step[k] += 1e-6
        assert (mlp.gradient(mlp._shaped(step, sizes), x, y)[1] - loss) / 1e-6 == pytest.approx(g[k], abs=1e-3)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(v.tolist(), int(v[0] > 0) + int(v[1] > 1)) for v in x], "v array<double>, y int").repartition(3)
    model = mlp.fit(df, "v", "y", hidden=(16,), classes=3, epochs=15, batches=4, rate=0.03)
    got = mlp.evaluate(model.transform(df, "v"), "y").first()
    assert got.n == 300 and got.accuracy > 0.9 and model.losses[-1] < model.losses[0]
    more = mlp.fit(df, "v", "y", hidden=(16,), classes=3, epochs=2, batch_size=64, validation=0.1, rate=0.03)
    assert len(more.held_out_losses) == 2 and all(0 < x < 2 for x in more.held_out_losses)
    null = spark.createDataFrame([(None,), ([0.0] * 4,)], "v array<double>")
    assert [r.prediction is None for r in model.transform(null, "v").collect()] == [True, False]


def test_stream_and_batch_agree(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    model = kmeans.kmeans(df, ["value"], 3)
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = scoring.cluster_counts(stream, model).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("counts").collect()) == sorted(scoring.cluster_counts(df, model).collect())


@pytest.mark.parametrize("in_one_pass", [0, 100_000])
def test_group_quartiles(spark, in_one_pass):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.integers(0, 400, 3000)] + [(g, float(x)) for g in "abc" for x in rng.normal(size=7)] + [("one", 2.0), ("hot", None), ("a", float("nan")), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.level: r for r in profile.group_quartiles(df, "g", "v", in_one_pass).collect()}
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, vs in want.items():
        assert got[g].n == len(vs)
        assert np.allclose([got[g][k] for k in ("min", "p25", "p50", "p75", "max")], np.percentile(vs, [0, 25, 50, 75, 100]))
    assert profile.group_quartiles(df.limit(0), "g", "v", in_one_pass).count() == 0


def test_density_grid(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=400), "b": rng.exponential(3, 150), None: rng.uniform(size=60), "one": np.array([2.0]), "same": np.array([3.0] * 9)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan"))]
    got = {}
    for r in sorted(profile.density_grid(spark.createDataFrame(rows, "`g.h` string, x double").repartition(4), "g.h", "x", points=50).collect(), key=lambda r: r.place):
        got.setdefault(r.level, []).append((r["at"], r.density))
    assert set(got) == {"a", "b", None}
    for g in got:
        x = groups[g]
        h = x.std(ddof=1) * len(x) ** -0.2
        at, density = np.array(got[g]).T
        assert np.allclose(at, np.linspace(x.min() - 2 * h, x.max() + 2 * h, 50))
        want = np.exp(-(((at[:, None] - x) / h) ** 2) / 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.allclose(density, want, atol=1e-4 * want.max())


def test_quantiles_of_all_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (400, 3)).astype(float)
    x[::5, 1] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a.b", "c", "d"])).withColumn("none", F.lit(None).cast("double")).repartition(5)
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = profile.column_quantiles(df, ["a.b", "c", "d", "none"], qs)
    assert got["none"] == [None] * 5
    for k, n in enumerate(["a.b", "c", "d"]):
        assert got[n] == pytest.approx(np.nanquantile(x[:, k], qs).tolist())
    jobs = []
    for columns in (["c"], ["a.b", "c", "d"]):
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        profile.column_quantiles(df, columns, qs)
        jobs.append(spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before)
    assert jobs[0] == jobs[1]
    assert profile.describe(df, in_one_pass=0).collect() == profile.describe(df).collect()


def test_dropped_rows_and_drop_missing_agree(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y"), (None, "z"), (2.0, None), (3.0, "NaN")], "`a.b` double, t string")
    for columns, kept in ((["a.b"], 3), (["a.b", "t"], 2), (["t"], 4), ([], 5)):
        out = prepare.drop_missing(df, columns)
        assert out.count() == kept and prepare.dropped_rows(df, columns).first() == (5, kept, 5 - kept)


def test_names_cannot_clash(spark):
    df = spark.createDataFrame([(k, float(k), k, k, k, k) for k in (3, 1, 2)], "`i.d` long, `a.b` double, stats int, part int, n int, offset int")
    assert sorted(r["a.b"] for r in prepare.min_max(df, ["a.b"]).collect()) == [0.0, 0.5, 1.0]
    out = prepare.row_positions(df, "i.d", Scratch(spark))
    assert out.columns == [*df.columns, "pos"] and sorted((r["i.d"], r.pos, r.part, r.n) for r in out.collect()) == [(1, 0, 1, 1), (2, 1, 2, 2), (3, 2, 3, 3)]


def test_ids_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([(c, 1.0) for c in "abcdef"], "id string, x double")
    for f in (hdbscan.hdbscan, optics.optics):
        with pytest.raises(ValueError, match="whole numbers"):
            f(df, "id", ["x"])


def plain_fit(x, y, batch, hidden, classes, epochs, batches, rate, seed=42):
    """Adam over given batches on one machine."""
    layers = mlp.initial_layers([x.shape[1], *hidden, classes], seed)
    flat, sizes = mlp._flat(layers), [x.shape[1], *hidden, classes]
    m = s = np.zeros_like(flat)
    losses, t = [], 0
    for _ in range(epochs):
        total = n = 0
        for k in range(batches):
            rows = batch == k
            if rows.any():
                g, loss = mlp.gradient(mlp._shaped(flat, sizes), x[rows], y[rows])
                total, n, t = total + loss, n + rows.sum(), t + 1
                g = g / rows.sum()
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)
        losses.append(total / n)
    return flat, losses


def test_mlp_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 70))  # 4,000 weights and more: several blocks
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, `v.x` array<double>, y int").repartition(5)
    rows, n = mlp.laid_out(df, "v.x", "y", 3, None, 0.25, "id", Scratch(spark))
    known = {tuple(v): i for i, v in enumerate(x.tolist())}
    batch = np.empty(240, int)
    for r in rows.collect():
        batch[known[tuple(r.v)]] = r.batch
    assert n == 3 and (batch[180:] == -1).all() and (batch[:180] >= 0).all()  # the last quarter by id
    model = mlp.fit(df, "v.x", "y", hidden=(60,), classes=3, epochs=3, batches=3, rate=0.01, validation=0.25, order_col="id")
    flat, losses = plain_fit(x, y, batch, (60,), 3, 3, 3, 0.01)
    assert np.allclose(mlp._flat(model.layers), flat, atol=1e-9) and model.losses == pytest.approx(losses)
    _, outside = mlp.gradient(mlp._shaped(flat, [70, 60, 3]), x[180:], y[180:])
    assert model.held_out_losses[-1] == pytest.approx(outside / 60)
    one = rows.where("batch = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch" in one  # a step reads its own batch


def test_wide_pca(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 8)) * [9, 7, 5, 3, 1, 0.5, 0.2, 0.1] @ rng.normal(size=(8, 60)) + rng.normal(size=(120, 60)) * 0.01 + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, `v.x` array<double>").repartition(3)
    exact, wide = pca.fit(df, "v.x", 3), pca.fit(df, "v.x", 3, widest=10)
    assert np.allclose(exact.explained_variance, wide.explained_variance) and exact.total_variance == pytest.approx(wide.total_variance)
    a, b = ([r.scores for r in m.transform(df.where("id < 999"), "`v.x`").orderBy("id").collect()] for m in (exact, wide))
    assert np.allclose(a, b, atol=1e-6)
    with pytest.raises(ValueError):
        pca.leading(df.limit(0), "v.x", 2)


def test_cores_and_reachability_without_pairs(spark):
    rng = np.random.default_rng(21)
    xs = np.round(np.concatenate([rng.normal(size=(150, 2)), rng.uniform(-9, 9, (60, 2))]), 1)
    xs = np.concatenate([xs, xs[:40], np.tile(xs[:1], (12, 1))])
    df, features = points(spark, xs.tolist()), ["x0", "x1"]
    for eps in (0.4, 3.0):
        pairs = neighbors.eps_pairs(df, "id", features, eps)
        cores = neighbors.core_distances(pairs, 5)
        want = {r.id: r.core_distance for r in cores.collect()}
        assert {r.id: r.core_distance for r in neighbors.cores_within(df, "id", features, eps, 5).collect()} == want
        for f, g in ((neighbors.reachability, neighbors.reachability_within), (neighbors.mutual_reachability, neighbors.mutual_reachability_within)):
            assert sorted(map(tuple, g(df, "id", features, eps, 5).collect())) == sorted(map(tuple, f(pairs, cores).collect()))


def test_cores_of_many_equal_rows(spark):
    """Their pairs would be 4 * 10^10."""
    df = spark.range(200_000).select("id", F.lit(1.5).alias("x0")).union(spark.createDataFrame([(200_000, 2.0), (200_001, 9.0)], "id long, x0 double"))
    got = neighbors.cores_within(df, "id", ["x0"], 1.0, 5).groupBy("core_distance").count()
    assert sorted(map(tuple, got.collect()), key=str) == [(0.0, 200_000), (0.5, 1), (None, 1)]


def test_full_cells_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "COMPARED", 500)
    xs = [(round(0.01 * i, 2), 0.0) for i in range(120)] + [(5.0, 5.0)]
    pairs = neighbors.eps_pairs(points(spark, xs), "id", ["x0", "x1"], 2.0)
    per_task = pairs.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert pairs.count() == 120 * 120 + 1 == pairs.distinct().count() and per_task < 5000


def test_rows_of_full_cells_are_sent_along_a_line_only(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "COMPARED", 500)
    sent, dealt = [], neighbors._dealt

    def counted(a, b, keys):
        out = dealt(a, b, keys)
        sent.append(out[0].count() + out[1].count())
        return out

    monkeypatch.setattr(neighbors, "_dealt", counted)
    xs = [(0.001 * i,) for i in range(300)] + [(7.0,)]
    pairs = neighbors.eps_pairs(points(spark, xs), "id", ["x0"], 1.0)
    assert pairs.count() == 300 * 300 + 1 == pairs.distinct().count()
    assert sent[0] < 300 * 45  # 180 shares: 54,000 rows if each row of one side goes to all


def test_round_fast(spark):
    xs = [0.12345, 0.00005, 1.00015, -2.34565, 2.5, 1e13 + 0.125, float("nan"), float("inf"), None, *np.random.default_rng(2).uniform(-50, 50, 500).round(5).tolist()]
    df = spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double")
    assert df.where(~F.round("x", 4).eqNullSafe(scalars.round_fast(F.col("x"), 4))).count() == 0


def test_scratch_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}

    before, had = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    t = Scratch(spark).table(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.collect_list("id").alias("ids")))
    assert not shuffled() - before
    assert t.select(F.sum(F.size("ids"))).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == had
