import duckdb
import numpy as np
import pytest

from lodestone.llm import registry, vectors

SCHEMA = "vec_id long, embedding array<float>, n long, rep long, copies long, v int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def brute(rows, t=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    near = [[k for k in range(len(ok)) if k != a and len(ok[k][1]) == len(ok[a][1]) and ok[a][1] @ ok[k][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[k][1]) >= t] for a in range(len(ok))]
    low = [i for i, _ in ok]
    for _ in ok:
        low = [min([low[a], *(low[k] for k in near[a])]) for a in range(len(ok))]
    out = {i: (0, i, True) for i, _ in rows}
    return out | {ok[a][0]: (len(near[a]), low[a], low[a] == ok[a][0]) for a in range(len(ok))}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("stripe", [7, 2048])
def test_matches_brute_force(spark, stripe):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(120):
        v = base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.2, 0.3])
        rows.append((i, (v * rng.choice([1, 3])).astype(np.float32).tolist()))
    rows += [(200, None), (201, [0.0] * 16), (202, [1.0, None]), (203, [float("nan")] * 16), (204, [float("inf")] + [1.0] * 15), (205, []), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [1e30, 2e30])]
    assert got(vectors.near_vectors(frame(spark, rows).repartition(3), stripe=stripe)) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x = vectors.unit(rng.normal(size=(300, 64)) + 2)
    y = vectors.unit(x + rng.normal(size=x.shape) * 0.05)
    exact = x @ y.T
    for t in (0.5, 0.8, 0.95, float(np.quantile(exact, 0.9))):
        assert (vectors.linked(x, y, t) == (exact >= t)).mean() > 0.99999
    q, s, c, e = vectors.quantise(x)
    q2, s2, c2, e2 = vectors.quantise(y)
    off = np.abs(exact - (q.astype(int) @ q2.astype(int).T) * s[:, None] * s2)
    assert (off <= e[:, None] * c2 + (c + e)[:, None] * e2 + 1e-12).all()


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.sql(registry.SQL["op1_embedding_near_dedup"]).fetchall()}
    assert got(registry.QUERIES["op1_embedding_near_dedup"](spark, d)) == want


def test_edges(spark):
    assert vectors.near_vectors(frame(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])]
    out = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame(spark, rows)).collect())
    assert out == [(-1, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    same = [(i, [3.0, 4.0]) for i in range(500)]
    assert got(vectors.near_vectors(frame(spark, same))) == {i: (499, 0, i == 0) for i in range(500)}
    chain = [(99 - k, [float(np.cos(k * 0.3)), float(np.sin(k * 0.3))]) for k in range(20)]
    assert got(vectors.near_vectors(frame(spark, chain), stripe=3)) == brute(chain)
