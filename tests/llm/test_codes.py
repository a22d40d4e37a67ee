import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.llm import codes, registry

SCHEMA = "vec_id long, embedding array<float>, label int, q int, c0 int, numbers int, error int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, v, label in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain loops over integers."""
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int), label) for i, v, label in rows if v is not None and None not in v and np.isfinite(v).all()]
    width = max(len(q) for _, q, _ in kept)
    width += -width % parts
    kept = sorted(((i, np.pad(q, (0, width - len(q))), label) for i, q, label in kept), key=lambda r: (r[0] is None, r[0], tuple(r[1])))
    x = np.array([q for _, q, _ in kept]).reshape(len(kept), parts, width // parts)
    books = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: np.array([[((x[r, p] - books[p]) ** 2).sum(axis=1) for p in range(parts)] for r in range(len(x))])
    for _ in range(rounds):
        at = assign().argmin(axis=2)
        for p in range(parts):
            for e in range(len(books[p])):
                if (at[:, p] == e).any():
                    books[p, e] = x[at[:, p] == e, p].sum(axis=0) // (at[:, p] == e).sum()
    d = assign()
    error = d.min(axis=2).sum(axis=1)
    out = [(i, tuple(n), int(e), int(sum(e2 for e2, (_, _, other) in zip(error, kept) if other == label))) for (i, _, label), n, e in zip(kept, d.argmin(axis=2).tolist(), error)]
    return out, hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


def random_rows(seed, n=400, dim=16, near=0.05):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, dim))
    v = (base[rng.integers(30, size=n)] + rng.normal(size=(n, dim)) * near).astype(np.float32)
    v[n // 2 : n // 2 + 20] = v[0]
    return [(int(i) - 50, r.tolist(), None if k % 7 == 0 else int(k % 3)) for k, (i, r) in enumerate(zip(rng.permutation(n), v))]


def got(df):
    return sorted((r.vec_id, tuple(r.numbers), r.error, r.label_error) for r in df.collect())


@pytest.mark.parametrize(("seed", "near", "entries", "scale"), [(1, 0.05, 256, 1024.0), (2, 1.0, 256, 1024.0), (3, 0.3, 40, 1.5)])
def test_matches_brute_force(spark, seed, near, entries, scale):
    rows = random_rows(seed, near=near)
    out, books = codes.compress(frame(spark, rows).repartition(3), entries=entries, scale=scale)
    want, sha = brute(rows, entries=entries, scale=scale)
    assert got(out) == sorted(want) and books.sha256() == sha


def test_tree_is_exact():
    rng = np.random.default_rng(7)
    for width, spread, n in ((1, 3, 100), (2, 5, 300), (16, 200, 256), (3, 1, 40), (4, 2**25, 90)):
        entries, x = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (700, width))
        d = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        at, best = codes.nearest(codes.grown(entries), entries, x)
        assert (at == [row.tolist().index(min(row)) for row in d]).all() and (best == d.min(axis=1)).all()


def test_balls_hold_their_entries():
    entries = np.random.default_rng(3).integers(-500, 500, (256, 16))
    todo, leaves = [codes.grown(entries)], []
    while todo:
        ball = todo.pop()
        assert (((entries[ball.numbers] - ball.centre) ** 2).sum(axis=1) <= ball.radius**2).all()
        todo += ball.inner
        leaves += [] if ball.inner else ball.numbers.tolist()
    assert sorted(leaves) == list(range(256))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0] * 8, 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan] * 8, 2), (5, [inf] * 8, 2), (6, [-0.0004] * 8, 2), (7, [0.5, 0.25], None), (8, [], None), (9, [0.1] * 10, 3), (9, [0.1] * 10, 3), (9, [0.2] * 10, 3)]
    out, books = codes.compress(frame(spark, rows))
    want, sha = brute(rows)
    assert got(out) == sorted(want) and books.sha256() == sha
    out, _ = codes.compress(frame(spark, [(None, [1.0] * 4, None), (2, [2.0] * 4, None)]), label_col=None)
    assert sorted((r.vec_id or -1, tuple(r.numbers), r.error, r.label_error) for r in out.collect()) == [(-1, (1,) * 4, 0, None), (2, (0,) * 4, 0, None)]
    assert codes.compress(frame(spark, []))[0].count() == 0 and codes.compress(frame(spark, [(1, None, 1)]))[0].count() == 0
    assert [tuple(r) for r in codes.compress(frame(spark, [(1, [], 1)]))[0].collect()] == [(1, [0] * 4, 0, 0)]
    with pytest.raises(ValueError, match="scaling"):
        codes.compress(frame(spark, [(1, [1e6] * 4, 1)]))


def test_decode(spark):
    rows = random_rows(5, near=0.0)
    out, books = codes.compress(frame(spark, rows))
    vectors = {i: v for i, v, _ in rows}
    for r in books.decode(out).collect():
        assert r.error == 0 and np.abs(np.array(r.embedding) - vectors[r.vec_id]).max() <= 0.5 / 1024 + 1e-9


def test_query(spark, tmp_path):
    rows = random_rows(11, n=700, dim=64, near=0.2) + [(2000, None, 1), (2001, [None] * 64, 1)]
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["op13_vector_codes"](spark, str(tmp_path)).toPandas().sort_values("vec_id", ignore_index=True)
    want, sha = brute(rows)
    plain = pd.DataFrame([(i, "".join(f"{k:02x}" for k in n), e, le, sha) for i, n, e, le in sorted(want)], columns=list(out))
    # nulls are a label of their own
    pd.testing.assert_frame_equal(out, plain, check_dtype=False)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    twin = con.sql(registry.SQL["op13_vector_codes"]).df().sort_values("vec_id", ignore_index=True)
    pd.testing.assert_frame_equal(twin, plain, check_dtype=False)
