import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from lodestone.llm import periodic, registry

SCHEMA = "doc_id long, text string, runs int, n_words int, collapsed string, w int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)], SCHEMA)


def brute(w, shortest=12):
    """Every stretch on which words q apart agree, the least q for each."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(i, j) + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def random_texts(seed, n, longest=60):
    rng, out = random.Random(seed), []
    for _ in range(n):
        size, kinds = rng.randint(0, longest), rng.randint(1, 4)
        w = [rng.choice(["a", "b", "é", "ab", " x"][: kinds + 1]) for _ in range(size)]
        if size and rng.random() < 0.6:
            a = rng.randrange(size)
            p = 1 + (size - a) // rng.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        out.append(rng.choice(["", " "]) + rng.choice([" ", "\t\n ", "\x0b"]).join(w))
    return out


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_many_texts_at_once(shortest):
    texts = random_texts(shortest, 400)
    for at in range(0, 400, 20):
        part = texts[at : at + 20]
        for t, r in zip(part, periodic.searched([t.encode() for t in part], shortest).to_pylist()):
            want = brute(split(t), shortest)
            assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
            assert (r["n_words"], r["collapsed"]) == (len(split(t)), collapsed(split(t), want))


def test_candidates_in_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "CANDIDATES", 7)
    texts = random_texts(9, 50)
    for t, r in zip(texts, periodic.searched([t.encode() for t in texts], 12).to_pylist()):
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == brute(split(t))


def test_long_texts(spark, monkeypatch):
    rng = random.Random(1)
    plain = [str(rng.randint(0, 30)) for _ in range(3000)]
    nested = ((["x"] * 14 + ["y"]) * 5 + ["z"]) * 4
    texts = ["a b " * 100_000, " ".join(plain[:900] * 2 + plain), " ".join(nested), None, "", " \n", "a " * 11, "a " * 12]
    got = {r.doc_id: r for r in periodic.runs(frame(spark, texts)).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 200_000, 2)] and got[0].collapsed == "a b"
    for i in range(1, len(texts)):
        want = brute(split(texts[i]))
        assert [tuple(x) for x in got[i].runs] == want and got[i].collapsed == collapsed(split(texts[i]), want)
    assert not got[6].runs and got[7].runs
    monkeypatch.setattr(periodic, "WORDS", 3)  # texts of one batch searched apart
    again = {r.doc_id: r for r in periodic.runs(frame(spark, texts)).collect()}
    assert again == got


def test_edges(spark):
    assert periodic.runs(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a " * 20), (1, "a " * 20), (1, "a " * 20), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, len(r.runs), r.collapsed) for r in periodic.runs(rows).collect())
    assert got == [(-1, 20, 1, "a"), (1, 0, 0, ""), (1, 20, 1, "a"), (1, 20, 1, "a")]
    with pytest.raises(ValueError):
        periodic.runs(rows, shortest=1)


def expected(doc_id, text):
    w = split(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *tail, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(collapsed(w, runs)))


def test_query(spark, tmp_path):
    texts = [*random_texts(4, 300, 200), None, "", "one"]
    frame(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).toPandas().sort_values("doc_id", ignore_index=True)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = pd.DataFrame([expected(i, t) for i, t in enumerate(texts)], columns=names)
    pd.testing.assert_frame_equal(got[names], want, check_dtype=False)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    twin = con.sql(registry.SQL["op12_periodic_runs"]).df().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(twin[names].astype(want.dtypes), want, check_dtype=False)
