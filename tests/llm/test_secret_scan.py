import hashlib
import random
import re
import string

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import registry, secret_scan

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
SCHEMA = "doc_id long, text string, spans int, known int, token string, start int"
B62 = string.ascii_letters + string.digits


def base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(a, secret_scan.KINDS[k], z) for a, k, z in sorted(out)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)], SCHEMA)


def drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["token=", "secret: ", "api_key=", "API-KEY=", "ApiKey='", 'password" : "', "AKIA", "AKIAABCDEFGHIJKL", "abcdef0123456789" * 2, "é", "😀", " ", "=", "x", "abcdefgh", "ABCDEFGH1234", "passwd=short", "\n", "secret=token=api_key: abcdefgh", "token:=", '"', "ſecret=abcdefgh"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    out += [None, "", "token=abcdefgh12 " * 3000, "a" * 100_000, "f" * 50_000, "AKIA" * 5000, "password" * 2000]
    return out + [f"key {drawn(rng, B62, rng.randint(20, 60))} end" for _ in range(200)]


def test_known_forms(spark, texts):
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_scan.scan(frame(spark, texts).repartition(5)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] != "random"] == base(t or ""), t


def test_places_over_blocks(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([],), ([5],), (None,)], "v array<long>")
    got = [r[0] for r in rows.select(secret_scan.prefix_sums(F.col("v"), 3)).collect()]
    assert got == [[1, 3, 6, 10, 15, 21, 28], [], [5], []]


def statistics(token):
    """p by numpy, with the alphabet of the token's encoding."""
    name, alphabet = next((k, a) for k, (p, a) in secret_scan.ENCODINGS.items() if re.fullmatch(p, token))
    v, n, k = np.array([alphabet.index(c) for c in token]), len(token), len(alphabet)
    c = 3 if n < 32 else 5 if n < 64 else 9
    seen, even = np.bincount(v * c // k, minlength=c), np.bincount(np.arange(k) * c // k, minlength=c) * n / k
    runs = (np.sum((v[1:] * 2 < k) != (v[:-1] * 2 < k)) - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    centred = v - (k - 1) / 2
    serial = np.sum(centred[1:] * centred[:-1]) / ((k * k - 1) / 12 * np.sqrt(n - 1))
    s = np.sum((seen - even) ** 2 / even) + runs**2 + serial**2
    terms, term = [], 1.0
    for j in range((c + 1) // 2):
        terms.append(term)
        term *= s / 2 / (j + 1)
    return f"{name}:{int(np.log2(n))}", float(np.exp(-s / 2) * sum(terms))


def plain_cuts(tests, alpha=0.1):
    out = {}
    for stratum in {s for s, _ in tests.values()}:
        levels = np.array([p for s, p in tests.values() if s == stratum])
        fine = [t for t in sorted(set(levels)) if 1 - 2 * (levels >= 500).sum() * (1 - t / 1000) / (levels >= t).sum() <= alpha + 1e-12]
        if fine:
            out[stratum] = min(fine)
    return out


def test_random_tokens_match_brute_force(spark):
    rng = random.Random(5)
    words = "the quick brown fox jumps over lazy dogs configuration manager service handler request response internal factory provider session context value".split()
    secrets = [drawn(rng, B62, rng.randint(20, 70)) for _ in range(300)] + [drawn(rng, B62 + "+/", 44) for _ in range(60)] + [drawn(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32) for _ in range(40)]
    names = ["_".join(rng.choices(words, k=rng.randint(3, 6))) for _ in range(300)] + ["".join(w.capitalize() for w in rng.choices(words, k=5)) for _ in range(300)] + ["/".join(rng.choices(words, k=5)) for _ in range(200)] + ["".join(rng.choices(words, k=4)) for _ in range(200)]
    tokens = [t for t in secrets + names if len(t) >= 20 and not re.search("[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}", t)]
    tests = {t: (s, int(p * 1000)) for t in tokens for s, p in [statistics(t)]}
    cut = plain_cuts(tests)
    want = {t for t, (s, p) in tests.items() if p >= cut.get(s, 1001)}
    texts = [f"é {t}, {t}" for t in tokens] + [f"{tokens[0]}\n" * 500]
    rows = secret_scan.scan(frame(spark, texts)).collect()
    got = {tokens[r.doc_id] for r in rows if r.doc_id < len(tokens) and r.spans}
    assert got == want
    assert all([(s.start, s.end) for s in r.spans] == [(2, 2 + len(tokens[r.doc_id])), (4 + len(tokens[r.doc_id]), 4 + 2 * len(tokens[r.doc_id]))] for r in rows if r.doc_id < len(tokens) and r.spans)
    assert len(want & set(secrets)) > 0.95 * len(secrets) and len(want - set(secrets)) <= 0.1 * len(want)


def test_no_python(spark):
    plan = secret_scan.scan(frame(spark, ["token=abcdefgh"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark):
    assert secret_scan.scan(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "token=abcdefgh"), (1, "token=abcdefgh"), (1, "token=abcdefgh"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, [tuple(s) for s in r.spans]) for r in secret_scan.scan(rows).collect())
    span = [(0, "assign", 14)]
    assert got == [(-1, span), (1, span), (1, span), (2, [])]


def test_query(spark, tmp_path, texts):
    frame(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_secret_scan"](spark, str(tmp_path)).toPandas().sort_values("doc_id", ignore_index=True)
    for r in got.itertuples():
        known = base(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, x, _ in known) for k in secret_scan.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, k, z in known).encode()).hexdigest()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet' where length(text) < 20000 or text is null")
    want = con.sql(registry.SQL["op11_secret_scan"]).df().sort_values("doc_id", ignore_index=True)
    assert want["n_random"].sum() > 150
    got = got[got["doc_id"].isin(want["doc_id"])].reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)
