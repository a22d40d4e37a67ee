import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from lodestone.llm import fingerprint, mixing

SCHEMA = "doc_id long, text string, source string, owed int, d string, next string, bucket int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


def n_words(t):
    return len([w for w in SPACE.split(t or "") if w])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def targets(sizes):
    """The rule itself, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return out


def tilts(sizes, target):
    """The rates in 0 .. 2 of least relative entropy to 1 whose words sum to target."""
    x, low, high = sizes / sizes.mean(), -2000.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            rate = np.minimum(2, np.exp(mid * x))
        low, high = (mid, high) if (rate * sizes).sum() < target else (low, mid)
    return rate


def test_tilts_have_least_entropy():
    from itertools import product

    sizes = np.array([1.0, 2.0, 4.0])
    cost = lambda r: (r * np.log(r) - r).sum()
    for target in (3.0, 9.5, 12.0):
        best = tilts(sizes, target)
        for a, b in product(np.linspace(0.01, 2, 60), repeat=2):
            c = (target - a - 2 * b) / 4
            assert not 0 < c <= 2 or cost(np.array([a, b, c])) >= cost(best) - 1e-6


def check_mix(df):
    got = mixing.mix(df).toPandas()
    sizes = {}
    src = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + n_words(r.text)
    want = targets(sizes)
    for s, t in want.items():
        part = got[got.source.isna()] if s is None else got[got.source == s]
        assert (part.source_size == sizes[s]).all()
        assert part.target.iloc[0] == pytest.approx(t, abs=1e-6)
        taken = (part.copies * part["size"]).sum()
        assert abs(taken - t) <= part["size"].max() + 1
        full = part[part["size"] > 0]
        if len(full):  # rates solve the dual, found here by halving
            assert full.rate.to_numpy() == pytest.approx(tilts(full["size"].to_numpy(float), t), abs=1e-3)
            assert (full.copies - full.rate).abs().max() < 1
    assert ((got.copies >= 0) & (got.copies <= 2)).all()
    assert len(got) == len(src) or len(got) >= len(src)
    return got


def test_mix_matches_the_rule(spark, docs):
    a = check_mix(docs)
    b = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "copies"]
    pd.testing.assert_frame_equal(a[key].sort_values(key, ignore_index=True), b[key].sort_values(key, ignore_index=True))
    close = [abs((g.copies * g["size"]).sum() - g.target.iloc[0]) / g.target.iloc[0] for _, g in a.groupby("source")]
    assert sorted(close)[len(close) // 2] < 0.05


def test_mix_edges(spark):
    rows = [(i, "a b c " * (i % 7), None if i % 5 == 0 else f"s{i % 3}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s1"), (101, "", "s1"), (102, "one  \t two\x0b", "")]
    check_mix(frame(spark, rows))
    assert mixing.mix(frame(spark, [])).count() == 0
    only = mixing.mix(frame(spark, [(1, None, None), (2, " ", None)])).collect()
    assert [(r["size"], r.target, r.copies) for r in only] == [(0, 0.0, 1)] * 2
    assert mixing.mix(frame(spark, [(1, "long " * 30000, "a"), (2, "b", "b")])).count() == 2
    same = mixing.mix(frame(spark, [(1, "a b c", "s")] * 40 + [(2, "w " * 100, "t")])).toPandas()
    s = same[same.source == "s"]
    assert len(s) == 40 and abs((s.copies * s["size"]).sum() - s.target.iloc[0]) <= 3 and s.rate.nunique() == 1


def brute_edit(rows):
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = {}
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    return out


def brute_sketch(t):
    """(sketch, least hash if it is empty) of five-word shingles, the lowest quarter of signed 64-bit hashes."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ws = [xxhash.xxh64_intdigest(w.encode(), 42) for w in SPACE.split(t) if w]
    hashes = set()
    for k in range(max(1, len(ws) - 4) if ws else 0):
        h = 42
        for w in ws[k : k + 5]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        hashes.add(signed(h))
    low = {h for h in hashes if h < -(1 << 62)}
    return low, None if low or not hashes else min(hashes)


def brute_text(low, least):
    return "".join(f"{h % (1 << 64):016X}" for h in sorted(low)) if least is None else f"~{least % (1 << 64):016X}"


def brute_likeness(a, b):
    return len(a[0] & b[0]) / len(a[0] | b[0]) if a[0] or b[0] else float(a[1] == b[1])


def test_fingerprints_follow_the_order_of_ids(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_edit(rows)
    for per in (13, 2000):
        base = docs.select("doc_id", "text")
        got = fingerprint.with_next(base, "doc_id", "text", per_bucket=per)
        nxt = {r.doc_id: r.next for r in got.collect()}
        order = sorted(rows, key=lambda r: -r[0])
        assert nxt == {order[k][0]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    order = sorted(rows, key=lambda r: -r[0])
    for k in range(0, len(order), 7):
        (i, t), nxt = order[k], order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        own, changed, following = (brute_sketch(x) for x in (t, t[: len(t) - cut] + nxt[:cut], nxt))
        assert got[i].fingerprint == brute_text(*own) and got[i].edited_fingerprint == brute_text(*changed)
        assert got[i].near_edited == pytest.approx(brute_likeness(own, changed)) and got[i].near_next == pytest.approx(brute_likeness(own, following))
    long = [r for r in got.values() if r.n_chars > 1500]
    assert sum(r.near_edited for r in long) / len(long) > 0.35
    assert sum(r.near_next for r in long) / len(long) < 0.1


def test_fingerprint_estimates_likeness(spark):
    import random

    random.seed(3)
    w = [f"w{random.randrange(10**6)}" for _ in range(4000)]
    a, b = " ".join(w), " ".join(w[:3000])
    r = fingerprint.sketch(spark.createDataFrame([(a, b)], "a string, b string"), {"x": "a", "y": "b"}, scale=4)
    row = r.select(fingerprint.jaccard(r.x, r.y).alias("j"), fingerprint.containment(r.y, r.x).alias("c"), "x").first()
    assert row.j == pytest.approx(0.75, abs=0.05) and row.c > 0.99
    assert len(row.x) == pytest.approx(1000, abs=150)


def test_fingerprint_edges(spark):
    rows = [(5, "same text here", "s"), (5, "same text here", "s"), (3, None, None), (9, "", "s"), (7, "é" * 7, "s"), (None, "x y", "s"), (1, "ab " * 50000, "t")]
    got = fingerprint.fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    same = [r.fingerprint for r in got if r.doc_id == 5]
    assert same[0] == same[1] != ""
    assert [r.fingerprint for r in got if r.doc_id in (3, 9)] == ["", ""]
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    following = sorted((r.doc_id is None, -(r.doc_id or 0), r.next) for r in fingerprint.with_next(frame(spark, rows).where("text is not null"), "doc_id", "text", per_bucket=2).collect())
    assert [(-i, t) for null, i, t in following if not null] == [(9, "é" * 7), (7, "same text here"), (5, "ab " * 50000), (5, "same text here"), (1, "x y")] and following[-1][2] == ""
    one = fingerprint.fingerprints(frame(spark, [(1, "a b c d e f g h i", "s")])).first()
    assert one.near_next == 1.0
