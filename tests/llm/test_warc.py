import base64
import gzip
import hashlib

import pytest
from pyarrow import fs

from lodestone.llm import warc
from lodestone.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, members string, payload string"


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def want(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, _, h in rows:
        n = len((h or "").encode())
        first = n < least or last.get(h or "") in (i, None)
        out.append((i, n, b32(h), "response" if first else "revisit", None if first else last[h or ""]))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "m", "p") for r in rows], SCHEMA)


def test_round_trip(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows += [(900 + i, u, h) for i, u, h in rows[:9]] + [(800, None, None), (801, "", ""), (802, "a b\r\nX: y", "é\r\n\r\nWARC/1.1\r\n\r\n"), (803, "u", "x" * 3_000_000)]
    df = frame(spark, rows).repartition(3)
    out = warc.archive_and_read(df, roll_bytes=50_000)
    assert got(out) == want(rows)
    texts = {i: h or "" for i, _, h in rows}
    for r in out.where("record_type = 'response'").collect():
        assert r.payload.decode() == texts[r.page_id]
    assert got(warc.archive_and_read(df, least_bytes=5000)) == want(rows, 5000)


def test_edges(spark):
    assert warc.archive_and_read(frame(spark, [])).count() == 0
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "v", "only null"), (2, "u", None), (3, "u", "")]
    assert got(warc.archive_and_read(frame(spark, rows))) == want(rows)


def test_members_stand_alone(spark):
    s = Scratch(spark)
    rows = frame(spark, [(i, f"http://x/{i}", f"<p>{i}</p>" * i) for i in range(40)]).selectExpr("*", "cast(null as long) refers_to").coalesce(1)
    mono = s.table(warc.write_monolithic(rows, s.path("m"), "2000-01-01T00:00:00Z", 1 << 20, 6))
    assert mono.count() == 1
    idx = warc.normalise(mono, s.path("n"), 6).first()
    store, at = fs.FileSystem.from_uri(idx.members)
    _, side = fs.FileSystem.from_uri(idx["index"])
    data = store.open_input_stream(at, compression=None).read()
    lines = store.open_input_stream(side, compression=None).read().splitlines()
    assert len(lines) == idx.n_records == 40
    for line in lines:
        o, n, rid = line.split(b"\t")
        one = gzip.decompress(data[int(o) : int(o) + int(n)])
        assert one.startswith(b"WARC/1.1") and rid in one
    src, p = fs.FileSystem.from_uri(mono.first().archive)
    assert gzip.decompress(src.open_input_stream(p, compression=None).read()) == gzip.decompress(data)


def test_damage_is_reported():
    whole = warc.record(1, "u", b"abc", None, "d")
    with pytest.raises(ValueError):
        list(warc.split_records([whole[:-6]]))
    with pytest.raises(ValueError):
        warc.parse(whole.replace(b"abc", b"abd"))
    packed = warc.member(whole, 6)

    class Stream:
        def __init__(self, b):
            self.b = b

        def read(self, n):
            out, self.b = self.b[:n], self.b[n:]
            return out

    assert b"".join(warc.inflate(Stream(packed + packed))) == whole * 2
    with pytest.raises(ValueError):
        list(warc.inflate(Stream(packed[:-9])))
