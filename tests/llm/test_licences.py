import random
import re

import pytest

from lodestone.llm import licences

# what the notices in the test tables say, read plainly
PLAIN = {"Apache-2.0": r"licensed under the apache license, version 2\.0", "GPL-3.0": r"gnu general public license, version 3", "MIT": r"the mit license", "CC-BY-NC-4.0": r"cc by-nc 4\.0"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return licences.train(docs)


def test_notices_in_documents(spark, docs, model):
    got = {r.doc_id: r.licences for r in licences.scan(docs, model).collect()}
    want = {r.doc_id: sorted(f for f, p in PLAIN.items() if re.search(p, r.text, re.I)) for r in docs.collect()}
    assert sum(bool(v) for v in want.values()) > 100
    assert sum(got[i] == v for i, v in want.items() if v) / sum(bool(v) for v in want.values()) > 0.98
    assert sum(bool(got[i]) for i, v in want.items() if not v) <= len(want) // 2000


def test_held_out_variations(model):
    rng = random.Random(99)
    right = total = 0
    for f, ts in licences.TEMPLATES.items():
        for t in ts:
            for _ in range(5):
                ws = [w for w in t.split() if len(t.split()) < 12 or rng.random() > 0.04]
                right += model.classify(" ".join(ws).upper() if rng.random() < 0.3 else " ".join(ws))[0] == f
                total += 1
    assert right / total > 0.95
    misses = [p for p in licences.NEAR_MISSES if model.classify(p)[0] != licences.UNKNOWN]
    assert not misses
    assert model.classify("The quick brown fox is licensed to jump over version 3 of the lazy dog.")[0] == licences.UNKNOWN
    assert (abs(model.weights) > 0).mean() < 0.5


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "Released under the MIT License.\n" + "word " * 60000), (4, "x"), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*r, 1, "l") for r in rows], "doc_id long, text string, hits int, licence string")
    got = licences.scan(df, model).collect()
    assert len(got) == 6
    assert [(r.n_paragraphs, r.licences, r.licence) for r in got[:4]] == [(0, [], None), (0, [], None), (0, [], None), (2, ["MIT"], "MIT")]
    assert got[5].licence == "CC-BY-NC-4.0"
    assert licences.scan(df.limit(0), model).count() == 0
    assert licences.train(df.limit(0)).classify("Released under the MIT License.")[0] == "MIT"


def test_several_licences(model):
    for text in ("Dual licensed under the MIT License and the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT OR Apache-2.0", "Licensed under either of Apache-2.0 or MIT at your option."):
        assert sorted(f for f, _, _ in model.families_of(text)) == ["Apache-2.0", "MIT"]
    one_line = "Some words first. Released under the MIT License. " + "Other words follow here. " * 200 + "Licensed under CC BY-NC 4.0."
    assert {h[1] for h in model.scan(one_line)[1]} == {"MIT", "CC-BY-NC-4.0"}


def test_titles_bodies_and_wrapped_lines(model):
    assert model.classify("GNU GENERAL PUBLIC LICENSE\tVersion 2, June 1991")[0] == "GPL-2.0"
    words = licences.TEMPLATES["MIT"][2].split()
    wrapped = "Copyright 2020 somebody\n\n" + "\n".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4)) + "\n\nmore"
    n, hits = model.scan(wrapped)
    assert n == 2 + -(-len(words) // 4)
    assert [(h[0], h[1]) for h in hits] == [(1, "MIT")]


def test_screen_loses_nothing(docs, model):
    """What is passed over without a score could not have been confirmed."""
    lines = sorted({p for r in docs.limit(300).collect() for p in (r.text or "").split("\n")} | {"mit " * 9, "the mit license the mit license"})
    for p in lines:
        ts = licences.tokens(p)
        likely = [f for f, x in zip(model.families, model.probabilities(ts)) if x >= model.threshold]
        assert sorted(f for f in likely if model.confirmed(f, ts) >= model.agreement) == sorted(f for f, _, _ in model.families_of(p))


def test_titles_short_forms_and_bodies(model):
    found = {
        "MIT License": "MIT", "The MIT License (MIT)": "MIT", "Code is MIT licensed.": "MIT", "License: BSD-3-Clause": "BSD", "This software is distributed under GPLv3.": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
        "Apache-2.0": "Apache-2.0", "Eclipse Public License - v 2.0": "EPL-2.0", "Licensed under the EUPL, Version 1.2": "EUPL-1.2", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "zlib License": "Zlib",
        "Released under a BSD license.": "BSD", "It is released under CC BY-SA 4.0": "CC-BY-SA-4.0", licences.TEMPLATES["Apache-2.0"][5]: "Apache-2.0",
        "Activities other than copying, distribution and modification are not covered by this License; they are outside its scope. The act of running the Program is not restricted.": "GPL-2.0",
    }
    for text, family in found.items():
        assert {h[1] for h in model.scan(text)[1]} == {family}, text
    for text in ("This project is not licensed under the MIT License.", "The MIT License is popular among students.", "We compared the MIT License with the GPLv3.", "Is the MIT License good?", "license", "The MIT license of the car was revoked by the court yesterday."):
        assert not model.scan(text)[1], text


def plain_scan(model, text):
    """scan() without screens, caches or shared loops: every line and every sentence against every family and template."""

    def judged(part):
        ts = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", part.lower())
        pairs = {(a, b) for a, b in zip(ts, ts[1:])}
        columns = {model.index[g] for n in (1, 2, 3) for i in range(len(ts) - n + 1) if (g := tuple(ts[i : i + n])) in model.index}
        out = []
        for k, f in enumerate(model.families):
            z = (model.bias[k] + sum(model.weights[c, k] for c in columns)) / model.temperature
            shares = [len(pairs & t) / len(t) for t in model.templates[f]]
            shares += [len(pairs & t) / len(pairs) for t in model.templates[f] if len(pairs) >= 5]
            shares += [len(pairs & t) / max(len(pairs), len(t)) for t in model.titles[f] if pairs and len(ts) <= 10]
            if 1 / (1 + 2.718281828459045 ** -max(-60.0, min(60.0, z))) >= model.threshold and max(shares) >= model.agreement:
                out.append(f)
        return out

    hits, n = set(), 0
    for block in re.split(r"(?:^|\n)(?:[^\S\n]*(?:\n|$))+", text):
        lines = block.split("\n") if block.strip() else []
        own, seen = {}, set()
        for k, line in enumerate(lines):
            for f in judged(line):
                own.setdefault(f, n + k)
        seen = set(own)
        if len(lines) > 1 or re.search(r"[.!?;]\s", block):
            at = 0
            for part in re.split(r"(?<=[.!?;])(?=\s)", block):
                where = n + block.count("\n", 0, at + len(part) - len(part.lstrip()))
                at += len(part)
                for f in judged(part) if part.strip() else []:
                    if f not in seen:
                        own[f] = min(own.get(f, where), where)
        hits |= {(line, f) for f, line in own.items()}
        n += len(lines)
    return n, sorted(hits)


def test_scan_against_a_plain_reading(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [t for ts in licences.TEMPLATES.values() for t in ts] + ["One.\nMIT License\n\nWords; it is MIT licensed.\nEnd", "a\n \nReleased under\nthe MIT License.", "MIT License\nApache-2.0"]
    docs = docs.union(spark.createDataFrame([(-k, t) for k, t in enumerate(texts, 1)], docs.schema)).cache()
    want = {r.doc_id: plain_scan(model, r.text or "") for r in docs.collect()}
    got = {r.doc_id: (r.n_paragraphs, sorted((h.paragraph, h.family) for h in r.hits)) for r in licences.scan(docs, model).collect()}
    assert got == want and sum(bool(h) for _, h in want.values()) > 100
