import random

from lodestone.llm import substrings

SCHEMA = "doc_id long, text string, n_removed string, h int, doc int, first int, hashes int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def brute(rows, m):
    """Every run of sentences with m words and no shorter one at either end, in order of document and place."""
    first, runs = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            continue
        ws = [s.lower().split() for s, _ in substrings.sentences(t)]
        for a in range(len(ws)):
            for b in range(a, len(ws)):
                n = sum(map(len, ws[a : b + 1]))
                if n >= m and (ws[a] and n - len(ws[b]) < m or ws[b] and n - len(ws[a]) < m):
                    key = tuple(sum(ws[a : b + 1], []))
                    runs.setdefault(i, []).append((key, a, b))
                    first.setdefault(key, (i, a, b))
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (None, 0)
            continue
        ss = substrings.sentences(t)
        gone = {k for key, a, b in runs.get(i, ()) if first[key] != (i, a, b) for k in range(a, b + 1)}
        text = "".join(a + b for k, (a, b) in enumerate(ss) if k not in gone)
        out[i] = (text.rstrip() if gone else text, len(gone))
    return out


def brute_with_words(rows, m, span):
    """What is left of each text, without white space, if every later occurrence of a run of sentences, as brute() has
    them, and of a stretch of span words goes."""
    first, runs, spans, places = {}, {}, {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ws = [s.lower().split() for s, _ in substrings.sentences(t or "")]
        at = [0]
        for w in ws:
            at.append(at[-1] + len(w))
        places[i], flat = at, sum(ws, [])
        for a in range(len(ws)):
            for b in range(a, len(ws)):
                n = at[b + 1] - at[a]
                if n >= m and (ws[a] and n - len(ws[b]) < m or ws[b] and n - len(ws[a]) < m):
                    key = " ".join(flat[at[a] : at[b + 1]])
                    runs.setdefault(i, set()).update(() if first.setdefault(key, (i, a, b)) == (i, a, b) else range(at[a], at[b + 1]))
                if n - len(ws[a]) >= m:
                    break
        for k in range(len(flat) - span + 1):
            if spans.setdefault(" ".join(flat[k : k + span]), (i, k)) != (i, k):
                runs.setdefault(i, set()).update(range(k, k + span))
    return {i: "".join(w for k, w in enumerate(w for s, _ in substrings.sentences(t or "") for w in s.split()) if k not in runs.get(i, ())) for i, t in rows}


def test_words_and_sentences_match_brute_force(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    bank = [" ".join(word() for _ in range(random.choice([30, 51, 52, 70, 120]))) for _ in range(8)]
    piece = lambda: random.choice([lambda: random.choice(bank), lambda: " ".join(word() + random.choice(["", "", ".", "\n"]) for _ in range(random.randrange(40)))])()
    rows = [(i, " ".join(piece() for _ in range(random.randrange(6)))) for i in range(60)]
    got = {r.doc_id: "".join(r.text.split()) for r in substrings.dedup(frame(spark, rows).repartition(5), within_sentences=True).collect()}
    assert got == brute_with_words(rows, 25, 51)


def test_matches_brute_force(spark):
    random.seed(9)
    bank = [" ".join(random.choice("abcde") for _ in range(random.randrange(1, 9))) + random.choice([". ", "!\n", "\n\n", "? "]) for _ in range(25)]
    rows = [(i, "".join(random.choice(bank) for _ in range(random.randrange(0, 30)))) for i in range(80)]
    got = {r.doc_id: (r.text, r.n_removed) for r in substrings.dedup(frame(spark, rows).repartition(5), min_words=12).collect()}
    assert got == brute(rows, 12)


def test_planted_passage_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = " ".join(f"word{k}" + ("." if k % 9 == 8 else "") for k in range(54))
    mixed = [(i, t + "\n" + passage if i % 3 == 0 else t) for i, t in rows]
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(mixed, "doc_id long, text string")).collect()}
    holders = [i for i, t in got.items() if "word10" in t]
    assert holders == [min(i for i, _ in rows if i % 3 == 0)] and got[holders[0]].endswith(passage)
    assert not any(f"word{k}" in t for k in range(54) for i, t in got.items() if i not in holders)
    assert got == {i: t for i, (t, _) in brute(mixed, 25).items()}


def test_edges(spark):
    long = "Some words in a very long text follow here and there. " * 20000
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, long), (5, "a b " * 20), (5, "a b " * 20), (None, "a b " * 20)]
    got = substrings.dedup(frame(spark, rows)).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[1].n_sentences == 0 and by[2].text == "" and by[3].text == " \n\n "
    assert by[4].n_removed == 19999 and by[4].text == "Some words in a very long text follow here and there."
    assert by[5].text == "a b " * 20 and by[None].text == ""
    assert set(got[0].asDict()) == {"doc_id", "text", "n_sentences", "n_removed", "h", "doc", "first", "hashes"}
    assert substrings.dedup(frame(spark, [])).count() == 0


def test_passages_that_begin_and_end_within_sentences(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(7))
    text = lambda n, size: " ".join(word() + ("." if k % size == size - 1 else "") for k in range(n))
    rows, want = [], {}
    for k in range(60):
        n, size = random.choice([51, 53, 60, 80]), random.choice([6, 20, 45, 1000])
        passage = text(n, size).rstrip(".")
        for i in (2 * k, 2 * k + 1):
            own = text(300, size).split(" ")
            cut = random.randrange(1, 299)
            rows.append((i, " ".join([*own[:cut], passage, *own[cut:]])))
            want[i] = " ".join([*own[:cut], *own[cut:]]).split() if i % 2 else rows[-1][1].split()
    part = text(50, 1000)  # not over 50 words
    rows += [(900, f"{word()} {part} {word()}"), (901, f"{word()} {part} {word()}")]
    # a shorter stretch that comes first hides no longer one of later documents
    long = text(60, 1000)
    rows += [(902, " ".join(long.split()[10:40])), (903, f"{word()} {long} {word()}"), (904, f"Head {long}\ttail. Next {word()} \n"), (905, f"Twice {long} or {long} end")]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), within_sentences=True).collect()}
    assert {i: got[i].text.split() for i in want} == want
    assert all(got[i].text == t and got[i].n_removed == 0 for i, t in rows if 900 <= i <= 903)
    assert got[904].text.startswith("Head tail. Next ") and got[904].n_removed == 1 and got[905].text == "Twice or end"


def test_a_common_passage_takes_few_rows(spark, monkeypatch):
    """Spans at the ends of a passage that many documents have are joined by chunks; one by one there were 30 or so a document."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(7))
    stretch = lambda n: " ".join(word() for _ in range(n))
    passage, made = stretch(90), []
    rows = [(i, f"{stretch(60)} {passage} {stretch(60)}") for i in range(200)]
    plain = substrings.shared
    monkeypatch.setattr(substrings, "shared", lambda found, scratch, name, how="inner": made.append(plain(found, scratch, name, how)) or made[-1])
    got = {r.doc_id: r.text.split() for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), within_sentences=True).collect()}
    assert got == {i: t.split() if i == 0 else t.split()[:60] + t.split()[150:] for i, t in rows}
    assert sum(d.where("doc > first or again").count() for d in made[1:]) < 20 * 200


def test_the_ends_of_common_passages_take_few_rows(spark, monkeypatch):
    """Of a chunk at the end of a passage its parts are joined before its spans; by spans alone it was 3,084 rows here."""
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(7))
    stretch = lambda n: " ".join(word() for _ in range(n))
    passages, made = [stretch(90) for _ in range(20)], []
    rows = [(i, f"{stretch(60)} {passages[i % 20]} {stretch(60)}") for i in range(400)]
    plain = substrings.shared
    monkeypatch.setattr(substrings, "shared", lambda found, scratch, name, how="inner": made.append(plain(found, scratch, name, how)) or made[-1])
    got = {r.doc_id: r.text.split() for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), within_sentences=True).collect()}
    assert got == {i: t.split() if i < 20 else t.split()[:60] + t.split()[150:] for i, t in rows}
    assert sum(d.where("doc > first or again").count() for d in made[2:]) < 6 * 400
