import pytest

from lodestone.plans import runs
from lodestone.sources import loaders


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Price (x)\n1,2.5\n2,\n3,NaN\n")
    df = loaders.read_csv(spark, f"{tmp_path}/a.csv", required=["Price (x)"])
    assert [r[1] for r in df.orderBy("id").collect()] == [2.5, None, None]
    with pytest.raises(loaders.MissingColumns, match="price"):
        loaders.read_csv(spark, f"{tmp_path}/a.csv", required=["price (x)"])
    with pytest.raises(loaders.SourceNotFound):
        loaders.read_csv(spark, f"{tmp_path}/none.csv")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    for name in ("empty", "head"):
        with pytest.raises(loaders.EmptySource):
            loaders.read_csv(spark, f"{tmp_path}/{name}.csv")
    loaders.write_csv(df, f"{tmp_path}/out", single_file=True)
    loaders.write_csv(df, f"{tmp_path}/out", single_file=True)
    assert loaders.read_csv(spark, f"{tmp_path}/out").count() == 3


def test_strict_csv(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,_corrupt_record\n1,x\n2,\n")
    (tmp_path / "long.csv").write_text("a,b\n1,x\n2,y,z\n")
    (tmp_path / "type.csv").write_text("a,b\n1,x\ntwo,y\n")
    assert loaders.read_csv(spark, f"{tmp_path}/good.csv", strict=True).count() == 2
    with pytest.raises(loaders.ParseError, match="2,y,z"):
        loaders.read_csv(spark, f"{tmp_path}/long.csv", strict=True)
    with pytest.raises(loaders.ParseError, match="two,y"):
        loaders.read_csv(spark, f"{tmp_path}/type.csv", "a int, b string", strict=True)
    assert [r.a for r in loaders.read_csv(spark, f"{tmp_path}/type.csv", "a int, b string").collect()] == [1, None]


def test_texts(spark, tmp_path):
    (tmp_path / "sub" / "a b").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"plain \xc3\xa9 \xff bad")
    (tmp_path / "sub" / "B.TXT").write_text("deep")
    (tmp_path / "sub" / "a b" / "ü 100%.Txt").write_text("odd name")
    (tmp_path / "c.md").write_text("other")
    for name in ("zero.txt", "sub/a b/no thing %41.txt"):
        (tmp_path / name).write_text("")
    want = {"a.txt": "plain é  bad", "B.TXT": "deep", "ü 100%.Txt": "odd name", "zero.txt": "", "no thing %41.txt": ""}
    for how in ("raise", "empty"):
        got = [(r.path.rpartition("/")[2], r.text) for r in loaders.read_texts(spark, str(tmp_path), unreadable=how).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert loaders.read_texts(spark, str(tmp_path), ".nothing").count() == 0
    with pytest.raises(loaders.SourceNotFound):
        loaders.read_texts(spark, f"{tmp_path}/none").collect()
    with pytest.raises(ValueError):
        loaders.read_texts(spark, str(tmp_path), unreadable="other")


def test_texts_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.txt").write_text("good")
    (tmp_path / "gone.txt").write_text("gone")
    df = loaders.read_texts(spark, str(tmp_path))
    (tmp_path / "gone.txt").unlink()  # between the listing and the reading
    with pytest.raises(Exception, match="gone.txt|FILE_NOT_EXIST"):
        df.collect()


def test_lexicon(spark, tmp_path):
    path = tmp_path / "lex.txt"
    path.write_text("good\t1.9\t0.9\t[2, 1]\r\n:)\t2.0\n\n\"quoted\t-1\ngood\t2.5\n")
    assert {r.token: r.valence for r in loaders.read_lexicon(spark, str(path)).collect()} == {"good": 2.5, ":)": 2.0, '"quoted': -1.0}
    for bad in ("good\t1\nbad\n", "good\tmuch\n", "\t2\n"):
        path.write_text(bad)
        with pytest.raises(loaders.ParseError, match="line"):
            loaders.read_lexicon(spark, str(path))
    with pytest.raises(loaders.SourceNotFound):
        loaders.read_lexicon(spark, f"{path}.none")
    for none in ("", "\n\n"):
        path.write_text(none)
        with pytest.raises(loaders.EmptySource):
            loaders.read_lexicon(spark, str(path))


def test_sentiment_run(spark, tmp_path):
    (tmp_path / "mails" / "x").mkdir(parents=True)
    for i in range(12):
        (tmp_path / "mails" / "x" / f"{i:02}.txt").write_text(["a good day", "a bad day", "a day", " \n"][i % 4])
    (tmp_path / "mails" / "zero.txt").write_text("")
    (tmp_path / "lex.txt").write_text("good\t1.9\nbad\t-2.5\n")
    run = runs.sentiment_run(spark, f"{tmp_path}/mails", f"{tmp_path}/lex.txt")
    assert {r.label: (r.n, round(r.percent, 1)) for r in run.distribution.collect()} == dict.fromkeys(["positive", "neutral", "negative"], (3, 33.3))
    lines = run.report().split("\n")
    assert lines[0] == "Texts analysed: 9" and lines[1] == "Positive:     3 ( 33.3%)" and len(lines) == 9 and lines[4].startswith("a good day... | 0.4404 | Positive")
    few = runs.sentiment_run(spark, f"{tmp_path}/mails", f"{tmp_path}/lex.txt", most=4)
    assert few.scored.count() <= 4 and few.scored.join(run.scored, "doc_id", "left_anti").count() == 0
    (tmp_path / "none").mkdir()
    assert runs.sentiment_run(spark, f"{tmp_path}/none", f"{tmp_path}/lex.txt").report().startswith("Texts analysed: 0")
    with pytest.raises(ValueError):
        runs.sentiment_run(spark, f"{tmp_path}/mails", f"{tmp_path}/lex.txt", most=0)


def test_file_order(spark, tmp_path):
    for k, rows in (("b", [5, 3]), ("a", [9, 1, 7]), ("c", [2])):
        spark.createDataFrame([(v, 1) for v in rows], "v int, pos int").coalesce(1).write.parquet(f"{tmp_path}/t/part={k}")
    df = loaders.read_parquet_in_order(spark, f"{tmp_path}/t", out="at")
    assert [(r.part, r.v, r.pos, r["at"]) for r in df.orderBy("at").collect()] == [("a", 9, 1, 0), ("a", 1, 1, 1), ("a", 7, 1, 2), ("b", 5, 1, 3), ("b", 3, 1, 4), ("c", 2, 1, 5)]
    assert [r.v for r in loaders.first_rows(df, 4, "at").collect()] == [9, 1, 7, 5]
    with pytest.raises(loaders.MissingColumns):
        loaders.read_parquet_in_order(spark, f"{tmp_path}/t", ["w"])
