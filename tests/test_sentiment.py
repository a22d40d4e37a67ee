import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sentiment

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "ass": -2.5, "right": 0.4, "death": -2.9, "shit": -2.6, "no": -1.2, "this": 1.1, ":)": 2.0, "x": -0.5, "very": 0.1}
WORDS = [*LEXICON, "plain", "never", "so", "this", "least", "at", "very", "slightly", "kind", "sort", "of", "not", "isn't", "cant", "but", "the", "bomb", "yeah", "kiss", "cut", "mustard", "without", "GOOD", "BAD", "VERY", "Good", "(great)", "good!!", "?", "??", "!", "--", "a", "I", "éa", "É", "ÉTÉ", "don't", "'good'", "hand", "to", "mouth"]


def texts(n=600):
    rng = random.Random(8)
    out = [rng.choice([" ", "\n", "  ", "\t"]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return [*out, None, "", " \xa0\u2003", "never so good", "never this very good", "kind of good day", "that is the bomb", "least good", "at least good", "good\u2003bad\xa0great", "the least good", "yeah right", "x " * 5000, "good but bad", "GOOD", "THE GOOD"]


@pytest.mark.parametrize(("largest", "fold"), [(100, True), (3, None), (100, None)])
def test_tables_agree_with_one_text_at_a_time(spark, largest, fold):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts())], "`doc.id` long, `the text` string, w string, s int").repartition(3)
    lexicon = spark.createDataFrame([*LEXICON.items(), (None, 1.0), ("null", None)], "token string, valence double")
    out = sentiment.analyse(docs, lexicon, "doc.id", "the text", largest=largest, fold=fold)
    assert ("Python" in out._jdf.queryExecution().toString()) == (largest == 100 and not fold)
    got = {r.doc_id: (*r.scores, r.label) for r in out.collect()}
    for i, t in enumerate(texts()):
        if t is None or not t.strip():
            assert i not in got
            continue
        want = sentiment.polarity(t, LEXICON)
        assert got[i][:4] == pytest.approx(want, abs=1e-12), t
        assert got[i][4] == ("positive" if want[3] >= 0.05 else "negative" if want[3] <= -0.05 else "neutral")


def test_rules_are_for_words_near_telling_ones(spark):
    """Without a telling word near by a score is a word's valence; only such words go through all rules."""
    rng = random.Random(3)
    words = sorted({w for w in [*LEXICON, *WORDS, "kiss", "cut", "bad", "yeah", "hand", "to", "of", "the", "so", "this", "at"] if w.islower() and w.isalpha() and w != "but"} - sentiment.TELLING)
    for _ in range(2000):
        text = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        total = sum(LEXICON.get(w, 0.0) for w in text if len(w) > 1 or w in LEXICON)
        assert sentiment.polarity(" ".join(text), LEXICON)[3] == pytest.approx(total / (total * total + 15) ** 0.5)
    for telling, want in ((True, 1.9 * sentiment.NEGATE), (False, 1.9)):
        w = [("not", "not", None, telling), ("good", "good", 1.9, False)]
        df = spark.createDataFrame([(1, w)], "doc_id long, w array<struct<bare:string,low:string,v:double,telling:boolean>>")
        assert sentiment._scores(df).first()["s"] == pytest.approx([want])


def test_words_end_at_every_space(spark):
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    docs = spark.createDataFrame([(c, f"ab{chr(c)}{chr(c)}cd") for c in points], "c int, text string")
    got = {r.c: r.n for r in docs.select("c", F.size(sentiment._words(F.col("text"))).alias("n")).collect()}
    assert got == {c: len(f"ab{chr(c)}{chr(c)}cd".split()) for c in points}


def test_published_rules():
    p = lambda t: sentiment.polarity(t, {"good": 1.9, "bad": -2.5, "ass": -2.5, "shit": -2.6})[3]
    assert p("was never so good") > p("was really good") > p("was good") > 0 > p("was never good")
    assert p("it is the least good") < 0 < p("it is at least good") and p("the very least good") > 0
    assert p("it was kind of good") < p("it was much too good") and p("he was surely such a bad ass") > 0 and p("they said this was the shit") > 0


def test_no_lexicon(spark):
    docs = spark.createDataFrame([(1, "good day")], "doc_id long, text string")
    none = spark.createDataFrame([], "token string, valence double")
    for fold in (True, False):
        assert [tuple(r.scores) for r in sentiment.analyse(docs, none, fold=fold).collect()] == [(0.0, 1.0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="entries"):
        sentiment.analyse(docs, spark.createDataFrame([("a", 1.0)], "token string, valence double"), largest=0, fold=False)
