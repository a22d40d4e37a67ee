"""Lexicon-based sentiment of texts after Hutto and Gilbert 2014: word valences, optional context rules, labels.

The rules run in one of two ways with the same results. With a lexicon that fits a worker, texts go through Python in Arrow
batches, which was measured to take a third of the time. With any lexicon they run as expressions over an array of each
text's words (fold): every word looks at the lexicon once and at the words beside it, and nothing leaves the JVM. There a
lexicon of moderate size becomes an array of small maps, one of which a word's hash points at; a larger one is joined by
word, and each text gets the entries it has.
"""

from __future__ import annotations

import math
import string
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SPACES, is_blank
from ..functions.scratch import Scratch
from .profile import counts_of, percentages

# Fixed values of the published rule set.
NORMALISER = 15.0
POSITIVE, NEGATIVE = 0.05, -0.05
BOOST, CAPS, NEGATE, EXCLAIM, QUESTION, MANY_QUESTIONS = 0.293, 0.733, -0.74, 0.292, 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
FADE = (1.0, 0.95, 0.9)
NEVER_SO = (1.5, 1.25)  # "never so good": never two words before, three words before
NEGATIONS = {"aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hardly", "isnt", "neither", "never", "no", "nobody", "none", "nor", "not", "nothing", "nowhere", "seldom", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt"}
BOOSTERS = {"absolutely": 1, "amazingly": 1, "completely": 1, "deeply": 1, "especially": 1, "extremely": 1, "highly": 1, "incredibly": 1, "more": 1, "most": 1, "particularly": 1, "really": 1, "so": 1, "totally": 1, "very": 1, "almost": -1, "barely": -1, "kinda": -1, "less": -1, "little": -1, "marginally": -1, "occasionally": -1, "partly": -1, "scarcely": -1, "slightly": -1, "somewhat": -1}
# Phrases with a valence of their own, and phrases that dampen what follows.
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0}
DAMPENING = ("kind of", "sort of")
# A word is scored otherwise than by its valence and case only if one of these, or a word with an apostrophe, is near it.
TELLING = {*BOOSTERS, *NEGATIONS, "least", *(p.split()[-1] for p in IDIOMS), *(p.split()[0] for p in DAMPENING)}
# Entries of a lexicon that is sent to every worker; more are joined by word.
LARGEST = 200_000
LABELS = ("positive", "neutral", "negative")


def compound(total: Column) -> Column:
    """Sum of valences on a scale from -1 to 1."""
    return total / F.sqrt(total * total + F.lit(NORMALISER))


def classify(score: Column) -> Column:
    return F.when(score >= POSITIVE, "positive").when(score <= NEGATIVE, "negative").otherwise("neutral")


def lexicon_sums(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, total, compound, label): valences of lower-case words added up, without context rules.

    Blank texts are skipped. lexicon: (token, valence). A lexicon of up to LARGEST entries is broadcast, so that words
    stay in place and sums are pre-aggregated before the shuffle; a larger one is joined by word. Ids have to be unique.
    """
    if lexicon.count() <= LARGEST:
        lexicon = F.broadcast(lexicon)
    rows = docs.where(~is_blank(F.col(text_col))).select(F.col(id_col).alias("doc_id"), text_col)
    words = rows.select("doc_id", F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z']+"), 0)).alias("token"))
    sums = words.join(lexicon, "token").groupBy("doc_id").agg(F.sum("valence").alias("total"))
    out = rows.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("total", F.lit(0.0)).alias("total"))
    return out.withColumn("compound", compound(F.col("total"))).withColumn("label", classify(F.col("compound")))


def polarity(text: str, lexicon: dict[str, float]) -> tuple[float, float, float, float]:
    """(neg, neu, pos, compound) of one text with the context rules, on the driver; analyse() gives the same for tables."""
    raw = [w for w in text.split() if len(w.strip(string.punctuation)) > 1 or w.lower() in lexicon]
    bare = [w.strip(string.punctuation) if len(w.strip(string.punctuation)) > 2 else w for w in raw]
    low = [w.lower() for w in bare]
    upper = [w.isupper() for w in bare]
    mixed = any(upper) and not all(upper)
    phrase = lambda i, n: " ".join(low[i : i + n]) if 0 <= i and i + n <= len(low) else ""
    scores = []
    for i, w in enumerate(low):
        v = lexicon.get(w, 0.0)
        if w in BOOSTERS or not v:
            scores.append(0.0)
            continue
        sign = 1 if v > 0 else -1
        if mixed and upper[i]:
            v += sign * CAPS
        for back, fade in enumerate(FADE, 1):
            if i < back or low[i - back] in lexicon:
                continue
            before = low[i - back]
            if before in BOOSTERS:
                push = BOOST * BOOSTERS[before] * sign
                v += fade * (push + sign * CAPS if mixed and upper[i - back] else push)
            if back > 1 and before == "never" and any(x in ("so", "this") for x in low[i - back + 1 : i]):
                v *= NEVER_SO[back - 2]
            elif before.replace("'", "") in NEGATIONS or before.endswith("n't"):
                v *= NEGATE
            if back == 3:
                for at, n in ((i - 1, 2), (i - 2, 3), (i - 2, 2), (i - 3, 3), (i - 3, 2), (i, 2), (i, 3)):
                    v = IDIOMS.get(phrase(at, n), v)
                if phrase(i - 3, 2) in DAMPENING or phrase(i - 2, 2) in DAMPENING:
                    v -= BOOST
        if i and low[i - 1] == "least" and "least" not in lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= NEGATE
        scores.append(v)
    if "but" in low:
        at = low.index("but")
        scores = [s * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1) for i, s in enumerate(scores)]
    marks = min(text.count("!"), 4) * EXCLAIM
    asks = text.count("?")
    marks += MANY_QUESTIONS if asks > 3 else asks * QUESTION if asks > 1 else 0.0
    total = sum(scores)
    if total:
        total += math.copysign(marks, total)
    pos, neg = sum(s + 1 for s in scores if s > 0), sum(s - 1 for s in scores if s < 0)
    neutral = sum(s == 0 for s in scores)
    if pos > -neg:
        pos += marks
    elif pos < -neg:
        neg -= marks
    whole = pos - neg + neutral
    scaled = max(-1.0, min(1.0, total / math.sqrt(total * total + NORMALISER)))
    return (-neg / whole, neutral / whole, pos / whole, scaled) if whole else (0.0, 0.0, 0.0, 0.0)


def _looked_up(lexicon: DataFrame, size: int):
    """A lookup in a lexicon of moderate size: token -> valence, null where there is none."""
    buckets = max(1, size)
    one = F.map_from_entries(F.collect_list(F.struct("token", "valence")))
    held = lexicon.groupBy(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).agg(F.to_json(one).alias("m")).collect()
    maps = ["{}"] * buckets
    for r in held:
        maps[r["b"]] = r["m"]
    # a constant, worked out once for the plan
    table = F.from_json(F.lit(f"[{','.join(maps)}]"), "array<map<string,double>>")
    return lambda token: F.try_element_at(F.get(table, F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")), token)


def _words(text: Column) -> Column:
    """(bare, low, tiny) of each word: without marks around it, unless two characters or fewer are left; tiny, in lower case,
    is the whole word if one character or none is left, else null."""
    marks = F.lit(string.punctuation)
    gap = f"[\\x00- \\x7F-\\x{{10FFFF}}&&[{SPACES}]]+"  # the spaces; other ASCII is told apart by the first half alone
    # a step for each value that is used more than once, or it would be worked out for each use
    parts = F.transform(F.filter(F.split(text, gap), lambda w: w != ""), lambda w: F.struct(w.alias("w"), F.btrim(w, marks).alias("inner")))
    parts = F.transform(parts, lambda x: F.struct(F.when(F.octet_length(x["inner"]) > 8, x["inner"]).when(F.char_length(x["inner"]) > 2, x["inner"]).otherwise(x["w"]).alias("bare"), F.when((F.octet_length(x["inner"]) < 5) & (F.char_length(x["inner"]) < 2), F.lower(x["w"])).alias("tiny")))
    return F.transform(parts, lambda x: F.struct(x["bare"].alias("bare"), F.lower(x["bare"]).alias("low"), x["tiny"].alias("tiny")))


def _scores(df: DataFrame) -> DataFrame:
    """df (w and other columns) with `s`, the scores of the words of the lexicon, and `n`, the number of words instead of w.

    w: array of (bare, low, v, telling). Words that are not in the lexicon, and boosters, have the score 0 and are left out of s.
    """
    boost = F.create_map(*[F.lit(x) for w, v in BOOSTERS.items() for x in (w, v)])
    idioms = F.create_map(*[F.lit(x) for w, v in IDIOMS.items() for x in (w, v)])
    denied, boosters = ([F.lit(w) for w in sorted(x)] for x in (NEGATIONS, BOOSTERS))
    loud = lambda x: (x["bare"] != x["low"]) & (x["bare"] == F.upper(x["bare"]))
    mixed, w = F.col("mixed"), F.col("w")
    at = lambda i: F.get(w, i)
    is_one = lambda i, *words: F.coalesce(at(i)["low"].isin(*words), F.lit(False))
    phrase = lambda i, n: F.when(i >= 0, F.concat_ws(" ", *[at(i + j)["low"] for j in range(n)]))
    cased = lambda x, sign: F.when(mixed & loud(x), sign * CAPS).otherwise(0.0)
    # words of the lexicon: (place, v, its valence v0)
    own = F.transform("w", lambda x, i: F.when(F.coalesce(x["v"] != 0, F.lit(False)) & ~x["low"].isin(*boosters), F.struct(i.alias("i"), x["v"].alias("v0"))))
    scored = lambda x, v: F.struct(x["i"].alias("i"), v.alias("v"), x["v0"].alias("v0"))
    near = lambda i: reduce(Column.__or__, [F.coalesce(at(i + k)["telling"], F.lit(False)) for k in (-1, -2, -3, 0, 1, 2)])

    def after(back: int):
        """A score given the word `back` places before."""

        def step(z: Column) -> Column:
            x, b, sign = z["x"], z["b"], F.signum(z["x"]["v0"])
            i = x["i"]
            push = F.try_element_at(boost, b["low"])
            pushed = x["v"] + F.when(b["low"].isin(*boosters), FADE[back - 1] * (BOOST * push * sign + cased(b, sign))).otherwise(0.0)
            no = F.endswith(b["low"], F.lit("n't")) | F.replace(b["low"], F.lit("'"), F.lit("")).isin(*denied)
            factor = F.when(no, F.lit(NEGATE)).otherwise(1.0)
            if back > 1:
                so = is_one(i - 1, "so", "this") if back == 2 else is_one(i - 2, "so", "this") | is_one(i - 1, "so", "this")
                factor = F.when((b["low"] == "never") & so, F.lit(NEVER_SO[back - 2])).otherwise(factor)
            out = pushed * factor
            if back == 3:
                for k, n in ((-1, 2), (-2, 3), (-2, 2), (-3, 3), (-3, 2), (0, 2), (0, 3)):
                    out = F.coalesce(F.try_element_at(idioms, phrase(i + k, n)), out)
                out = out - F.when(phrase(i - 3, 2).isin(*DAMPENING) | phrase(i - 2, 2).isin(*DAMPENING), F.lit(BOOST)).otherwise(0.0)
            return scored(x, F.when((i < back) | b["v"].isNotNull(), x["v"]).otherwise(out))

        return lambda xs: F.transform(F.transform(xs, lambda x: F.struct(x.alias("x"), at(x["i"] - back).alias("b"))), step)

    def least(x: Column) -> Column:
        i = x["i"]
        held = (i > 0) & is_one(i - 1, "least") & at(i - 1)["v"].isNull() & ~is_one(i - 2, "at", "very")
        return F.when(held, x["v"] * NEGATE).otherwise(x["v"])

    def in_context(x: Column) -> Column:
        s = F.array(x)
        for back in range(1, len(FADE) + 1):
            s = after(back)(s)
        return F.get(F.transform(s, least), F.lit(0))

    df = df.withColumn("mixed", F.exists("w", loud) & ~F.forall("w", loud))
    df = df.withColumn("but", F.array_position(F.transform("w", lambda x: x["low"]), "but"))
    s = F.transform(F.filter(own, lambda x: x.isNotNull()), lambda x: scored(x, x["v0"] + cased(at(x["i"]), F.signum(x["v0"]))))
    # few words have such context, and only they go through all rules
    s = F.transform(s, lambda x: F.struct(x["i"].alias("i"), F.when(near(x["i"]), in_context(x)).otherwise(x["v"]).alias("v")))
    place = lambda x: x["i"] + 1
    weigh = lambda x: x["v"] * F.when(F.col("but") == 0, 1.0).when(place(x) < F.col("but"), BEFORE_BUT).when(place(x) > F.col("but"), AFTER_BUT).otherwise(1.0)
    return df.withColumn("s", F.transform(s, weigh)).withColumn("n", F.size("w")).drop("w", "mixed", "but")


def _sum(values: str) -> Column:
    """Sum with the rounding errors carried along (Neumaier 1974), so that valences that cancel out make 0."""

    def add(z: Column, x: Column) -> Column:
        t = z["s"] + x
        lost = F.when(F.abs(z["s"]) >= F.abs(x), (z["s"] - t) + x).otherwise((x - t) + z["s"])
        return F.struct(t.alias("s"), (z["c"] + lost).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda z: z["s"] + z["c"])


def analyse(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: int = LARGEST, fold: bool | None = None) -> DataFrame:
    """(doc_id, text, scores, label) with the context rules; blank texts are skipped.

    lexicon: (token, valence), tokens in lower case and each once; entries without either are left out. Up to `largest`
    entries travel with the plan; a larger lexicon is joined by word, for which ids have to be unique. fold: whether the
    rules run as expressions; by default only with a larger lexicon.
    """
    entries = lexicon.select("token", F.col("valence").cast("double").alias("valence")).where("token is not null and valence is not null")
    rows = docs.where(~is_blank(F.col(f"`{text_col}`"))).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = entries.count()
    if fold or fold is None and size > largest:
        out = _folded(rows, entries, size, largest)
    else:
        if size > largest:
            raise ValueError(f"the lexicon has {size} entries, over {largest}")
        shared = docs.sparkSession.sparkContext.broadcast({t: v for t, v in entries.collect()})

        @F.pandas_udf("neg double, neu double, pos double, compound double")
        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([polarity(t, shared.value) for t in texts], columns=["neg", "neu", "pos", "compound"], dtype=float)

        out = rows.withColumn("scores", run("text"))
    return out.withColumn("label", classify(F.col("scores.compound")))


def _folded(rows: DataFrame, entries: DataFrame, size: int, largest: int) -> DataFrame:
    """rows (doc_id, text) with scores, without Python."""
    split = rows.withColumn("w", _words(F.col("text")))
    if size <= largest:
        of = _looked_up(entries, size)
    else:
        scratch = Scratch(rows.sparkSession)
        split = scratch.table(split, "words")
        each = F.array_distinct(F.flatten(F.transform("w", lambda x: F.array_compact(F.array(x["low"], x["tiny"])))))
        hits = split.select("doc_id", F.explode(each).alias("token")).join(entries, "token")
        hits = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "valence"))).alias("own"))  # entries the text has
        split = split.join(hits, "doc_id", "left")
        of = lambda token: F.try_element_at(F.col("own"), token)
    known = F.filter("w", lambda x: x["tiny"].isNull() | of(x["tiny"]).isNotNull())
    known = F.transform(known, lambda x: F.struct(x["bare"].alias("bare"), x["low"].alias("low"), of(x["low"]).alias("v"), (x["low"].isin(*sorted(TELLING)) | F.contains(x["low"], F.lit("'"))).alias("telling")))
    scored = _scores(split.select("doc_id", "text", known.alias("w")))
    sum_of = lambda f: F.aggregate("s", F.lit(0.0), f)
    times = lambda mark: F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(mark), F.lit("")))
    scored = scored.select(
        "doc_id", "text", _sum("s").alias("total"), sum_of(lambda t, s: t + F.when(s > 0, s + 1).otherwise(0.0)).alias("pos"),
        sum_of(lambda t, s: t + F.when(s < 0, 1 - s).otherwise(0.0)).alias("neg"), (F.col("n") - F.size(F.filter("s", lambda s: s != 0))).alias("neu"),
        times("!").alias("calls"), times("?").alias("asks"),
    )
    marks = F.least("calls", F.lit(4)) * EXCLAIM + F.when(F.col("asks") > 3, F.lit(MANY_QUESTIONS)).when(F.col("asks") > 1, F.col("asks") * QUESTION).otherwise(0.0)
    scored = scored.withColumn("marks", marks).select(
        "doc_id", "text", "neu", (F.col("total") + F.signum("total") * F.col("marks")).alias("total"),
        (F.col("pos") + F.when(F.col("pos") > F.col("neg"), F.col("marks")).otherwise(0.0)).alias("pos"), (F.col("neg") + F.when(F.col("pos") < F.col("neg"), F.col("marks")).otherwise(0.0)).alias("neg"),
    )
    whole = F.col("pos") + F.col("neg") + F.col("neu")
    share = lambda c: F.when(whole > 0, F.col(c) / whole).otherwise(0.0).alias(c)
    scores = F.struct(share("neg"), share("neu"), share("pos"), F.when(whole > 0, compound(F.col("total"))).otherwise(0.0).alias("compound"))
    return scored.select("doc_id", "text", scores.alias("scores"))


def sample(docs: DataFrame, n: int = 2000, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """n rows without replacement, those of least md5(seed:id); all rows if there are no more."""
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def distribution(scored: DataFrame) -> DataFrame:
    """(label, n, percent) for positive, neutral and negative, absent ones with 0."""
    return percentages(counts_of(scored, "label", list(LABELS)))


def examples(scored: DataFrame, n: int = 5, width: int = 80) -> DataFrame:
    """The first n by id: start of the text on one line, score and label."""
    return scored.orderBy("doc_id").limit(n).select("doc_id", F.substring(F.regexp_replace("text", r"\s+", " "), 1, width).alias("start"), F.col("scores.compound").alias("compound"), F.initcap("label").alias("label"))
