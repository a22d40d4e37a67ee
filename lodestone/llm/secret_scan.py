"""Secret scan: known forms by pattern, and random-looking tokens by a battery of randomness tests, DataFrame functions only.

Long tokens get the narrowest encoding that has all their characters. If a token is drawn evenly from its alphabet, three
statistics are nearly chi-squared: the uneven use of classes of the alphabet, the number of changes between its halves
(runs), and the correlation of neighbours (serial); their sum gives the token's p. Text and identifiers pile up at p near 0;
random tokens spread evenly over 0 to 1, so those above a half tell how many there are at any p (Storey 2002). For each
encoding and length class the least p is sought from which on all but a share `alpha` of the distinct tokens of the corpus
are random; tokens from there on are reported. Short tokens, whose tests are weak, so need a higher p than long ones.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

VALUE = r"[A-Za-z0-9+/_.=-]+"
NAME = "(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = NAME + r"""["']?\x20*[:=]\x20*["']?"""
# kind -> pattern, group whose length counts, least length. The last two patterns hold that length: a stretch that is too
# short has no longer one within it
KNOWN = {"assign": (f"{ASSIGN}({VALUE})", 1, 8), "access": ("AKIA[A-Z0-9]{12,}", 0, 16), "hex": ("[0-9a-f]{32,}", 0, 32)}
KINDS = [*KNOWN, "random"]
# tokens, but for values that an assignment has already
TOKEN = f"{ASSIGN}{VALUE}|(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{{20,}})={{0,2}}"  # looked for where a run of its characters begins
# what every text with a match has, and is found faster
GATES = {"assign": r"""[:=](?<=[dDtTnNyY"'\x20][:=])""", "hex": "[A-Za-z0-9+/_-]{20}", "token": "[A-Za-z0-9+/_-]{20}"}
BLOCK = 256  # matches whose places are added up in a row
LEVELS = 1000  # p in thousandths, so that equal tokens compare alike everywhere

# letters by how common they are in text, so that text fills the first classes
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
# name -> (pattern, alphabet in the order of its classes), narrowest first
ENCODINGS = {
    "decimal": ("[0-9]+", string.digits),
    "hex": ("[0-9a-f]+", "0123456789abcdef"),
    "upper hex": ("[0-9A-F]+", "0123456789ABCDEF"),
    "letters": ("[a-z]+", LETTERS),
    "upper letters": ("[A-Z]+", LETTERS.upper()),
    "base32": ("[A-Z2-7]+", LETTERS.upper() + "234567"),
    "base36": ("[0-9a-z]+", LETTERS + string.digits),
    "upper base36": ("[0-9A-Z]+", LETTERS.upper() + string.digits),
    "base62": ("[0-9A-Za-z]+", LETTERS + LETTERS.upper() + string.digits),
    "base64": ("[0-9A-Za-z+/]+", LETTERS + LETTERS.upper() + string.digits + "+/"),
    "base64url": ("[0-9A-Za-z_-]+", LETTERS + LETTERS.upper() + string.digits + "-_"),
}


def prefix_sums(values: Column, block: int = BLOCK) -> Column:
    """Running sums of an array of longs, in blocks: a sum that is carried on copies what it has gathered, and that is short."""
    empty = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("o"))
    add = lambda z, v: F.struct((z["s"] + v).alias("s"), F.concat(z["o"], F.array(z["s"] + v)).alias("o"))
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    blocks = F.transform(starts, lambda b: F.aggregate(F.slice(values, b * block + 1, F.lit(block)), empty, add))
    # each block's own sums and where it begins, as sums over the totals of those before
    gathered = F.aggregate(
        blocks, F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<long>>").alias("o")),
        lambda z, x: F.struct((z["s"] + x["s"]).alias("s"), F.concat(z["o"], F.array(F.transform(x["o"], lambda v: v + z["s"]))).alias("o")),
    )["o"]
    return F.when(F.size(values) > 0, F.flatten(gathered)).otherwise(F.array().cast("array<long>"))


def matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """df with, for each name, an array of (start, end, group) of the leftmost non-overlapping matches, in code points.

    patterns: name -> (pattern, number of the group). Places come from the lengths of the matches and of what lies between
    them. Texts without a match are looked at once, most of them for a part of the pattern only.
    """
    some = {k: F.col(text).rlike(GATES[k]) & F.col(text).rlike(p) if k in GATES else F.col(text).rlike(p) for k, (p, _) in patterns.items()}
    # a step for each array that is used more than once, or it would be made for each use
    once = {k: F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hits"), F.regexp_extract_all(text, F.lit(p), F.lit(g)).alias("group"), F.split(text, p, -1).alias("gaps")) for k, (p, g) in patterns.items()}
    length = lambda x: F.char_length(x).cast("long")
    widths = lambda m: F.zip_with(F.slice(f"{m}.gaps", F.lit(1), F.size(f"{m}.hits")), f"{m}.hits", lambda g, h: F.struct((length(g) + length(h)).alias("both"), length(h).alias("hit")))
    span = lambda k: F.transform(f"_e_{k}", lambda e, i: F.struct((e - F.get(F.col(f"_w_{k}"), i)["hit"]).alias("start"), e.alias("end"), F.get(F.col(f"_m_{k}.group"), i).alias("group")))
    none = F.array().cast("array<struct<start: long, end: long, group: string>>")
    df = df.select("*", *[F.when(some[k], once[k]).alias(f"_m_{k}") for k in patterns])
    df = df.select("*", *[widths(f"_m_{k}").alias(f"_w_{k}") for k in patterns])
    df = df.select("*", *[F.transform(f"_w_{k}", lambda x: x["both"]).alias(f"_v_{k}") for k in patterns])
    df = df.select("*", *[prefix_sums(F.col(f"_v_{k}")).alias(f"_e_{k}") for k in patterns])
    return df.select("*", *[F.coalesce(F.when(F.col(f"_m_{k}").isNotNull(), span(k)), none).alias(k) for k in patterns]).drop(*[f"_{x}_{k}" for k in patterns for x in "mwve"])


def chi_squared_tail(x: Column, half: Column, most: int = 5) -> Column:
    """P(X >= x) for a chi-squared X with 2 * half degrees of freedom, half at most `most`."""
    term, total = F.lit(1.0), F.lit(1.0)
    for j in range(1, most):
        term = term * x / (2 * j)
        total = total + F.when(half > j, term).otherwise(0.0)
    return F.exp(-x / 2) * total


def battery(token: Column) -> Column:
    """(stratum, level, hash) of a token: its encoding and doublings of length, p in thousandths; null without an encoding.

    p is the tail of the sum of three statistics under even independent characters: chi-squared of the classes of the
    alphabet (3, 5 or 9 of them, by length), squares of the standardised number of changes between the two halves of the
    alphabet and of the standardised lag-one products.
    """
    name = alphabet = F.lit(None).cast("string")
    for k, (pattern, letters) in reversed(ENCODINGS.items()):
        fits = token.rlike(f"^{pattern}$")
        name, alphabet = F.when(fits, F.lit(k)).otherwise(name), F.when(fits, F.lit(letters)).otherwise(alphabet)
    begin = F.struct(token.alias("t"), name.alias("name"), alphabet.alias("alphabet"))
    # each step is bound once by a lambda over an array of one, as expressions that occur twice are worked out twice
    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def values(z):
        symbols = F.transform(F.split(z["t"], ""), lambda c: F.instr(z["alphabet"], c) - 1)
        n = F.char_length(z["t"])
        classes = F.when(n < 32, 3).when(n < 64, 5).otherwise(9)
        return F.struct(symbols.alias("v"), n.alias("n"), F.char_length(z["alphabet"]).alias("k"), classes.alias("c"), z["name"].alias("name"), F.xxhash64(z["t"]).alias("hash"))

    def tested(z):
        v, n, k, c = z["v"], z["n"], z["k"], z["c"]
        of = lambda x: F.floor(x * c / k)
        zero = F.lit(0.0)
        uneven = F.aggregate(
            F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.struct(F.size(F.filter(v, lambda x: of(x) == j)).alias("o"), (n * (F.ceil((j + 1) * k / c) - F.ceil(j * k / c)) / k).alias("e"))),
            zero, lambda s, x: s + (x["o"] - x["e"]) * (x["o"] - x["e"]) / x["e"],
        )
        pairs = F.zip_with(F.slice(v, F.lit(1), n - 1), F.slice(v, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        changes = F.aggregate(pairs, zero, lambda s, x: s + ((x["a"] * 2 < k) != (x["b"] * 2 < k)).cast("double"))
        # twice the distance from the middle, so that sums stay whole numbers
        products = F.aggregate(pairs, zero, lambda s, x: s + (2 * x["a"] - k + 1) * (2 * x["b"] - k + 1))
        m = (n - 1).cast("double")
        runs = (2 * changes - m) * (2 * changes - m) / m
        spread = (k * k - 1) / F.lit(3.0)  # four times the variance of an even value
        serial = products * products / (spread * spread * m)
        return F.struct((uneven + runs + serial).alias("s"), F.floor((c + 1) / 2).alias("half"), n.alias("n"), z["name"].alias("name"), z["hash"].alias("hash"))

    def judged(z):
        p = chi_squared_tail(z["s"], z["half"])
        stratum = F.concat(z["name"], F.lit(":"), F.floor(F.log2(z["n"])).cast("string"))
        return F.struct(stratum.alias("stratum"), F.floor(p * LEVELS).cast("int").alias("level"), z["hash"].alias("hash"))

    return F.when(name.isNotNull(), bind(bind(bind(begin, values), tested), judged))


def cuts(tests: DataFrame, alpha: float) -> dict[str, int]:
    """The least level for each stratum from which at most a share alpha of the distinct tokens is not random.

    tests: stratum, level, hash. Of n tokens from level t on, twice those above the middle times (1 - t) are expected to be
    random. What comes to the driver is a row for each stratum: an encoding and a doubling of length.
    """
    counts = tests.distinct().groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("stratum").orderBy(F.desc("level"))
    counts = counts.withColumn("from_here", F.sum("n").over(over)).withColumn("upper", F.sum(F.when(F.col("level") * 2 >= LEVELS, F.col("n")).otherwise(0)).over(Window.partitionBy("stratum")))
    fine = LEVELS * F.col("from_here") - 2 * F.col("upper") * (LEVELS - F.col("level")) <= F.lit(alpha) * LEVELS * F.col("from_here")
    return {r["stratum"]: r["cut"] for r in counts.where(fine).groupBy("stratum").agg(F.min("level").alias("cut")).collect()}


def _longer(least: int):
    return lambda m: F.char_length(m["group"]) >= least


def placed(spans: Column, kind: str) -> Column:
    """(start, number of the kind, end) of each span."""
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.1) -> DataFrame:
    """(doc_id, spans) for each row; spans: array of (start, kind, end), by start and then kind as listed in KINDS.

    Places are code points, ends exclusive; a span is the whole match. assign, access and hex are the known forms;
    random are tokens that the tests pass and no known form has. alpha: the share of reported random tokens that may be
    something else, in each encoding and length class.

    Null texts count as empty; empty ones have no spans. Repeated rows and ids are scanned each; a token counts once for
    the cuts however often it occurs. An empty table gives no rows; other columns are left out. Texts never leave their
    row; what the second look needs, places and test results, is written as a table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = matches(rows, "text", {k: (p, group) for k, (p, group, _) in KNOWN.items()} | {"token": (TOKEN, 1)})
    known = [placed(F.filter(k, _longer(least)), k) for k, (_, _, least) in KNOWN.items()]
    # tokens that hold a known form are known
    free = F.filter("token", lambda m: (m["group"] != "") & ~m["group"].rlike(f"{KNOWN['access'][0]}|{KNOWN['hex'][0]}"))
    tested = F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["group"]).alias("test")))
    found = scratch.table(rows.select("doc_id", F.concat(*known).alias("known"), F.filter(tested, lambda m: m["test"].isNotNull()).alias("tokens")), "found")
    least = cuts(found.select(F.explode("tokens.test").alias("t")).select("t.*"), alpha)
    cut = F.create_map(*[F.lit(x) for k in sorted(least) for x in (k, least[k])]) if least else F.create_map().cast("map<string, int>")
    passed = F.filter("tokens", lambda m: F.coalesce(m["test"]["level"] >= F.try_element_at(cut, m["test"]["stratum"]), F.lit(False)))
    spans = F.concat("known", placed(passed, "random"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.select("doc_id", F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"))).alias("spans"))
