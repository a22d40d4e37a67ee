"""Document fingerprints: a threshold-scaled sketch of word shingles, DataFrame functions only.

Every 64-bit hash of a shingle that lies in the lowest 1/scale of the hash range is kept, so a sketch grows with its
document, two sketches can be merged by union, and containment between very unequal documents can be estimated from
the sketches alone (Irber et al. 2022, "Lightweight compositional analysis of metagenomes with FracMinHash"). A short text
may have no hash that low. Its least hash then serves to recognise it; it stands beside the sketch and is no part of it,
so unions of sketches stay sketches of unions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prepare import row_positions
from .common import Scratch, words

LOWEST = -(1 << 63)


def shingle_hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of the n-word shingles of an array of word hashes; a shorter sequence is one shingle."""
    whole = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>"))
    runs = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)]))
    return F.when(F.size(hashes) > n, F.slice(runs, F.lit(1), F.size(hashes) - (n - 1))).otherwise(whole)


def sketch(df: DataFrame, texts: dict[str, str], n: int = 5, scale: int = 4) -> DataFrame:
    """Adds for each text column its sketch, a sorted array of distinct hashes. texts: new column -> text column.

    For a new column k, k_least is the least shingle hash of a text whose sketch is empty, else null; it is null too for
    texts without words. Null counts as empty. Equal texts have equal sketches.
    """
    keep = list(df.columns)
    bound = F.lit(LOWEST + (1 << 64) // scale)
    df = df.select(*keep, *[F.transform(words(F.col(t)), lambda w: F.xxhash64(w)).alias(f"_h_{k}") for k, t in texts.items()])
    df = df.select(*keep, *[shingle_hashes(F.col(f"_h_{k}"), n).alias(f"_s_{k}") for k in texts])
    df = df.select(*keep, *[f"_s_{k}" for k in texts], *[F.array_sort(F.array_distinct(F.filter(f"_s_{k}", lambda h: h < bound))).alias(k) for k in texts])
    return df.select(*keep, *texts, *[F.when(F.size(k) == 0, F.array_min(f"_s_{k}")).alias(f"{k}_least") for k in texts])


def encode(sk: Column, least: Column) -> Column:
    """Text form: the hashes of a sketch as 16 hex digits each, ascending, or "~" and the least hash outside it."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.coalesce(F.concat(F.lit("~"), digits(least)), F.array_join(F.transform(sk, digits), ""))


def jaccard(a: Column, b: Column, least_a: Column | None = None, least_b: Column | None = None) -> Column:
    """Estimated likeness of two sketches, 0 to 1; of two empty ones 1, or if least hashes are given whether those agree."""
    both = F.size(F.array_intersect(a, b))
    empty = F.lit(1.0) if least_a is None else least_a.eqNullSafe(least_b).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), empty).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, id_col: str, value_col: str, per_bucket: int = 2000) -> DataFrame:
    """(id_col, value_col, next): next is the value of the next row by falling id, for the last row that of the first.

    Ids are integers; a null id comes last; rows that share an id go by the hash of the value. Repeated rows become one with
    a count before they are shuffled by key; they follow each other, the last of them goes before the next row. The
    others' places come from keys alone, range-partitioned (see row_positions()); buckets are per_bucket places in a row, each
    a window of its own. The first row of a bucket is handed to the one before as well, and the very first to the last.
    """
    scratch = Scratch(docs.sparkSession)
    i, v = F.col(f"`{id_col}`").cast("long"), F.col(f"`{value_col}`")
    # bits turned round: falling ids rise, without overflow
    rows = docs.select(i.isNull().alias("absent"), F.coalesce(F.bitwise_not(i), F.lit(0)).alias("key"), F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2"), v.alias("value"))
    key = ["absent", "key", "k1", "k2"]
    place = row_positions(rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).withColumn("_order", F.struct(*key)), "_order", scratch)
    place = scratch.table(place.drop("_order"), "places")
    n = place.count()
    last = max(0, n - 1) // per_bucket
    one = rows.groupBy(key).agg(F.first("value").alias("value")).join(place, key)
    bucket, pos = F.floor(F.col("pos") / per_bucket), F.col("pos")
    own = F.struct(bucket.alias("b"), pos.alias("o"), F.lit(True).alias("own"))
    first = F.struct(F.lit(last).cast("long").alias("b"), F.lit(n).cast("long").alias("o"), F.lit(False).alias("own"))
    before = F.struct((bucket - 1).alias("b"), pos.alias("o"), F.lit(False).alias("own"))
    homes = F.when(pos == 0, F.array(own, first)).when(pos % per_bucket == 0, F.array(own, before)).otherwise(F.array(own))
    dealt = one.select("absent", "key", "value", "m", F.explode(homes).alias("home")).select("*", "home.*")
    dealt = dealt.withColumn("next", F.lead("value").over(Window.partitionBy("b").orderBy("o"))).where("own")
    dealt = dealt.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    following = F.when(F.col("row") < F.col("m"), F.col("value")).otherwise(F.col("next"))
    return dealt.select(F.when(~F.col("absent"), F.bitwise_not("key")).alias(id_col), F.col("value").alias(value_col), following.alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/3) code points replaced by as many of the first of `following`, or all it has."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, scale: int = 4) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likeness; see edited() and with_next().

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited
    (containment) and n_hashes. Null texts count as empty; repeated ids and extra columns do no harm; an empty table
    gives no rows; a table of one row follows itself.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = with_next(base, "doc_id", "text").withColumn("edited", edited(F.col("text"), F.col("next")))
    # the next document's sketch is made anew from its text: to carry it along would shuffle a third more
    done = sketch(both, {"own": "text", "changed": "edited", "following": "next"}, n, scale)
    likeness = lambda k: jaccard(F.col("own"), F.col(k), F.col("own_least"), F.col(f"{k}_least"))
    return done.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("own"), F.col("own_least")).alias("fingerprint"), encode(F.col("changed"), F.col("changed_least")).alias("edited_fingerprint"),
        likeness("changed").alias("near_edited"), likeness("following").alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("kept_in_edited"), F.size("own").alias("n_hashes"),
    )
