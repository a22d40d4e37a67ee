"""Mixing sources to target weights: entropy balancing, DataFrame functions only.

Each source gets a target of words. Among all document rates in 0 .. cap that meet the targets, entropy balancing takes
those nearest to one copy of each document in relative entropy (Hainmueller 2012, "Entropy balancing for causal effects").
They are exponential tilts, rate = min(cap, exp(lambda_s * size / mean size of s)), and the lambdas solve the convex dual.
Newton iterations find them: at each step the gradient and the Hessian are aggregated over the documents' rates, for all
sources at once. Rates are then rounded into whole copies by error diffusion within small hashed buckets, so each source
lands near its target.

A rate depends on the source and the size alone, so the sums run over a table of (source, size, documents). Their terms
are rounded to decimals first: sums do not depend on the order of rows, and reruns agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prepare import row_positions
from .common import Scratch, words


def exact(c: Column) -> Column:
    """Terms of a sum as decimals of six places, whose sums are the same in any order."""
    return F.sum(c.cast("decimal(32,6)"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float, scratch: Scratch) -> DataFrame:
    """Targets, one row a source: (s, source, source_size, n_docs, least, mean, target); sizes: source, size, n.

    Sources in code-point order, null last, weigh as `weights` repeats and share `share` times all words. A target
    stops at cap times its source's size; what is over goes to the others by weight until none is above. The level at
    which sum(min(cap, level * weight)) is the total is found by Newton steps, each an aggregation over the sources: the sum
    is concave in the level, so they rise to it and end after finitely many.
    """
    per = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("full"),
    )
    per = per.withColumn("_order", F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("name")))
    per = row_positions(per, "_order", scratch, "s").drop("_order")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    per = scratch.table(per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(cap))), "sources")
    level, capped = 0.0, -1
    while True:
        free = F.col("weight") * F.lit(level) < F.col("cap")
        all_words, held, open_, n = per.agg(F.sum("source_size"), exact(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight"))), F.count_if(~free)).first()
        if n == capped or not open_:  # as many are at their cap as before, or all
            break
        level, capped = (share * all_words - float(held or 0)) / open_, n
    mean = F.col("source_size") / F.col("full")
    return per.select("s", "source", "source_size", "n_docs", "least", mean.alias("mean"), F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def rate_of(size: Column, lam: Column, mean: Column, cap: float) -> Column:
    """The tilt of a document; 1 without words."""
    return F.when(size > 0, F.least(F.lit(float(cap)), F.exp(lam * size / mean))).otherwise(F.lit(1.0))


def balance(sizes: DataFrame, targets: DataFrame, cap: float, scratch: Scratch, steps: int = 60, within: float = 1e-7) -> DataFrame:
    """Adds lam to targets: for each source the root of sum(n * size * rate(size)) = target.

    sizes: s, size, n. Newton steps on the dual, which is convex; a step that leaves the bracket known so far is replaced
    by halving it. They end when every source's words are within `within` of its target, or after `steps`.
    """
    edge = F.col("mean") / F.col("least")
    # tilts that are surely too low and too high: even the shortest document's rate is below or at the bound that is needed
    low = F.when(F.col("target") < F.col("source_size"), edge * F.ln(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    high = F.when(F.col("target") > F.col("source_size"), edge * F.ln(F.lit(float(cap)))).otherwise(F.lit(0.0))
    # where all is wanted that the bound allows, that is the highest tilt
    start = F.when(F.col("target") >= F.col("source_size") * F.lit(float(cap)), high).otherwise(F.lit(0.0))
    state = targets.withColumns({"low": low, "high": high, "lam": start}).where("source_size > 0 and target > 0")
    state = scratch.table(state.select("s", "mean", "target", "low", "high", "lam"), "tilts")
    for _ in range(steps):
        x, lam = F.col("size") / F.col("mean"), F.col("lam")
        rate = rate_of(F.col("size"), lam, F.col("mean"), cap)
        took = F.col("n") * F.col("size") * rate
        # a row for each source on one side: broadcast if Spark finds it small enough, else a join that it can split
        sums = sizes.join(state.select("s", "mean", "lam"), "s").groupBy("s").agg(exact(took).cast("double").alias("words"), exact(F.when(rate < cap, took * x)).cast("double").alias("slope"))
        step = state.join(sums, "s").withColumn("gap", F.col("words") - F.col("target"))
        met = F.abs(F.col("gap")) <= F.col("target") * within
        step = step.withColumn("low", F.when(F.col("gap") < 0, lam).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, lam).otherwise(F.col("high")))
        newton = lam - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        after = F.when(met, lam).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        new = scratch.table(step.select("s", "mean", "target", "low", "high", after.alias("lam"), met.alias("met")), "tilts")
        scratch.drop(state)
        state = new
        if state.where("not met").isEmpty():
            break
    return targets.join(state.select("s", "lam"), "s", "left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, bucket: int = 256) -> DataFrame:
    """One row a document: id, source, size (words), source_size, target, rate and copies.

    copies is floor(rate) or one more, at most cap, and the words taken of a source are near its target. Within a
    bucket (about `bucket` documents of one source, by hash) documents go by falling size; each takes the copy more
    when that brings the bucket's running error nearer to zero, so a bucket ends within half of one
    of its shortest documents where it can. Ties go by id, so reruns agree. Null texts have 0 words, and documents without
    words one copy; a null source is a source of its own; repeated rows are separate documents, of which some may take a copy
    more. Extra columns are ignored; an empty table gives no rows.
    """
    sizes = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("size"))
    scratch = Scratch(docs.sparkSession)
    # texts are split only once; repeated rows become one with a count before anything is shuffled by key
    return mix_sizes(scratch.table(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sizes"), weights, share, cap, bucket, scratch)


def mix_sizes(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float, bucket: int, scratch: Scratch) -> DataFrame:
    """As mix(), for a frame of doc_id, source, size and m, the number of such rows."""
    counts = scratch.table(sizes.groupBy("source", "size").agg(F.sum("m").alias("n")), "counts")
    targets = source_targets(counts, weights, share, cap, scratch)
    keyed = counts.join(targets.select("s", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).select("s", "size", "n")
    targets = scratch.table(balance(scratch.table(keyed, "keyed"), targets, cap, scratch), "targets")
    per = targets.select("s", F.col("source").alias("_source"), "source_size", "target", "lam", "mean", F.ceil(F.col("n_docs") / bucket).alias("buckets"))
    # a row for each source; Spark broadcasts it where its size allows, else large partitions are split
    rows = sizes.join(per, F.col("source").eqNullSafe(F.col("_source")), "inner")
    rows = rows.withColumn("rate", F.coalesce(rate_of(F.col("size"), F.col("lam"), F.col("mean"), cap), F.lit(0.0)))
    base = F.floor(F.col("rate") + 1e-9)
    rows = rows.withColumn("base", base.cast("int")).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - base))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.col("buckets")))
    grouped = rows.groupBy("s", "bucket").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "m", "base", "part", "rate")), asc=False).alias("docs"))

    def place(acc: Column, x: Column) -> Column:
        """The number of x's m rows that take a copy more."""
        owed = acc["owed"] + x["size"] * x["m"] * x["part"]
        extra = F.when((x["part"] > 0) & (x["size"] > 0), F.greatest(F.lit(0), F.least(x["m"], F.floor(owed / x["size"] + 0.5)))).otherwise(F.lit(0)).cast("long")
        return F.struct((owed - extra * x["size"]).alias("owed"), F.concat(acc["extra"], F.array(extra)).alias("extra"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("extra"))
    grouped = grouped.withColumn("extra", F.aggregate("docs", start, place, lambda acc: acc["extra"]))
    out = grouped.select("s", F.explode(F.arrays_zip("docs", "extra")).alias("d")).select("s", "d.docs.*", "d.extra")
    # repeated rows come apart again
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    out = out.join(targets.select("s", "source", "source_size", "target"), "s")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("base") + (F.col("row") <= F.col("extra")).cast("int")).cast("int").alias("copies"))
