"""Profiles of tables: descriptive statistics, counts, missing values, correlations, chart series."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ..functions.scratch import Scratch


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of number types; booleans are not numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def missing(df: DataFrame, c: str) -> Column:
    """Whether a value is null or NaN."""
    col = F.col(f"`{c}`")
    return col.isNull() | F.isnan(col) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else col.isNull()


def _unpivot(one: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """Rows (column, *fields) from a one-row frame of structs s0, s1, ..."""
    items = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"s{k}.{f}").alias(f) for f in fields]) for k, n in enumerate(names)])
    return one.select(F.explode(items).alias("r")).select("r.*")


def _ranked(values: DataFrame, qs: list[float]) -> DataFrame:
    """(level, n, min, max, q) of values (level, v): exact quantiles of each level with linear interpolation, q an array.

    Counts of distinct values are range-partitioned by level and value, and only totals of (level, partition) say where a
    rank lies; there it is looked up. However many levels there are, and whatever their sizes, it takes one shuffle by range
    and no task holds all values of a level.
    """
    scratch = Scratch(values.sparkSession)
    counts = values.groupBy("level", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = scratch.table(counts.repartitionByRange("level", "v").withColumn("part", F.spark_partition_id()), "ranged")
    # a level lies in adjoining partitions, so there are no more totals than levels and partitions together
    before = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("level", "part").agg(F.sum("n").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
    parts = parts.select("level", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), *[f(c).over(Window.partitionBy("level")).alias(c) for f, c in ((F.sum, "m"), (F.min, "low"), (F.max, "high"))])
    here = Window.partitionBy("level", "part").orderBy("v")
    placed = ranged.withColumn("upto", F.sum("n").over(here)).join(parts.withColumnRenamed("level", "l"), F.col("level").eqNullSafe(F.col("l")) & (ranged["part"] == parts["part"]))
    placed = placed.select("level", "v", "m", "low", "high", (F.col("start") + F.col("upto") - F.col("n")).alias("first"), (F.col("start") + F.col("upto") - 1).alias("last"))
    rank = [F.lit(q) * (F.col("m") - 1) for q in qs]
    at = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("v")))
    got = placed.groupBy("level").agg(F.first("m").alias("n"), F.first("low").alias("min"), F.first("high").alias("max"), *[x for k, r in enumerate(rank) for x in (at(F.floor(r)).alias(f"a{k}"), at(F.ceil(r)).alias(f"b{k}"))])
    part = [F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for q in qs]
    return got.select("level", "n", "min", "max", F.array(*[F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * x for k, x in enumerate(part)]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column with linear interpolation, for tables of any size; None where a column has no values.

    All columns go through the same few jobs; Spark's percentile holds all distinct values of a column in one task.
    """
    clean = [F.struct(F.lit(k).alias("level"), F.when(~missing(df, n), F.col(f"`{n}`").cast("double")).alias("v")) for k, n in enumerate(columns)]
    got = {r["level"]: r["q"] for r in _ranked(df.select(F.inline(F.array(*clean))).where("v is not null"), qs).collect()}
    return {n: got.get(k, [None] * len(qs)) for k, n in enumerate(columns)}


def quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """column_quantiles() of one column."""
    return column_quantiles(df, [column], qs)[column]


def describe(df: DataFrame, columns: list[str] | None = None, in_one_pass: int = 5_000_000) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) of numeric columns; quartiles interpolate linearly.

    Missing values are skipped; std has n - 1 below the line. Up to in_one_pass rows the exact quartiles come with the other
    statistics in a single pass; beyond, where their state would outgrow a task, from column_quantiles().
    """
    names, parts = columns or numeric_columns(df), [0.25, 0.5, 0.75]
    apart = column_quantiles(df, names, parts) if df.count() > in_one_pass else None
    stats = []
    for k, n in enumerate(names):
        c = F.when(~missing(df, n), F.col(f"`{n}`").cast("double"))
        q = F.array(*[F.lit(v) for v in apart[n]]).cast("array<double>") if apart else F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        stats.append(F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(c).alias("max")).alias(f"s{k}"))
    return _unpivot(df.agg(*stats), names, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(level, n), missing left out, most frequent first, ties by level."""
    return df.where(~missing(df, column)).groupBy(F.col(f"`{column}`").alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, a missing one included."""
    return df.select(F.col(f"`{column}`").alias("level")).distinct()


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """(label, n) by ascending label, so noise comes first."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label")


def counts_of(df: DataFrame, column: str, labels: list) -> DataFrame:
    """(label, n) for a fixed set of labels; 0 where none occurs."""
    keys = df.sparkSession.createDataFrame([(v,) for v in labels], ["label"])
    got = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def percentages(counts: DataFrame) -> DataFrame:
    """Adds percent = n / total * 100, 0 if the total is not above 0. A row for each label."""
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.when(F.col("_t") > 0, F.col("n") / F.col("_t") * 100).otherwise(0.0).alias("percent"))  # one row


def null_report(df: DataFrame) -> DataFrame:
    """(column, n_missing) of every column in one pass."""
    names = df.columns
    one = df.agg(*[F.struct(F.count_if(missing(df, n)).alias("n_missing")).alias(f"s{k}") for k, n in enumerate(names)])
    return _unpivot(one, names, ["n_missing"])


def null_total(df: DataFrame) -> DataFrame:
    return null_report(df).agg(F.sum("n_missing").alias("n_missing"), (F.sum("n_missing") > 0).alias("any_missing"))


def schema_info(df: DataFrame) -> DataFrame:
    """(column, type, n_present)."""
    types = dict(df.dtypes)
    one = df.agg(*[F.struct(F.lit(types[n]).alias("type"), F.count_if(~missing(df, n)).alias("n_present")).alias(f"s{k}") for k, n in enumerate(df.columns)])
    return _unpivot(one, df.columns, ["type", "n_present"])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r): Pearson correlation of each pair over the rows where both are present, in one pass."""
    names = columns or numeric_columns(df)
    clean = df.select(*[F.when(~missing(df, n), F.col(f"`{n}`").cast("double")).alias(f"c{k}") for k, n in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))
    one = clean.agg(*[F.corr(f"c{a}", f"c{b}").alias(f"r{a}_{b}") for a, b in pairs], F.lit(1.0).alias("one"))
    cells = [F.struct(F.lit(names[a]).alias("col_a"), F.lit(names[b]).alias("col_b"), F.col("one" if a == b else f"r{min(a, b)}_{max(a, b)}").alias("r")) for a in range(len(names)) for b in range(len(names))]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def crosstab(df: DataFrame, rows: str, columns: str, levels: list[str]) -> DataFrame:
    """Counts with the given levels of one column as columns."""
    return df.groupBy(rows).pivot(columns, levels).agg(F.count(F.lit(1))).na.fill(0)


def group_quartiles(df: DataFrame, group: str, value: str, in_one_pass: int = 5_000_000) -> DataFrame:
    """(level, n, min, p25, p50, p75, max): what a violin or box chart draws; a missing level is a level, missing values are skipped.

    Exact, with linear interpolation. Up to in_one_pass rows they come in a single pass; beyond, where the state of a group
    would outgrow a task, see _ranked().
    """
    rows = df.where(~missing(df, value)).select(F.col(f"`{group}`").alias("level"), F.col(f"`{value}`").cast("double").alias("v"))
    if df.count() <= in_one_pass:
        q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        one = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"))
        return one.select("level", "n", "min", *[F.col("q")[k].alias(c) for k, c in enumerate(("p25", "p50", "p75"))], "max")
    return _ranked(rows, [0.25, 0.5, 0.75]).select("level", "n", "min", *[F.col("q")[k].alias(c) for k, c in enumerate(("p25", "p50", "p75"))], "max")


def density_grid(df: DataFrame, group: str, value: str, points: int = 100, cut: float = 2.0, bins: int = 1024) -> DataFrame:
    """(level, place, at, density): Gaussian kernel estimates of a value in each group, as a violin chart draws them.

    The bandwidth is Scott's: the sample standard deviation times n ** -0.2. The grid has that many points from cut bandwidths
    below the least value to cut above the greatest. Values are first dealt to bins of equal width between the two, each
    shared out between the two bins it lies between, so what a group costs does not grow with its rows and no task holds
    its values; the error is of the order of (bin width / bandwidth) squared. A missing level is a level, missing values are
    skipped, and groups with fewer than two different values have no grid.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.where(~missing(df, value)).select(F.col(f"`{group}`").alias("level"), F.col(f"`{value}`").cast("double").alias("v"))
    stats = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("s"))
    stats = stats.where("high > low").select(F.col("level").alias("of"), "n", "low", "high", (F.col("s") * F.pow("n", F.lit(-0.2))).alias("h"))
    stats = scratch.table(stats, "stats")  # a row for each group
    step = (F.col("high") - F.col("low")) / (bins - 1)
    at = (F.col("v") - F.col("low")) / step
    whole = F.least(F.floor(at), F.lit(bins - 2))
    shares = F.array(F.struct(whole.alias("bin"), (1 - (at - whole)).alias("w")), F.struct((whole + 1).alias("bin"), (at - whole).alias("w")))
    dealt = rows.join(stats, F.col("level").eqNullSafe(F.col("of"))).select("level", F.inline(shares)).groupBy("level", "bin").agg(F.sum("w").alias("w"))
    held = dealt.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("held"))  # bins at most
    made = held.join(stats, F.col("level").eqNullSafe(F.col("of")))
    begin, end = F.col("low") - cut * F.col("h"), F.col("high") + cut * F.col("h")
    made = made.select("level", "n", "h", "low", step.alias("step"), "held", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: begin + (end - begin) * k / (points - 1))).alias("place", "at"))
    far = lambda b: (F.col("at") - F.col("low") - b["bin"] * F.col("step")) / F.col("h")
    total = F.aggregate("held", F.lit(0.0), lambda t, b: t + b["w"] * F.exp(far(b) * far(b) / -2))
    return made.select("level", "place", "at", (total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def head(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """The first n rows by id."""
    return df.orderBy(id_col).limit(n)
