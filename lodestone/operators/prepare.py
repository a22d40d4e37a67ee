"""Preparation of features: coercion, missing values, recoding, encoding, scaling, row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from ..functions.scalars import to_number
from ..functions.scratch import Scratch
from ..sources.loaders import require_columns
from .profile import column_quantiles, missing


def require_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    bad = [c for c in columns if not isinstance(df.schema[c].dataType, NumericType)]
    if bad:
        raise ValueError(f"not numeric: {', '.join(bad)}")
    return df


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, null where a value is no plain number."""
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})


def _complete(df: DataFrame, columns: list[str]) -> Column:
    """Whether all the columns are present."""
    full = F.lit(True)
    for c in columns:
        full = full & ~missing(df, c)
    return full


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all the columns present (neither null nor NaN)."""
    return df.where(_complete(df, columns)) if columns else df


def dropped_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_before, n_after, n_dropped) of drop_missing, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(_complete(df, columns)).alias("n_after"))
    return one.withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def fill_statistics(df: DataFrame, columns: list[str], how: str, in_one_pass: int = 5_000_000) -> dict[str, float]:
    """Mean or exact median of each column, missing skipped. A column without any value raises ValueError.

    Medians of tables too large for one task's state come from profile.column_quantiles().
    """
    f = {"mean": F.avg, "median": F.median}[how]
    if how == "median" and df.count() > in_one_pass:
        found = column_quantiles(df, columns, [0.5])
        got = [found[c][0] for c in columns]
    else:
        got = df.agg(*[f(_present(c)).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    empty = [c for k, c in enumerate(columns) if got[k] is None]
    if empty:
        raise ValueError(f"no values to take a {how} of: {', '.join(empty)}")
    return {c: got[k] for k, c in enumerate(columns)}


def impute(df: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """Missing values of the columns replaced by the column's mean or median."""
    stats = fill_statistics(df, columns, how)
    return df.withColumns({c: F.coalesce(_present(c), F.lit(v)) for c, v in stats.items()})


def prepare_features(df: DataFrame, columns: list[str], policy: str = "drop") -> DataFrame:
    """Coerces the columns, then drops incomplete rows, or imputes by mean or median; fails if no row is left."""
    out = coerce(require_columns(df, columns), columns)
    out = drop_missing(out, columns) if policy == "drop" else impute(out, columns, policy)
    if out.isEmpty():
        raise ValueError("no rows are left")
    return out


def replace_levels(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def first_columns(df: DataFrame, n: int) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:n]])


def pick_features(spec: str | None, available: list[str], default: list[str] | None = None) -> list[str]:
    """Names from a comma-separated list of names or 0-based places; blanks are skipped; nothing chosen gives the default."""
    out = []
    for part in (p.strip() for p in (spec or "").split(",")):
        if not part:
            continue
        if part in available:
            out.append(part)
        elif part.isdigit() and int(part) < len(available):
            out.append(available[int(part)])
        else:
            raise ValueError(f"no such feature: {part}")
    return out or list(default if default is not None else available)


def levels(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct levels. They become columns, so there have to be few."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def one_hot(df: DataFrame, columns: list[str], known: dict[str, list[str]] | None = None) -> DataFrame:
    """Each column replaced by an indicator for every level, named <column>_<level>; null gives zeros."""
    out = df
    for c in columns:
        for level in (known or {}).get(c) or levels(df, c):
            out = out.withColumn(f"{c}_{level}", F.when(F.col(c) == level, 1).otherwise(0))
    return out.drop(*columns)


def _present(c: str) -> Column:
    """A column as double, NaN as null."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def _scaled(df: DataFrame, columns: list[str], stats, scale) -> DataFrame:
    """df with the columns scaled by a row of statistics, which lies beside them in a struct of an unused name."""
    name = unused(df, "stats")
    one = df.agg(F.struct(*[f(_present(c)).alias(f"{k}{n}") for n, c in enumerate(columns) for k, f in stats.items()]).alias(name))
    made = {c: scale(_present(c), *[F.col(f"{name}.{k}{n}") for k in stats]) for n, c in enumerate(columns)}
    out = df.crossJoin(F.broadcast(one))  # one row
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def unused(df: DataFrame, name: str) -> str:
    """name with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; 0 where a column is constant. Missing stays missing."""
    return _scaled(df, columns, {"m": F.avg, "s": F.stddev_pop}, lambda x, m, s: F.when(s > 0, (x - m) / s).when(x.isNotNull(), 0.0))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - min) / (max - min); 0 where a column is constant. Missing stays missing."""
    return _scaled(df, columns, {"l": F.min, "h": F.max}, lambda x, low, high: F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), 0.0))


def require_long_ids(df: DataFrame, id_col: str) -> DataFrame:
    """df itself, or ValueError unless the ids are whole numbers; others can be numbered by row_positions()."""
    require_columns(df, [id_col])
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"ids have to be whole numbers: {id_col}")
    return df


def attach_labels(df: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """All rows of df with the label of their id; null where there is none."""
    return df.join(labels, id_col, "left")


def row_positions(df: DataFrame, id_col: str, scratch, out: str = "pos") -> DataFrame:
    """Adds the 0-based place of each row by ascending id, without one task that sorts all.

    Rows are range-partitioned and sorted; the counts of earlier partitions (a row for each) give the offset.
    """
    key, (part, n, offset, local) = F.col(f"`{id_col}`"), [unused(df, k) for k in ("part", "n", "offset", "local")]
    ranged = df.repartitionByRange(key).withColumn(part, F.spark_partition_id())
    ranged = scratch.table(ranged, "ranged")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    offsets = counts.withColumn(offset, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    placed = ranged.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1).join(offsets, part)
    names = [F.col(f"`{c}`") for c in df.columns if c != out]
    return placed.select(*names, (F.col(offset) + F.col(local)).cast("long").alias(out))


def in_order(df: DataFrame, out: str = "pos") -> DataFrame:
    """The rows of files just read, of any format, with their 0-based places in the order of paths and places within files.

    Where a format has no row numbers, as CSV, rows are sorted by file, block and place in the block, over all tasks.
    """
    scratch = Scratch(df.sparkSession)
    key = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))
    return row_positions(scratch.table(rows, "rows"), "key", scratch, "at").select("row.*", F.col("at").alias(out))
