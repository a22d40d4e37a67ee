"""Data behind charts, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from .kmeans import KMeansModel
from .prepare import row_positions
from .profile import correlations, value_counts


def count_series(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """(level, n): bars of a count plot."""
    return value_counts(df if where is None else df.where(where), column)


def scatter_series(labelled: DataFrame, x: str, y: str, cluster: str = "cluster") -> DataFrame:
    """(x, y, cluster): a scatter coloured by label."""
    return labelled.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"), F.col(cluster).alias("cluster"))


def position_series(df: DataFrame, id_col: str, value: str, model: KMeansModel) -> DataFrame:
    """(pos, value, cluster, centre): values by row place with the line of their centre, for one feature."""
    placed = row_positions(model.transform(df), id_col, Scratch(df.sparkSession))
    centre = F.get(F.array(*[F.lit(c[0]) for c in model.centres]), F.col("cluster"))
    return placed.select("pos", F.col(value).alias("value"), "cluster", centre.alias("centre"))


def heat_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, percent): correlations as rounded percentages."""
    return correlations(df, columns).select("col_a", "col_b", F.round(F.col("r") * 100, 0).cast("int").alias("percent"))
