"""Reading and writing tables and text collections, with typed errors."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from ..functions.scalars import to_number, valid_utf8
from ..functions.scratch import Scratch


class SourceNotFound(FileNotFoundError):
    """Nothing is at the path."""


class EmptySource(ValueError):
    """The source has no columns or no rows."""


class ParseError(ValueError):
    """A line does not fit the schema."""


class MissingColumns(ValueError):
    """Required columns are absent."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """One state for missing: NaN in float columns becomes null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df itself, or MissingColumns with the absent names; names compare by case."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise MissingColumns(f"missing columns: {', '.join(absent)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise EmptySource("the source has no rows")
    return df


def _loaded(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceNotFound(path) from e
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise EmptySource(path) from e
        raise


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, required: Iterable[str] = (), strict: bool = False) -> DataFrame:
    """CSV with a header. Without a schema types are inferred.

    strict: looks through the whole source first and raises ParseError with a line that does not fit. Otherwise what does
    not fit is null.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = require_rows(require_columns(_loaded(reader.csv, path), required))
    if strict:
        bad = "_corrupt_record"
        while bad in df.columns:
            bad = f"_{bad}"
        whole = StructType([*df.schema.fields, StructField(bad, StringType())])
        line = spark.read.option("header", True).option("columnNameOfCorruptRecord", bad).schema(whole).csv(path).where(F.col(bad).isNotNull()).first()
        if line:
            raise ParseError(f"{path}: a line does not fit the schema: {line[bad][:200]}")
    return nan_to_null(df)


def read_parquet(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    return nan_to_null(require_columns(_loaded(spark.read.parquet, path), required))


def read_parquet_in_order(spark: SparkSession, path: str, required: Iterable[str] = (), out: str = "pos") -> DataFrame:
    """read_parquet() with the 0-based place of each row: files in the order of their paths, rows as they lie in them.

    Rows stay where they are: a place is the row's place in its file and the rows of the files before, of which there is one
    number a file. For tables without an id that says their order.
    """
    df = _loaded(spark.read.parquet, path)
    names = require_columns(df, required).columns
    file, place, first = ("file", "place", "first")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    sizes = df.select(F.col("_metadata.file_path").alias(file)).groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(file).alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    starts = Scratch(spark).table(starts, "files")  # a row for each file
    placed = rows.join(starts, F.col(file) == F.col("of")).select("row.*", (F.col(first) + F.col(place)).alias(out))
    return nan_to_null(placed)


def first_rows(ordered: DataFrame, n: int = 5, pos: str = "pos") -> DataFrame:
    """The first n rows of read_parquet_in_order(), without a sort of the table."""
    return ordered.where(F.col(pos) < n).orderBy(pos)


def read_texts(spark: SparkSession, folder: str, extension: str = ".txt", unreadable: str = "raise") -> DataFrame:
    """(path, text) of all files below folder whose name ends with extension in any case; files without a byte have ''.

    Bytes that are not UTF-8 are dropped. Folders are listed once, which gives the driver the paths; files are read
    in tasks by Spark's own readers, whatever the store. Names that begin with a dot or an underscore are not listed.
    unreadable: "raise", or "empty" for '' in place of what cannot be read; the texts are then written as a table
    first, as only reading tells. SourceNotFound if there is no such folder.
    """
    if unreadable not in ("raise", "empty"):
        raise ValueError("unreadable has to be raise or empty")
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.lower() != c.upper() else c for c in extension)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = _loaded(reader.option("ignoreCorruptFiles", unreadable == "empty").load, folder)
    texts = files.select("path", valid_utf8(F.col("content")).alias("text"))
    if unreadable == "empty":
        texts = Scratch(spark).table(texts, "texts")
    paths = [(unquote(re.sub("^file:///", "file:/", p)),) for p in files.inputFiles()]
    # a scan has no part for an empty file; contents are not read for their paths
    absent = spark.createDataFrame(paths, "path string").join(texts.select("path"), "path", "left_anti")
    return texts.union(absent.select("path", F.lit("").alias("text")))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(token, valence) of a file with a token, a tab and its valence on each line; what follows a second tab is left out.

    Blank lines are skipped; of repeated tokens the last counts. SourceNotFound, EmptySource, or ParseError with the line.
    """
    whole = _loaded(spark.read.option("wholetext", True).text, path)  # a lexicon is one file of moderate size, and its lines have an order
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).where(F.col("line").rlike(r"\S"))
    parts = F.split("line", "\t")
    entries = lines.select("at", "line", parts[0].alias("token"), to_number(F.get(parts, F.lit(1))).alias("valence"))
    bad = entries.where("valence is null or token = ''").orderBy("at").first()
    if bad:
        raise ParseError(f"{path}: no token and number on line {bad['at'] + 1}: {bad['line'][:200]}")
    return require_rows(entries.groupBy("token").agg(F.max_by("valence", "at").alias("valence")))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV folder with headers, replacing what is there; errors are raised."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
