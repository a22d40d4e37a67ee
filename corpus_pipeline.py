"""Corpus pipeline: five stages from raw documents to a mixed and encoded corpus.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import minhash, mixing, pieces, quality, substrings
from lodestone.llm.common import Scratch


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of sf_dir, does not reject.

    Null and empty texts are scored too; repeated rows stay or go together. An empty table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a likeness of 0.8 or more over five-word shingles: that of least id.

    Rows that share an id stay or go together; rows without an id and texts without words stay.
    """
    gone = minhash.near_duplicates(docs, n=5, percent=80).where("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*quoted(docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go.

    Passages are runs of whole sentences of 25 words or more, and stretches of more than 50 words wherever they begin and end.
    Null and blank texts that had nothing removed stay. Of rows that share an id and a text all stay; a null id is last.
    """
    out = substrings.dedup(docs, within_sentences=True).where("n_removed = 0 or text rlike '\\\\S'")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times; documents without words once.

    Rows that share an id share their copies out evenly, rounded up. A null source is a source of its own.
    """
    counts = mixing.mix(docs).groupBy(F.col("doc_id").alias("id")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    row = docs.select(F.col("doc_id").alias("id"), F.struct(*quoted(docs.columns)).alias("row"))
    joined = row.join(counts.withColumnRenamed("id", "other"), F.col("id").eqNullSafe(F.col("other")), "inner")
    times = F.ceil(F.col("copies") / F.col("rows")).cast("int")
    return joined.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of each text's best segmentation, their number, and the scores of the two best.

    Null texts have null ids and scores and 0 pieces, empty texts no ids. Other columns are left out.
    """
    out = pieces.encode(docs.select("doc_id", "source", "text"), pieces.load())
    return out.select("doc_id", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "piece_score", F.get("runner_up", F.lit(0)).alias("second_score"))


def quoted(names: list[str]) -> list[str]:
    return [f"`{c}`" for c in names]


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# A trained model, sketches and a piece lattice are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
