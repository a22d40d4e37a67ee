"""Whole analyses in one call: sources, preparation, result and report."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from ..operators import dbscan, hdbscan, kmeans, optics, prepare, profile, sentiment
from ..sources import loaders

log = logging.getLogger(__name__)


def configure_logging(verbose: bool = False) -> None:
    """Times and levels before messages; debug messages if verbose."""
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)s [%(levelname)s] %(message)s", datefmt="%H:%M:%S")


@dataclass(frozen=True)
class SentimentRun:
    """scored: (doc_id, text, scores, label) of the sample; distribution: (label, n, percent); examples: its first texts by path."""

    scored: DataFrame
    distribution: DataFrame
    examples: DataFrame

    def report(self) -> str:
        """The distribution as lines of text, and the examples below."""
        rows = {r["label"]: r for r in self.distribution.collect()}
        lines = [f"Texts analysed: {sum(r['n'] for r in rows.values())}"]
        lines += [f"{label.capitalize():8s}: {rows[label]['n']:5d} ({rows[label]['percent']:5.1f}%)" for label in sentiment.LABELS]
        lines += [f"{r['start']}... | {r['compound']:.4f} | {r['label']}" for r in self.examples.collect()]
        return "\n".join(lines)


def sentiment_run(spark: SparkSession, folder: str, lexicon: str, extension: str = ".txt", most: int = 2000, seed: int = 42, examples: int = 5) -> SentimentRun:
    """Scores up to `most` of the texts below a folder, drawn by seed, with the lexicon of a file; blank ones are skipped.

    A folder without such files gives empty results. The sample is drawn from paths, so that texts are read for it alone:
    it is written as a table, from which all results are taken.
    """
    if most < 1:
        raise ValueError("at least one text has to be asked for")
    entries = loaders.read_lexicon(spark, lexicon)
    texts = loaders.read_texts(spark, folder, extension).withColumnRenamed("path", "doc_id")
    chosen = sentiment.sample(texts.select("doc_id"), most, seed)
    # the paths drawn number `most` at the most
    drawn = texts.join(F.broadcast(chosen), "doc_id", "left_semi") if most <= 100_000 else texts.join(chosen, "doc_id", "left_semi")
    scored = Scratch(spark).table(sentiment.analyse(drawn, entries), "scored")
    log.info("scored %d texts below %s, at most %d asked for", scored.count(), folder, most)
    return SentimentRun(scored, sentiment.distribution(scored), sentiment.examples(scored, examples))


@dataclass(frozen=True)
class ClusterRun:
    """rows: the source's columns and the labels; summary: (cluster, n_points, and with k-means the centres)."""

    rows: DataFrame
    summary: DataFrame

    def report(self) -> str:
        """A line for each cluster, noise first as such."""
        lines = []
        for r in self.summary.orderBy("cluster").collect():
            centres = "".join(f", {c} {r[c]:.2f}" for c in self.summary.columns[2:])
            lines.append(f"{'Noise' if r['cluster'] == -1 else 'Cluster ' + str(r['cluster'])}: {r['n_points']} points{centres}")
        return "\n".join(lines)


def _numbered(spark: SparkSession, source: str, features: Sequence[str]) -> tuple[DataFrame, str]:
    """The rows of a CSV file with their places, and the name of the places."""
    df = loaders.read_csv(spark, source, required=features)
    pos = prepare.unused(df, "pos")
    return Scratch(spark).table(prepare.in_order(df, pos), "source"), pos


def _usable(df: DataFrame, pos: str, features: Sequence[str]) -> DataFrame:
    """(id, x0, x1, ...) of the rows whose features are all numbers; a warning says how many are not, ValueError if none is."""
    x = [f"x{j}" for j in range(len(features))]
    rows = df.select(F.col(f"`{pos}`").alias("id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(features, x)])
    coerced = prepare.coerce(rows, x)
    n = prepare.dropped_rows(coerced, x).first()
    if n["n_dropped"]:
        log.warning("%d of %d rows have a feature that is no number", n["n_dropped"], n["n_before"])
    if not n["n_after"]:
        raise ValueError("no rows are left")
    return prepare.drop_missing(coerced, x)


def _attached(df: DataFrame, pos: str, labels: DataFrame, keep_all: bool) -> DataFrame:
    """df without its places, with the columns of labels (id and others), which replace those of their names."""
    new = [c for c in labels.columns if c != "id"]
    taken = {c.lower() for c in new}
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != pos and c.lower() not in taken]).alias("row"), F.col(f"`{pos}`").alias("id"))
    return rows.join(labels, "id", "left" if keep_all else "inner").select("row.*", *[F.col(f"`{c}`") for c in new])


def _done(rows: DataFrame, summary: DataFrame, out: str | None) -> ClusterRun:
    if out:
        loaders.write_csv(rows, out)
        log.info("wrote %s", out)
    return ClusterRun(rows, summary)


def kmeans_run(spark: SparkSession, source: str, out: str | None = None, features: Sequence[str] = ("Price",), k: int = 3, seed: int = 42) -> ClusterRun:
    """k-means of a CSV file from k-means++ seeds: rows with numbers in all features, with their Cluster, also written to out.

    Clusters are numbered by ascending centre.
    """
    df, pos = _numbered(spark, source, features)
    usable = _usable(df, pos, features)
    x = [f"x{j}" for j in range(len(features))]
    model = kmeans.kmeans(usable, x, k, init="k-means++", seed=seed, id_col="id")
    labels = model.transform(usable, "Cluster").select("id", "Cluster")
    summary = model.summary(usable)
    return _done(_attached(df, pos, labels, False), summary.toDF("cluster", "n_points", *[f"centre {c}" for c in features]), out)


def dbscan_run(spark: SparkSession, source: str, out: str | None = None, features: Sequence[str] = ("year", "month", "value"), eps: float = 0.5, min_samples: int = 10) -> ClusterRun:
    """DBSCAN of the scaled features of a CSV file: all rows with cluster_label, null where a feature is no number."""
    df, pos = _numbered(spark, source, features)
    found = dbscan.dbscan(_usable(df, pos, features), "id", [f"x{j}" for j in range(len(features))], eps, min_samples)
    labels = Scratch(spark).table(found.select("id", F.col("cluster").alias("cluster_label")), "labels")
    return _done(_attached(df, pos, labels, True), labels.groupBy(F.col("cluster_label").alias("cluster")).agg(F.count(F.lit(1)).alias("n_points")), out)


def hdbscan_run(spark: SparkSession, source: str, out: str | None = None, features: Sequence[str] = ("Consumption (therms)", "Consumption (GJ)"), min_cluster_size: int = 10, min_samples: int | None = None) -> ClusterRun:
    """HDBSCAN of a CSV file: rows with numbers in all features, with Cluster and Cluster_Probability."""
    df, pos = _numbered(spark, source, features)
    found = hdbscan.hdbscan(_usable(df, pos, features), "id", [f"x{j}" for j in range(len(features))], min_cluster_size, min_samples)
    labels = Scratch(spark).table(found.select("id", F.col("cluster").alias("Cluster"), F.col("probability").alias("Cluster_Probability")), "labels")
    return _done(_attached(df, pos, labels, False), labels.groupBy(F.col("Cluster").alias("cluster")).agg(F.count(F.lit(1)).alias("n_points")), out)


def optics_run(spark: SparkSession, source: str, eps: float, min_pts: int, features: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ordering, first ten of it) of a CSV file; features as for prepare.pick_features(), by default all number columns.

    Ids of the ordering are places of rows; missing values take the column's mean.
    """
    df, pos = _numbered(spark, source, [])
    chosen = prepare.pick_features(features, [c for c in profile.numeric_columns(df) if c != pos])
    if not chosen:
        raise ValueError("no number columns")
    ordered = Scratch(spark).table(optics.optics(df, pos, chosen, eps, min_pts), "ordered")
    return ordered, optics.optics_report(ordered)
