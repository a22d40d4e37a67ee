"""Feed-forward classifier: dense ReLU layers, softmax, Adam, with gradients summed over the cluster."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argmax
from ..functions.scratch import Scratch
from ..functions.sums import SCHEMA, blocks, summed
from .prepare import row_positions

Layers = list[tuple[np.ndarray, np.ndarray]]

ROWS_A_FILE = 100_000


def initial_layers(sizes: list[int], seed: int) -> Layers:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer, the input first and probabilities last."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        if k < len(layers) - 1:
            z = np.maximum(z, 0)
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        out.append(z)
    return out


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum over rows of the gradient of the cross-entropy, flat, and of the loss."""
    acts = forward(layers, x)
    loss = -np.log(acts[-1][np.arange(len(y)), y] + 1e-12).sum()
    d = acts[-1].copy()
    d[np.arange(len(y)), y] -= 1
    parts = []
    for k in range(len(layers) - 1, -1, -1):
        parts += [d.sum(axis=0), (acts[k].T @ d).ravel()]
        if k:
            d = (d @ layers[k][0].T) * (acts[k] > 0)
    return np.concatenate(parts[::-1]), float(loss)


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([v for w, b in layers for v in (w.ravel(), b)])


def _shaped(flat: np.ndarray, sizes: list[int]) -> Layers:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


@dataclass(frozen=True)
class MLPModel:
    layers: Layers
    losses: tuple[float, ...]  # of each epoch
    held_out_losses: tuple[float, ...] = ()

    def transform(self, df: DataFrame, vector_col: str) -> DataFrame:
        """Adds probability (array), prediction (first of the most probable) and confidence; all null for a null vector."""
        layers = self.layers

        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), index=v.index, dtype=object)
            known = v[v.notna()]
            if len(known):
                out[known.index] = list(forward(layers, np.stack(known.to_list()).astype(float))[-1])
            return out

        out = df.withColumn("probability", run(F.col(vector_col)))
        return out.withColumn("prediction", argmax(F.col("probability"))).withColumn("confidence", F.array_max("probability"))


def laid_out(df: DataFrame, vector_col: str, label_col: str, batches: int, batch_size: int | None, validation: float, order_col: str | None, scratch: Scratch) -> tuple[DataFrame, int]:
    """(rows (v, y, batch), number of batches): a table with a folder for each batch, so that a step reads its own rows only.

    Batches are dealt by hash. Batch -1 are the rows left out for validation: the last share by order_col, or without
    one a share by hash.
    """
    rows = df.where(F.col(f"`{vector_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    v = F.col(f"`{vector_col}`")
    names = [v.cast("array<double>").alias("v"), F.col(f"`{label_col}`").cast("int").alias("y"), F.xxhash64(v).alias("h")]
    if validation and order_col:
        placed = row_positions(rows.select(*names, F.col(f"`{order_col}`").alias("at")), "at", scratch)
        n = placed.count()
        rows = placed.select("v", "y", "h", (F.col("pos") >= int(n * (1 - validation))).alias("held"))
    else:
        n = rows.count()
        rows = rows.select(*names, (F.pmod(F.xxhash64(F.lit("held out"), v), F.lit(10_000)) < validation * 10_000).alias("held"))
    if not n:
        raise ValueError("no rows to learn from")
    if batch_size:
        batches = max(1, -(-(n - int(n * validation)) // batch_size))
    rows = rows.withColumn("batch", F.when(F.col("held"), -1).otherwise(F.pmod("h", F.lit(batches))).cast("int"))
    files = F.pmod(F.xxhash64("h"), F.lit(max(1, n // batches // ROWS_A_FILE)))
    path = scratch.path("batches")
    rows.repartition("batch", files).select("v", "y", "batch").write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema("v array<double>, y int, batch int").parquet(path), batches


def fit(df: DataFrame, vector_col: str, label_col: str, hidden: tuple[int, ...] = (128, 64), classes: int = 10, epochs: int = 3, batches: int = 8, rate: float = 0.001, seed: int = 42, batch_size: int | None = None, validation: float = 0.0, order_col: str | None = None) -> MLPModel:
    """Synchronous Adam: each step reads the rows of one batch, sums their gradients where they lie and updates the weights,
    whose number is fixed by the layers, on the driver. Order of rows and partitions only moves rounding.

    batch_size, if given, sets the number of batches. `validation` is the share of rows that is left out of the steps, the
    last ones by order_col or else by hash; the loss on them after each epoch is kept. Rows without a vector or label are
    left out.
    """
    rows, batches = laid_out(df, vector_col, label_col, batches, batch_size, validation, order_col, Scratch(df.sparkSession))
    sizes = [rows.select(F.size("v")).first()[0], *hidden, classes]
    flat = _flat(initial_layers(sizes, seed))

    def totals(batch: int, layers: Layers) -> np.ndarray:
        """Sums over the rows of a batch: the gradient, the loss, the number of rows."""

        def partial(parts):
            total = np.zeros(len(flat) + 2)
            for part in parts:
                if part.num_rows:
                    x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    g, loss = gradient(layers, x, part.column(1).to_numpy())
                    total += np.concatenate([g, [loss, part.num_rows]])
            if total[-1]:
                yield from blocks(total)

        return summed(rows.where(F.col("batch") == batch).select("v", "y").mapInArrow(partial, SCHEMA), len(flat) + 2)

    m = s = np.zeros_like(flat)
    losses, outside, t = [], [], 0
    for _ in range(epochs):
        loss = n = 0
        for k in range(batches):
            total = totals(k, _shaped(flat, sizes))
            count = total[-1]
            if not count:
                continue
            loss, n, t = loss + total[-2], n + count, t + 1
            g = total[:-2] / count
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)
        losses.append(float(loss / n) if n else float("nan"))
        if validation:
            total = totals(-1, _shaped(flat, sizes))
            outside.append(float(total[-2] / total[-1]) if total[-1] else float("nan"))
    return MLPModel(_shaped(flat, sizes), tuple(losses), tuple(outside))


def evaluate(predicted: DataFrame, label_col: str) -> DataFrame:
    """(n, loss, accuracy) of a table of probabilities."""
    p = F.get(F.col("probability"), F.col(label_col).cast("int"))
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"), F.avg((argmax(F.col("probability")) == F.col(label_col)).cast("double")).alias("accuracy"))
