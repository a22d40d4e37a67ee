"""Principal components: from the whole covariance matrix, or for wide vectors from its products with a few directions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sums import SCHEMA, blocks, summed


@dataclass(frozen=True)
class PCAModel:
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained_variance: tuple[float, ...]
    total_variance: float

    def transform(self, df: DataFrame, vector_col: str, out: str = "scores") -> DataFrame:
        """Adds the scores of centred vectors."""
        v = F.col(vector_col)
        mean = F.array(*[F.lit(m) for m in self.mean])
        dots = [F.aggregate(F.zip_with(F.zip_with(v, mean, lambda x, m: x.cast("double") - m), F.array(*[F.lit(w) for w in c]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for c in self.components]
        return df.withColumn(out, F.when(v.isNotNull(), F.array(*dots)))


def _vectors(df: DataFrame, vector_col: str) -> tuple[DataFrame, np.ndarray]:
    """The known vectors as v, and one of them."""
    vectors = df.where(F.col(f"`{vector_col}`").isNotNull()).select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    some = vectors.first()
    if some is None:
        raise ValueError("at least two rows are needed")
    return vectors, np.array(some["v"], float)


def _sums(vectors: DataFrame, n: int, of) -> np.ndarray:
    """n numbers that `of` has for a matrix of vectors, added up over all."""

    def partial(batches):
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += of(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        yield from blocks(total)

    return summed(vectors.mapInArrow(partial, SCHEMA), n)


def covariance(df: DataFrame, vector_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance with n - 1, n) in one job: tasks sum about one vector of the table, Spark adds up the sums block by block."""
    vectors, shift = _vectors(df, vector_col)
    d = len(shift)

    def of(x: np.ndarray) -> np.ndarray:
        x = x - shift
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    total = _sums(vectors, 1 + d + d * d, of)
    n, s = int(total[0]), total[1 : d + 1]
    if n < 2:
        raise ValueError("at least two rows are needed")
    return shift + s / n, (total[d + 1 :].reshape(d, d) - np.outer(s, s) / n) / (n - 1), n


def leading(df: DataFrame, vector_col: str, k: int, tol: float = 1e-9, most: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, k components as rows, their variances, total variance) without the covariance matrix.

    A randomised range finder (Halko, Martinsson and Tropp 2011): covariance times a block of k + 10 directions, which are
    made orthogonal and multiplied again until the k leading ones change by no more than tol times the largest variance, or
    ValueError after `most` rounds, as happens where variances are all but equal. Tasks send d x (k + 10) numbers a round.
    """
    vectors, shift = _vectors(df, vector_col)
    d = len(shift)
    width = min(d, k + 10)

    def moments(x: np.ndarray) -> np.ndarray:
        x = x - shift
        return np.concatenate([[len(x), (x * x).sum()], x.sum(0)])

    total = _sums(vectors, 2 + d, moments)
    n, s = int(total[0]), total[2:]
    if n < 2:
        raise ValueError("at least two rows are needed")
    mean, variance = shift + s / n, (total[1] - s @ s / n) / (n - 1)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, width)))[0]
    for _ in range(most):

        def times(x: np.ndarray, q=q) -> np.ndarray:
            x = x - mean
            return (x.T @ (x @ q)).ravel()

        z = _sums(vectors, d * width, times).reshape(d, width) / (n - 1)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        order = np.argsort(values)[::-1][:k]
        top, off = q @ turn[:, order], z @ turn[:, order] - q @ turn[:, order] * values[order]
        if np.linalg.norm(off, axis=0).max() <= tol * max(values.max(), np.finfo(float).tiny):
            return mean, top.T, values[order], float(variance)
        q = np.linalg.qr(z)[0]
    raise ValueError(f"components have not settled after {most} rounds")


def fit(df: DataFrame, vector_col: str, k: int = 2, widest: int = 1024) -> PCAModel:
    """The k leading components; the loading of largest size of each is positive.

    Vectors of more than `widest` components go through leading(), others through the whole covariance matrix.
    """
    _, some = _vectors(df, vector_col)
    if len(some) > widest:
        mean, top, values, variance = leading(df, vector_col, min(k, len(some)))
    else:
        mean, cov, _ = covariance(df, vector_col)
        values, vectors = np.linalg.eigh(cov)
        top, values, variance = vectors[:, ::-1][:, :k].T, values[::-1][:k], float(np.trace(cov))
    top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
    return PCAModel(tuple(mean.tolist()), tuple(map(tuple, top.tolist())), tuple(values.tolist()), variance)
