"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node is a conjunction
of threshold tests. A lasso logistic regression over those rules keeps a few and weighs them (Friedman and Popescu
2008, "Predictive learning via rule ensembles"). The fitted rules are compiled into one Spark column expression over
the statistics, so scoring a corpus of any size is a scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digit", "symbol", "exclaim", "pipe", "comma_stop", "space", "non_ascii",
    "distinct_words", "distinct_lines", "top_word", "line_length", "word_symbol_ends", "upper_words",
)
SCHEMA = ", ".join(f"{s} double" for s in STATS)
SYMBOLS = b"#$%&*<>{}[]_=+~^@/\\"


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The STATS of one whole text; ratios of empty texts are 0."""
    raw = (text or "").encode("utf-8", "replace")
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    w = max(1, len(words))
    counts = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, int)
    top = np.bincount(counts).max() if words else 0
    lengths = np.fromiter(map(len, words), int, len(words))
    ends = sum(x[-1] in "#$%&*!|" for x in words)
    return (
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean() if words else 0.0, float((lengths > 20).mean()) if words else 0.0,
        bins[65:91].sum() / n, bins[48:58].sum() / n, sum(bins[c] for c in SYMBOLS) / n, (bins[33] + bins[63]) / n, bins[124] / n,
        (bins[44] + bins[46]) / n, (bins[32] + bins[10] + bins[9] + bins[13]) / n, bins[128:].sum() / n,
        (counts.max() + 1) / w if words else 0.0, len(set(lines)) / max(1, len(lines)), top / w, np.log1p(len(raw) / max(1, len(lines))),
        ends / w, sum(map(str.isupper, words)) / w,
    )


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    @F.pandas_udf(SCHEMA)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=STATS, dtype=float)

    return docs.withColumn(out, stats(F.col(text_col)))


@dataclass(frozen=True)
class Rule:
    """tests: (statistic, is_above, threshold); all must hold. A null statistic fails every test."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for name, above, cut in self.tests:
            c = F.col(f"{stats}.{name}")
            out = out & ((c > cut) if above else (c <= cut))
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.tests:
            v = x[:, STATS.index(name)]
            out &= (v > cut) if above else (v <= cut)
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = field(default=())

    def score(self, stats: str = "stats") -> Column:
        z = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * r.apply(x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int, rate: float = 0.3, bins: int = 32) -> list[Rule]:
    """Paths of boosted regression trees on the logistic gradient; splits are taken at quantiles of the sample."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}

    def split(rows: np.ndarray, tests: tuple, level: int) -> None:
        if tests:
            rules[tests] = Rule(tests)
        g, h = grad[rows], hess[rows]
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                code = codes[j][rows]
                gs, hs, ns = (np.cumsum(np.bincount(code, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k)
        if best is None:
            z[rows] += rate * g.sum() / (h.sum() + 1)
            return
        _, j, k = best
        left = codes[j][rows] <= k
        for side, above in ((left, False), (~left, True)):
            split(rows[side], (*tests, (STATS[j], above, float(cuts[j][k]))), level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = y - p, p * (1 - p)
        split(np.arange(len(y)), (), 0)
    return list(rules.values())


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept is free."""
    n, m = a.shape
    a = np.hstack([a, np.ones((n, 1))]).astype(np.float32)
    v = np.ones(m + 1, np.float32)
    for _ in range(30):  # largest eigenvalue of a'a
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(a @ v) ** 2) * 0.95
    b = prev = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = b + (t - 1) / t2 * (b - prev)
        p = 1 / (1 + np.exp(-(a @ u.astype(np.float32)).astype(float)))
        new = u - step * (a.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(0, np.abs(new[:m]) - step * penalty)
        b, prev, t = new, b, t2
    return float(b[m]), b[:m]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, least: int = 5, penalty: float = 5e-4) -> RuleModel:
    """Rule ensemble for labels y in {0, 1}. Without rows or with one class only it is the smoothed rate of ones."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = RuleModel(float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return base
    rules = grow_rules(x, y, trees, depth, least)
    if not rules:
        return base
    b0, w = lasso(np.stack([r.apply(x) for r in rules], 1), y, penalty)
    kept = [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6]
    return RuleModel(b0, tuple(r for r, _ in kept), tuple(v for _, v in kept))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12000, **params) -> RuleModel:
    """Fits on at most max_rows labelled rows that are not held out, those of least hash of id.

    Several labels of one id are averaged and rounded up from 0.5; null labels are left out. Of rows that share an id the
    least text counts, so no more than max_rows rows come to the driver. Without labels the score is 0.5 for all.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).withColumnRenamed(id_col, "id")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # bounded: max_rows rows of 12 bytes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    got = with_statistics(rows, "text").select("id", "y", "stats.*").toPandas().sort_values("id")
    return fit(got[list(STATS)].to_numpy(float), got["y"].to_numpy(float), **params)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs, and held_out, score, predicted; clashing columns of these names are replaced.

    Null texts score as empty ones do, repeated rows alike; the time is in proportion to a text. A score at the
    threshold is predicted 1. Other columns stay whatever their names; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`")).alias("held_out"))
    out = with_statistics(own, "text").withColumn("score", model.score())
    return out.select("row.*", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
