"""Quality classifier: regularised quadratic discriminant over document statistics.

Both classes get a mean and a covariance of transformed statistics.  A covariance is
shrunk towards the pooled one and towards its own diagonal, then factored once
(Cholesky); a score is the logistic of the difference of the two Gaussian log densities,
each a Mahalanobis distance through the cached factor, plus the log prior odds.

Fitting covers every labelled row: tasks send sums and outer products of a dozen
statistics, so what reaches the driver has a fixed size.

Edge cases: null and empty texts have defined statistics and so a score; rows without a
label only get scored; without any label of one class the score is the smoothed share of
label 1 for every row.  Repeated ids with labels count once a row of ``docs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, stored, texts_of, training_labels
from .textstats import SYMBOLS, count_of, duplicate_lines, words_of

FEATURES = ["length", "word_length", "distinct", "same_next", "symbols", "bars", "upper", "exclaims", "digits", "other", "lines", "dup_lines", "stops", "capitals", "spread"]


def statistics_of(text: str) -> list[float]:
    """Transformed so that each is roughly normal within a class: logs of sizes, roots of shares."""
    words = words_of(text)
    n = len(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_upper = int(((points >= 65) & (points <= 90)).sum())
    ascii_lower = int(((points >= 97) & (points <= 122)).sum())
    digits = int(((points >= 48) & (points <= 57)).sum())
    white = count_of(text, " \t\n\x0b\x0c\r")
    wide = int((points >= 128).sum())
    duplicates, lines = duplicate_lines(text.split("\n"))
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    share = lambda a, b, few: (a / (b + few)) ** 0.5  # noqa: E731  a few more to divide by: shares of short texts stay small
    return [
        np.log1p(n),
        np.log1p((len(text) - white) / n) if n else 0.0,
        np.log1p(len(set(words))) / np.log1p(n) if n else 1.0,
        share(sum(map(bytes.__eq__, words, words[1:])), n, 8),
        share(min(n, count_of(text, SYMBOLS)), n, 8),
        share(min(n, text.count("|")), n, 8),
        share(ascii_upper, ascii_upper + ascii_lower, 60),
        share(min(n, text.count("!")), n, 8),
        share(digits, len(text), 60),
        share(len(text) - white - ascii_upper - ascii_lower - digits - wide, len(text), 60),
        np.log1p(lines),
        share(duplicates, lines, 4),
        share(sum(w[-1:] == b"." for w in words), n, 8),
        share(sum(65 <= w[0] <= 90 for w in words), n, 8),
        np.log1p(sizes.std()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics_of(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    return texts_of(docs).mapInArrow(task, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    prior: float
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    log_det: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] for k in (0, 1)]
        odds = np.log(self.prior / (1 - self.prior)) + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum and sum of outer products of ``x``; one row a task and class reaches the driver."""
    d = len(FEATURES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = np.array(b.column(0).flatten(), np.float64).reshape(-1, d)
            for k in total:
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["y", "m"])

    parts = labelled.select("x", "y").mapInArrow(task, "y int, m array<double>")
    summed = parts.select("y", F.posexplode("m").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    out = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in summed:
        out[r["y"]][r["k"]] = r["v"]
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooling: float = 0.1, diagonal: float = 0.1) -> Discriminant:
    """``pooling``: weight of the pooled covariance in each class's; ``diagonal``: weight of the diagonal."""
    n = {k: sums[k][0] for k in (0, 1)}
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    if min(n.values()) < 2:
        return Discriminant(prior)
    mean = {k: sums[k][1] / n[k] for k in (0, 1)}
    own = {k: sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
    pooled = sum(n[k] * own[k] for k in (0, 1)) / (n[0] + n[1])
    least = np.diag(np.maximum(np.diag(pooled), 1e-6)) * 1e-3
    factor, log_det = [], []
    for k in (0, 1):
        few = min(1.0, pooling + 5 * len(FEATURES) / n[k] * 0.1)
        cov = (1 - few) * own[k] + few * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + least
        lower = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(lower))
        log_det.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(prior, np.array([mean[0], mean[1]]), np.array(factor), np.array(log_det))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(task, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from the folds that aren't held out."""
    stats = stored(with_statistics(docs), "quality-stats")
    model = fit(moments(stats.join(training_labels(labels, label, folds, held_out), "doc_id")))
    return scored(stats, model).select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
