"""Minimum covariance determinant from many starts: small starts in parallel tasks, the best of them over all rows.

A concentration step takes the h rows closest to a centre and shape and fits these anew; it never enlarges
the determinant. Starts of p + 1 rows make two steps each inside their part of a bounded sample, the best of each
part go on in the whole sample, and the best places that they reach make a step over all rows, an exact
h-th smallest distance and one aggregate; the one that is best then goes on to its end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.models.linear import Envelope, chi2_quantile, moments, with_mahalanobis
from flowsieve.operators.ordered import exact_quantile, nth_smallest
from flowsieve.operators.sampling import exact_sample
from flowsieve.session import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the scheme: rows of a part and parts of the sample, starts in all, and how many are kept.
PART_ROWS, PARTS, STARTS, KEPT = 300, 5, 500, 10
STEPS = 30
#: Squared distance of places that are not the same.
APART = 0.05


def spread(cov: np.ndarray) -> float:
    """Logarithm of the determinant; directions without extent count as very thin ones."""
    return float(np.log(np.maximum(np.linalg.eigvalsh(cov), 1e-12)).sum())


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, max(values.max(), 1e-12) * 1e-12)
    return ((((x - mean) @ vectors) ** 2) / values).sum(axis=1)


def step(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    closest = x[np.argsort(_distances(x, mean, cov), kind="stable")[:h]]
    return closest.mean(axis=0), np.cov(closest.T, bias=True).reshape(x.shape[1], -1)


def _start(x: np.ndarray, h: int, rng: np.random.Generator) -> tuple[float, np.ndarray, np.ndarray]:
    p, order = x.shape[1], rng.permutation(len(x))
    for size in range(min(p + 1, len(x)), len(x) + 1):
        rows = x[order[:size]]
        cov = np.cov(rows.T, bias=True).reshape(p, p)
        if np.linalg.matrix_rank(cov) == p:
            break
    mean = rows.mean(axis=0)
    for _ in range(2):
        mean, cov = step(x, mean, cov, h)
    return spread(cov), mean, cov


def _best_starts(spark, sample: np.ndarray, share: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where the starts end in the whole sample, the best places first."""
    p, parts = sample.shape[1], PARTS if len(sample) > 2 * PART_ROWS else 1
    sent = spark.sparkContext.broadcast(sample)
    tasks = 2 * PARTS
    each = -(-STARTS // tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in (int(t) for batch in batches for t in batch["id"]):
            x = sent.value[task % parts :: parts]
            rng, h = np.random.default_rng([seed, task]), max(p + 1, int(np.ceil(len(x) * share)))
            found = sorted((_start(x, h, rng) for _ in range(each)), key=lambda f: f[0])[:KEPT]
            out = []
            h = max(p + 1, int(np.ceil(len(sent.value) * share)))
            for least, mean, cov in found:
                for _ in range(STEPS):
                    mean, cov = step(sent.value, mean, cov, h)
                    last, least = least, spread(cov)
                    if abs(last - least) < 1e-9:
                        break
                out.append((task, least, mean.tolist(), cov.ravel().tolist()))
            yield pd.DataFrame(out, columns=["task", "spread", "mean", "cov"])

    rows = spark.range(0, tasks, 1, tasks).mapInPandas(run, "task long, spread double, mean array<double>, cov array<double>").collect()
    # Many starts end in about the same place: the rest are other places, whose order may change over all rows.
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for r in sorted(rows, key=lambda r: (r.spread, r.task)):
        mean, cov = np.array(r["mean"]), np.array(r["cov"]).reshape(p, p)
        if all(_distances(mean[None], m, c)[0] > APART for m, c in kept):
            kept.append((mean, cov))
    return kept[:KEPT]


def minimum_covariance(rows: DataFrame, columns: list[str], half: int | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, shape, log determinant) of the half of the rows with the smallest determinant found.

    half: the number of rows, (n + p + 1) / 2 by default. Rows as far as the last of them are in it too.
    """
    p, n = len(columns), rows.count()
    if n == 0:
        raise ValueError("no rows to fit")
    half = half or (n + p + 1) // 2
    sample = exact_sample(rows, F.xxhash64(*columns), PARTS * PART_ROWS).select(*(F.col(c).cast("double") for c in columns)).toPandas().to_numpy()

    def over_all(mean: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        far = with_mahalanobis(rows, columns, mean, cov, "_d")
        cut = nth_smallest(far, "_d", half)
        _, mean, cov = moments(far.where(F.col("_d") <= F.lit(cut)), columns)[0]
        return spread(cov), mean, cov

    finalists = sorted((over_all(*s) for s in _best_starts(rows.sparkSession, sample, half / n, seed)), key=lambda f: f[0])
    best = finalists[0]
    for _ in range(STEPS):
        nearer = over_all(*best[1:])
        if best[0] - nearer[0] < 1e-9:
            break
        best = nearer
    return best[1], best[2], best[0]


def fit_robust_envelope(train: DataFrame, columns: list[str], contamination: float = 0.01, seed: int = 42) -> Envelope:
    """The ellipse of the smallest determinant, corrected for the normal and fitted anew to what lies inside it."""
    p, train = len(columns), kept(train.select(*columns).na.drop())
    mean, cov, _ = minimum_covariance(train, columns, seed=seed)
    middle = exact_quantile(with_mahalanobis(train, columns, mean, cov, "_d"), "_d", 0.5).first()[0]
    cov = cov * max(middle / chi2_quantile(0.0, p), 1e-12)
    inside = with_mahalanobis(train, columns, mean, cov, "_d").where(F.col("_d") < chi2_quantile(1.959964, p))
    _, mean, cov = moments(inside, columns)[0]
    cut = exact_quantile(with_mahalanobis(train, columns, mean, cov, "_d"), "_d", 1 - contamination).first()[0]
    return Envelope(list(columns), mean, cov, cut)
