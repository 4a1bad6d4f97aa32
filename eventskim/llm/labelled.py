"""Bounded samples of labelled documents, and a small logistic regression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 64 << 10  # longer texts are left out of a fit, never out of scoring


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id's digits is divisible by 5. NULL ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Sample:
    texts: list[str]
    labels: np.ndarray
    #: How many labelled rows each sampled row of label 0 and of label 1 stands for.
    weights: tuple[float, float]


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: tuple[int, int],
    through: Callable[[DataFrame], DataFrame] = lambda df: df,
    seed: int = 0,
) -> Sample:
    """Up to ``per_class`` documents of label 0 and of label 1, in an order drawn by their ids.

    ``through`` is applied to the sampled rows (doc_id, text, label) before they are collected.

    Held-out rows, rows whose label is neither 0 nor 1, ids with both labels and texts
    of over ``LONGEST`` bytes take no part. At most ``sum(per_class)`` rows reach the driver.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter("label = other")
    )
    ids = [
        known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class[k])
        for k in (0, 1)
    ]
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # Two lists of bounded length.
    chosen = F.broadcast(ids[0].union(ids[1]).select(F.col("doc_id").alias("__id"), "label"))
    short = F.octet_length("text") <= LONGEST
    rows = (
        through(docs.join(chosen, F.col("doc_id") == F.col("__id")).filter(short).select("doc_id", "text", "label"))
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    order = np.random.default_rng(seed).permutation(len(rows))
    y = np.array([rows[i]["label"] for i in order], float)
    weights = tuple(count.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1))
    return Sample([rows[i]["text"] for i in order], y, weights)


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: tuple[float, float], ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of standardised logistic regression on raw ``x``, the constant last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.where(y == 1, weights[1], weights[0])
    w = w / w.sum() * len(x)
    b = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[-1, -1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(b[:-1] / scale, b[-1] - (b[:-1] / scale) @ mean)


def probability(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ coefficients[:-1] + coefficients[-1], -30, 30)))
