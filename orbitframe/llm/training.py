"""Bounded training samples and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``max_rows`` labelled documents that aren't held out, those of the smallest
    id hashes. Ids or labels that are null, and labels that contradict each other, are left out. Where rows repeat an id, one of them
    counts. At most ``max_rows`` ids are sent to the tasks."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.md5("text"), "text")).alias("text"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of the standardised columns and, last, the intercept, folded back to the columns as given (Newton's method)."""
    if not len(x) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
