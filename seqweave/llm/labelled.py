"""Bounded samples of labelled texts, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: dict[int, int], most_chars: int, doc_id: str = "doc_id", text: str = "text") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most per_class[k] texts of each label k, none of more than most_chars characters and none held out, and how
    many rows of each label there are to learn from in all.

    The rows with the smallest hash of the id are taken, and of several texts of one id that with the smallest hash, so the
    sample is the same at every run; sum(per_class) times
    most_chars bounds what reaches the driver. held_out is a condition on labels.
    """
    rows = labels.where(~held_out & F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("__label").count().collect() if int(r[0]) in per_class}
    texts = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).where(F.length("__text") <= most_chars)
    found: list[tuple[str, int]] = []
    for k, n in sorted(per_class.items()):
        ids = rows.where(F.col("__label") == k).select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(n)
        one = F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text")
        picked = texts.join(F.broadcast(ids), "__id").groupBy("__id").agg(one).orderBy(F.xxhash64("__id"), "__id")
        found += [(r[0], k) for r in picked.select("__text").collect()]
    return found, counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ b)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
