"""What the two classifiers share: the split, the texts of labelled documents, logistic curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.scratch import BROADCAST_IDS, Tables


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the identifier as text leaves ``part`` on division by ``parts``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def known_labels(labels: DataFrame, label: str, unseen: Column) -> DataFrame:
    """doc_id and label of the rows that may teach; of the labels of a repeated doc_id the largest counts."""
    return labels.where(~unseen & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, unseen: Column, tables: Tables) -> tuple[DataFrame, float]:
    """doc_id, text and label of all documents that may teach, and the share of class 1 among the labels.

    ``labels`` may repeat a doc_id: the largest label counts. Repeated rows of a document are one: of its texts
    the least counts.
    """
    known = tables.write(known_labels(labels, label, unseen), "known")
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(shares.values())
    rows = docs.select("doc_id", "text").join(F.broadcast(known) if n <= BROADCAST_IDS else known, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), shares.get(1, 0) / max(1, n)


class Curve:
    """A logistic curve over standardised features."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.middle, self.scale, self.weights, self.bias = middle, scale, weights, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) / self.scale) @ self.weights + self.bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, bias: bool) -> np.ndarray:
    """Weights of least logistic loss plus l2 / 2 times their squares; the last is the bias, if there is one."""
    if bias:
        x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], l2)
    if bias:
        ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), slope)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> Curve:
    """A curve fitted with a weight for each row, scaled to a mean of 1."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = newton((x - middle) / scale, y.astype(float), weight / weight.mean(), l2, True)
    return Curve(middle, scale, w[:-1], float(w[-1]))
