"""Logistic regression over hashed sparse features, trained by FTRL-proximal updates.

Features are computed where the rows are; one executor task trains on a bounded sample of labelled
rows (``max_rows`` documents, one row a doc_id, and ``max_features`` features of whole texts in all, documented
parameters), and the weights, whose size the hash space fixes, are broadcast for scoring as sparse dot products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import sliced

#: feature function: text bytes -> (bucket indexes, values), indexes distinct
Features = Callable[[bytes], tuple[np.ndarray, np.ndarray]]
ROW = "k long, y int, idx binary, val binary"
MAX_FEATURES = 20_000_000  # 8 bytes each


@dataclass
class Model:
    w: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        return self.bias + float(self.w[idx] @ val)

    def probability(self, idx: np.ndarray, val: np.ndarray) -> float:
        z = self.slope * self.margin(idx, val) + self.shift
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def unit(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets with 1 + log(count), scaled to length one."""
    if not len(idx):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    u, n = np.unique(idx.astype(np.int32), return_counts=True)
    v = 1 + np.log(n)
    return u, (v / np.sqrt(v @ v)).astype(np.float32)


class Ftrl:
    """Follow the regularised leader, per-coordinate rates (McMahan and others, 2013)."""

    def __init__(self, dim: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)
        self.alpha, self.beta, self.l1, self.l2, self.dim = alpha, beta, l1, l2, dim

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, idx: np.ndarray, val: np.ndarray, y: float, weight: float = 1.0) -> None:
        i = np.append(idx, self.dim)  # the last coordinate is the bias
        x = np.append(val, 1.0)
        w = self.weights(i)
        p = 1 / (1 + np.exp(-max(-30.0, min(30.0, float(w @ x)))))
        g = weight * (p - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g

    def model(self) -> Model:
        w = self.weights(np.arange(self.dim + 1))
        return Model(w[:-1].astype(np.float32), float(w[-1]))


def fitted(rows: list, dim: int, epochs: int, alpha: float, l1: float, l2: float, weight_pos: float) -> Model:
    f = Ftrl(dim, alpha, 1.0, l1, l2)
    for e in range(epochs):
        order = np.random.default_rng(e).permutation(len(rows))
        for j in order:
            y, idx, val = rows[j]
            f.update(idx, val, y, weight_pos if y else 1.0)
    return f.model()


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that maximise the likelihood of held-out margins (Platt's smoothed targets)."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        r, s = p - t, p * (1 - p) + 1e-9
        g = np.array([r @ margins, r.sum()])
        h = np.array([[s @ (margins * margins) + 1e-6, s @ margins], [s @ margins, s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def feature_rows(df: DataFrame, features: Callable[[], Features]) -> DataFrame:
    """(k, y, text) -> (k, y, idx, val), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features()
        for b in sliced(batches):
            out = [f(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in out], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())],
                names=["k", "y", "idx", "val"],
            )

    return df.select("k", "y", "text").mapInArrow(run, ROW)


def train(
    docs: DataFrame, labels: DataFrame, label: str, features: Callable[[], Features], dim: int, max_rows: int,
    epochs: int = 4, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.5, calibrate: bool = False, weight_pos: float = 1.0,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those of least xxhash64(doc_id).

    Labels that are null, or that disagree for one doc_id, are resolved to the largest non-null one; of the texts of
    one doc_id the one of least hash counts. In the order of that hash, rows are taken until they hold ``max_features``
    features. No labels: a model that answers 0.5 for every text. With ``calibrate`` every fifth row is left out of
    training and fits the slope and shift of the model's margins. One task of one executor trains; the driver gets
    the weights only.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .withColumn("k", F.xxhash64("doc_id")).orderBy("k", "doc_id").limit(max_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by max_rows
    chosen = chosen.groupBy("doc_id", "k", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = feature_rows(chosen, features)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for b in sliced(batches, 200):  # in the order of k
            for k, y, i, v in zip(*(b.column(c).to_pylist() for c in ("k", "y", "idx", "val")), strict=True):
                if size < max_features:
                    got.append((k, float(y > 0), np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)))
                    size += len(i) // 4
        data = [r[1:] for r in got]
        if not data:
            m = Model(np.zeros(dim, np.float32), 0.0)
        else:
            held = [r for j, r in enumerate(data) if j % 5 == 0] if calibrate and len(data) >= 50 else []
            m = fitted([r for j, r in enumerate(data) if j % 5] if held else data, dim, epochs, alpha, l1, l2, weight_pos)
            if held:
                m.slope, m.shift = platt(np.array([m.margin(i, v) for _, i, v in held]), np.array([y for y, _, _ in held]))
        yield pa.RecordBatch.from_pydict({"w": [m.w.tobytes()], "s": [[m.bias, m.slope, m.shift]]})

    got = rows.repartition(1).sortWithinPartitions("k", "y", "idx").mapInArrow(fit, "w binary, s array<double>").collect()  # one row; at most max_rows go in
    if not got:  # no rows, and so no task
        return Model(np.zeros(dim, np.float32), 0.0)
    w, s = got[0]["w"], got[0]["s"]
    return Model(np.frombuffer(bytes(w), np.float32), *s)
