"""Heads trained by seeded minibatches: gradients summed on the tasks that hold a batch, Adam's moments on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import head_probability, mlp_probability, standardise, standardise_stats
from ..session import work_dir
from ..sources import files
from .quality import DataQualityError, require
from .study import Deadline, minibatches

#: Fixed values of Adam: decay of the first and second moments, and what keeps the root from zero.
DECAY, FLOOR = (0.9, 0.999), 1e-8


@dataclass(frozen=True)
class Network:
    """A head on standardised features: a linear one (``hidden`` empty) or one with a hidden ReLU layer."""

    mean: list[float]
    std: list[float]
    hidden: list[list[float]]
    hidden_bias: list[float]
    weights: list[float]
    bias: float
    threshold: float
    history: list[float]

    def predict(self, rows: DataFrame, vector: str = "features") -> DataFrame:
        """Adds ``probability`` and ``is_robust``, true at the threshold or above."""
        stats = rows.sparkSession.createDataFrame(list(zip(range(len(self.mean)), self.mean, self.std)), "pos int, mean double, std double")
        z = standardise(rows, vector, stats, "_z")
        if self.hidden:
            p = mlp_probability(self.hidden, self.hidden_bias, self.weights, self.bias)(F.col("_z"))
        else:
            p = head_probability(F.col("_z"), self.weights, self.bias)
        return z.withColumn("probability", p).withColumn("is_robust", F.col("probability") >= self.threshold).drop("_z")

    def record(self) -> dict:
        return asdict(self)


def start(dim: int, width: int, seed: int) -> np.ndarray:
    """First parameters in one vector (hidden weights and biases, out weights, bias): even draws within the inverse root of the inputs."""
    if type(dim) is not int or dim < 1 or type(width) is not int or width < 0:
        raise ValueError("a head needs whole numbers of inputs, 1 at least, and of hidden units")
    rng = np.random.default_rng(seed)
    sizes = [(dim, width * (dim + 1)), (width, width + 1)] if width else [(dim, dim + 1)]
    return np.concatenate([rng.uniform(-1, 1, n) / fan**0.5 for fan, n in sizes])


def unpacked(p: np.ndarray, dim: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    if not width:
        return np.zeros((0, dim)), np.zeros(0), p[:dim], float(p[dim])
    a = width * dim
    return p[:a].reshape(width, dim), p[a : a + width], p[a + width : a + 2 * width], float(p[a + 2 * width])


def losses(p: np.ndarray, z: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """(gradient, loss) of the summed cross entropy of rows ``z`` with labels ``y``."""
    w, b, out, bias = unpacked(p, z.shape[1], width)
    h = np.maximum(z @ w.T + b, 0) if width else z
    logit = h @ out + bias
    loss = np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))
    e = np.exp(-np.abs(logit))
    d = np.where(logit >= 0, 1 / (1 + e), e / (1 + e)) - y
    last = np.append(h.T @ d, d.sum())
    if not width:
        return last, float(loss.sum())
    back = (d[:, None] * out) * (h > 0)
    return np.concatenate(((back.T @ z).ravel(), back.sum(axis=0), last)), float(loss.sum())


class Adam:
    def __init__(self, n: int, rate: float):
        self.rate, self.step, self.first, self.second = rate, 0, np.zeros(n), np.zeros(n)

    def moved(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.step += 1
        a, b = DECAY
        self.first, self.second = a * self.first + (1 - a) * g, b * self.second + (1 - b) * g * g
        return p - self.rate * (self.first / (1 - a**self.step)) / (np.sqrt(self.second / (1 - b**self.step)) + FLOOR)


def _summed(batch: DataFrame, p, width: int) -> tuple[np.ndarray, float, int]:
    """The batch's gradient, loss and rows. A task that holds rows of it sends one row; they are few, as a batch is a run of a sorted table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(len(p.value)), 0.0, 0
        for b in batches:
            if b.num_rows:
                z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                g, e = losses(p.value, z, b.column(1).to_numpy(zero_copy_only=False), width)
                total, loss, n = total + g, loss + e, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([n], pa.int64())], ["g", "loss", "n"])

    got = batch.select("_z", "_y").mapInArrow(run, "g array<double>, loss double, n long").collect()
    return np.sum([r["g"] for r in got], axis=0), float(sum(r["loss"] for r in got)), sum(r["n"] for r in got)


def train(rows: DataFrame, key: str, *, vector: str = "features", label: str = "is_robust", width: int = 0, epochs: int = 20, batch: int = 4, rate: float = 1e-3, threshold: float = 0.5, seed: int = 42, deadline: Deadline | None = None) -> Network:
    """A head trained on ``rows`` alone, whose keys must be unique: coordinates are standardised by them, each epoch goes
    through its own seeded order in runs of ``batch`` rows, and each run is a step of Adam. ``history`` is the mean loss of
    every epoch, each batch's before its step.

    An epoch's order is a written table sorted by batch, so a step reads the files' parts that hold its batch. A step is a
    job: large tables want large batches. The driver holds parameters and moments; ``deadline`` is asked before each step.
    """
    if epochs < 1 or batch < 1:
        raise ValueError("epochs and batches are 1 at least")
    spark = rows.sparkSession
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    require(rows.where(F.col(vector).isNull() | bad | F.col(label).isNull() | F.col(key).isNull()).select(key).limit(1), "rows without key, label or finite features")
    stats = standardise_stats(rows, vector)
    held = stats.orderBy("pos").collect()  # a row a coordinate
    if not held:
        raise DataQualityError("no rows to train on")
    dim = len(held)
    require(rows.where(F.size(vector) != dim).select(key).limit(1), "features of several lengths")
    z = standardise(rows, vector, stats, "_z").select(F.col(key).alias("_k"), "_z", F.col(label).cast("double").alias("_y"))
    p, history = start(dim, width, seed), []
    adam = Adam(len(p), rate)
    for epoch in range(epochs):
        path = work_dir(spark, "epoch")
        ordered = minibatches(z, "_k", batch, seed, epoch)
        ordered.repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(path)
        table = spark.read.parquet(path)
        total, seen = 0.0, 0
        for i in range(-(-table.count() // batch)):
            if deadline:
                deadline.check()
            shared = spark.sparkContext.broadcast(p)
            g, loss, n = _summed(table.where(F.col("batch") == i), shared, width)
            shared.unpersist()
            if not np.isfinite(loss):
                raise DataQualityError("the training loss isn't finite")
            p, total, seen = adam.moved(p, g / n), total + loss, seen + n
        history.append(total / seen)
        files.delete(spark, path)
    w, b, out, bias = unpacked(p, dim, width)
    return Network([r["mean"] for r in held], [r["std"] for r in held], w.tolist(), b.tolist(), out.tolist(), bias, threshold, history)
