"""Studies: checking splits, seeded batches, training a head and what a run leaves behind."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import standardise, standardise_stats
from ..sources import files, sinks
from .evaluate import numbered_in_order
from .quality import DataQualityError, overlap, require, require_classes
from .runs import Deadline, Journal


def minibatches(rows: DataFrame, key: str, size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Adds ``batch`` from 0: runs of ``size`` rows in the epoch's seeded hash order, the same wherever rows lie."""
    o = F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")), 256)
    placed = numbered_in_order(rows.withColumn("_o", o), "_o", key, out="_place")
    return placed.withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_o", "_place")


def epoch_loss(rows: DataFrame, batch: str, label: str, logit: str) -> DataFrame:
    """One row: the mean of the batches' cross entropies, each weighted by its size."""
    z, y = F.col(logit).cast("double"), F.col(label).cast("double")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    per = rows.groupBy(batch).agg(F.avg(loss).alias("_l"), F.count(F.lit(1)).alias("_n"))
    return per.agg((F.sum(F.col("_l") * F.col("_n")) / F.sum("_n")).alias("loss"), F.count(F.lit(1)).alias("batches"))


def check_split(train: DataFrame, valid: DataFrame) -> None:
    """No id, family or text on both sides, and both classes to train on."""
    for c in ("id", "family_id", "problem"):
        require(overlap(train, valid, c), f"training and validation share {c}")
    require_classes(train, "family_id", "is_robust")


@dataclass(frozen=True)
class Head:
    """A linear head on standardised features: robust at ``threshold`` or above."""

    mean: list[float]
    std: list[float]
    weights: list[float]
    bias: float
    threshold: float
    history: list[float]

    def predict(self, rows: DataFrame, vector: str = "features") -> DataFrame:
        stats = rows.sparkSession.createDataFrame(list(zip(range(len(self.mean)), self.mean, self.std)), "pos int, mean double, std double")
        z = standardise(rows, vector, stats, "_z")
        w = F.array(*[F.lit(x) for x in self.weights])
        logit = F.aggregate(F.zip_with("_z", w, lambda a, b: a * b), F.lit(float(self.bias)), lambda s, x: s + x)
        p = 1 / (1 + F.exp(-logit))
        return z.withColumn("probability", p).withColumn("is_robust", F.col("probability") >= self.threshold).drop("_z")


def train_head(train: DataFrame, *, vector: str = "features", label: str = "is_robust", epochs: int = 20, penalty: float = 1e-3, threshold: float = 0.5) -> Head:
    """A head fitted on training rows alone: coordinates standardised by them, then a logistic regression (the convex
    case of a head without hidden layer), whose losses by iteration are its ``history``."""
    stats = standardise_stats(train, vector)
    z = standardise(train, vector, stats, "_z").select(array_to_vector("_z").alias("x"), F.col(label).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=epochs, regParam=penalty, standardization=False).fit(z)
    history = [float(x) for x in model.summary.objectiveHistory]
    if not all(map(lambda x: x == x and abs(x) != float("inf"), history)):
        raise DataQualityError("the training loss isn't finite")
    s = stats.orderBy("pos").collect()  # a row a coordinate
    return Head([r["mean"] for r in s], [r["std"] for r in s], [float(x) for x in model.coefficients], float(model.intercept), threshold, history)


def save_outputs(head: Head, predicted: DataFrame, path: str) -> None:
    """``head.json`` and the validation rows' predictions as JSON lines."""
    rows = predicted.select(F.col("id").alias("_o"), "id", "family_id", "label", "probability")
    sinks.write_json_lines(rows, f"{path}/predictions", "_o")
    sinks.write_json(f"{path}/head.json", head.__dict__)


def load_head(spark: SparkSession, path: str) -> Head:
    return Head(**json.loads(files.read_text(spark, f"{path}/head.json")))


#: A run's record as a context; see ``Journal``.
journal = Journal
