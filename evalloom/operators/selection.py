"""Choosing a model and a threshold: sweeps, metrics, grouped out-of-fold fits."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import numbered_in_order, running_sums
from .families import fold_assignment
from .quality import DataQualityError, require, require_classes


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """(threshold, balanced_accuracy, accuracy, tp, tn) for rows (score, label); score < threshold is robust.

    Candidates: just below the least score, midpoints of neighbours, just above the greatest. Rows are first
    counted by score, so the running sums are over distinct scores. Scores must be finite and labels known.
    """
    x = F.col("score").cast("double")
    require(scores.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | F.col("label").isNull()).limit(1), "scores that aren't finite or rows without label")
    by = scores.groupBy(F.col("score").cast("double").alias("score")).agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    run = running_sums(by, "score", "p", "n").select("score", F.col("c_p").alias("cp"), F.col("c_n").alias("cn"), F.col("next").alias("nxt"), F.col("all_p").alias("P"), F.col("all_n").alias("N"))
    up, down = F.expr("cast(reflect('java.lang.Math', 'nextUp', score) as double)"), F.expr("cast(reflect('java.lang.Math', 'nextDown', score) as double)")
    inner = run.select(F.when(F.col("nxt").isNull(), up).otherwise(F.col("score") + (F.col("nxt") - F.col("score")) / 2).alias("threshold"), F.col("cp").alias("tp"), (F.col("N") - F.col("cn")).alias("tn"), "P", "N")
    least = run.orderBy("score").limit(1).select(down.alias("threshold"), F.lit(0).cast("long").alias("tp"), F.col("N").alias("tn"), "P", "N")
    s = inner.unionByName(least)
    return s.select("threshold", ((F.col("tp") / F.col("P") + F.col("tn") / F.col("N")) / 2).alias("balanced_accuracy"), ((F.col("tp") + F.col("tn")) / (F.col("P") + F.col("N"))).alias("accuracy"), "tp", "tn")


def best_threshold(scores: DataFrame) -> DataFrame:
    """The sweep's best row by balanced accuracy, accuracy, and the smaller threshold."""
    return threshold_sweep(scores).orderBy(F.col("balanced_accuracy").desc(), F.col("accuracy").desc(), "threshold").limit(1)


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    y, p = F.col(target), F.col(prediction)
    e = df.agg(F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("_v"))
    return e.select("mae", "mse", (1 - F.col("mse") / F.col("_v")).alias("r2"))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.agg(((F.count_if(y & p) / F.count_if(y) + F.count_if(~y & ~p) / F.count_if(~y)) / 2).alias("balanced_accuracy"), (F.count_if(y == p) / F.count(F.lit(1))).alias("accuracy"))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """The best candidate by balanced accuracy, accuracy, least error, then identifier."""
    return candidates.orderBy(F.col("balanced_accuracy").desc(), F.col("accuracy").desc(), "mae", "identifier").limit(1)


def impute_median(df: DataFrame, column: str, out: str) -> DataFrame:
    """Nulls and NaN replaced by the other values' exact median: the mean of the one or two middle values by rank, found
    without holding the column in a task. A column without values stays null."""
    known = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    values = df.where(known.isNotNull()).select(known.alias("v"))
    n = values.count()
    middle = F.col("r").isin((n - 1) // 2, n // 2)
    m = numbered_in_order(values, "v", out="r").where(middle).agg(F.avg("v").alias("_m"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.coalesce(known, "_m")).drop("_m")


@dataclass(frozen=True, order=True)
class Candidate:
    """One of three families: ``boosted``, ``extra`` (extremely randomised) and ``forest``."""

    family: str
    trees: int
    depth: int

    @property
    def identifier(self) -> str:
        return f"{self.family}-t{self.trees:04d}-d{self.depth:02d}"

    def build(self, features: str, label: str, seed: int = 42):
        from pyspark.ml import regression as R

        from .trees import ExtraTreesRegressor

        if self.family == "extra":
            return ExtraTreesRegressor(featuresCol=features, labelCol=label, numTrees=self.trees, maxDepth=self.depth, seed=seed)
        if self.family == "forest":
            return R.RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=self.trees, maxDepth=self.depth, seed=seed)
        return R.GBTRegressor(featuresCol=features, labelCol=label, maxIter=self.trees, maxDepth=self.depth, seed=seed)


def grid(families=("boosted", "forest"), trees=(5, 10), depths=(2, 4)) -> list[Candidate]:
    return sorted(Candidate(f, t, d) for f, t, d in itertools.product(families, trees, depths))


def out_of_fold(df: DataFrame, group: str, label_bool: str, features: str, target: str, candidate: Candidate, folds: int = 3, seed: int = 42) -> DataFrame:
    """Each row's prediction from a model that never saw its group: one distributed fit a fold."""
    return _each_fold(df.join(fold_assignment(df, group, label_bool, folds, seed), group), folds, lambda train: candidate.build(features, target, seed).fit(train))


def _each_fold(marked: DataFrame, folds: int, fit) -> DataFrame:
    out = None
    for f in range(folds):
        got = fit(marked.where(F.col("fold") != f)).transform(marked.where(F.col("fold") == f))
        out = got if out is None else out.unionByName(got)
    return out


def mean_baseline(marked: DataFrame, target: str) -> DataFrame:
    """Each row of a table with ``fold``, predicted by the mean target of the other folds. Summed by fold, no loop."""
    per = marked.groupBy("fold").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    all_ = per.agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    mean = per.crossJoin(all_).select("fold", ((F.col("_all_s") - F.col("_s")) / (F.col("_all_n") - F.col("_n"))).alias("prediction"))  # a row a fold
    return marked.join(F.broadcast(mean), "fold")


def pipeline(candidate: Candidate, inputs: list[str], target: str, seed: int = 42):
    """Missing inputs filled by the training rows' medians, then the candidate: fitted inside a fold as one."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"_{c}" for c in inputs]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=inputs, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_features"), candidate.build("_features", target, seed)])


def evaluate_predictions(rows: DataFrame, label: str, target: str, identifier: str) -> dict:
    """Threshold, classification and regression metrics of one candidate's out-of-fold predictions."""
    if not rows.where(F.col("prediction").isNull() | F.isnan("prediction")).isEmpty():
        raise DataQualityError("predictions must be finite for all rows")
    best = best_threshold(rows.select(F.col("prediction").alias("score"), F.col(label).alias("label"))).first()
    errors = regression_metrics(rows, target, "prediction").first()
    return {"identifier": identifier, "decision_threshold": best["threshold"], "balanced_accuracy": best["balanced_accuracy"], "accuracy": best["accuracy"], **errors.asDict()}


def select_model(df: DataFrame, inputs: list[str], group: str, label: str, target: str, candidates: list[Candidate], folds: int = 3, seed: int = 42):
    """(best candidate, its pipeline refitted on all rows, every candidate's metrics, the mean baseline's metrics).

    Candidates are ranked by balanced accuracy, accuracy, mean absolute error and identifier. The grid is a
    driver's list; each fit and each metric is a distributed job.
    """
    if not candidates:
        raise DataQualityError("no candidates")
    require_classes(df, group, label, folds)
    marked = df.join(fold_assignment(df, group, label, folds, seed), group)
    marked = marked.persist()
    try:
        baseline = evaluate_predictions(mean_baseline(marked, target), label, target, "mean_baseline")
        results = [evaluate_predictions(_each_fold(marked, folds, pipeline(c, inputs, target, seed).fit), label, target, c.identifier) for c in sorted(candidates)]
        best = min(results, key=lambda r: (-r["balanced_accuracy"], -r["accuracy"], r["mae"], r["identifier"]))
        chosen = next(c for c in candidates if c.identifier == best["identifier"])
        return chosen, pipeline(chosen, inputs, target, seed).fit(df), results, baseline
    finally:
        marked.unpersist()
