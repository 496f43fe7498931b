"""Predictions end to end: regressor artifacts, probe ensembles, participants' functions and adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import ensemble_margins
from . import artifacts, packages
from .quality import DataQualityError


def finite(x: Column, what: str) -> Column:
    """The number, or an error where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{what} isn't finite"))).otherwise(x)


def regressor_predictions(cases: DataFrame, root: str, features: Callable[[DataFrame, artifacts.GenerationConfig], DataFrame]) -> DataFrame:
    """(id, model_id, score, is_robust) for ``cases(id, model_id, ...)``: below the artifact's threshold is robust.

    ``features(cases, config)`` gives (id, features); each case must come back once with a finite score. Cases of
    a model without artifact are all False, with a null score. Models are listed on the driver: they are few.
    """
    spark = cases.sparkSession
    out = None
    for row in cases.select("model_id").distinct().orderBy("model_id").collect():
        mine = cases.where(F.col("model_id").eqNullSafe(row["model_id"]))
        found = artifacts.load(spark, root, row["model_id"]) if row["model_id"] else None
        if found is None:
            got = mine.select("id", "model_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_robust"))
        else:
            scored = found.estimator.predict(features(mine, found.config)).select("id", "score")
            got = mine.select("id", "model_id").join(scored, "id", "left").withColumn("score", finite(F.col("score"), "a score"))
            got = got.select("id", "model_id", "score", (F.col("score") < found.threshold).alias("is_robust"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else cases.select("id", "model_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_robust"))


def layer_index(strategy: Column, best: Column) -> Column:
    """The strategy's layer, else the best one."""
    return F.coalesce(strategy, best).cast("int")


def probe_predictions(cases: DataFrame, probes: DataFrame | None, layer: int, encode: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(id, margin, is_robust): the mean margin of the layer's probes, robust at 0 or more; without probes all False.

    ``encode(cases, layer)`` gives (id, features); ``probes`` is (layer, probe, weights, bias, threshold).
    """
    if probes is None:
        return cases.select("id", F.lit(None).cast("double").alias("margin"), F.lit(False).alias("is_robust"))
    mine = probes.where(F.col("layer").cast("string") == str(layer)).withColumn("layer", F.lit(layer))
    if mine.isEmpty():
        raise DataQualityError(f"no probes for layer {layer}")
    rows = encode(cases, layer).select("id", F.lit(layer).alias("_at"), "features")
    got = ensemble_margins(rows, "id", "_at", "features", mine)
    return cases.select("id").join(got, "id", "left").select("id", finite(F.col("margin"), "a margin").alias("margin"), "is_robust")


def participant(spark: SparkSession, folder: str) -> Callable[[str, list[str]], list[bool]]:
    """The function ``are_robust`` of the folder's solution.py, for ``evaluate.run_batches``.

    The whole folder travels to the workers, so it may import its own modules and packages and read its own files
    beside ``__file__``. Each worker loads it once, apart from other submissions' modules of the same names.
    """
    name = packages.shipped(spark, folder)
    packages.check_loads(spark, name)

    def predict(model_id: str, problems: list[str]) -> list[bool]:
        return packages.loaded(name)(model_id, problems)

    return predict


def as_function(spark: SparkSession, predict: Callable[[DataFrame], DataFrame]) -> Callable[[str, list[str]], list[bool]]:
    """A table predictor as a function of lists: ``predict`` gives (id, is_robust) for (id, model_id, problem). For
    lists that a caller holds anyway."""

    def are_robust(model_id: str, problems: list[str]) -> list[bool]:
        if not problems:
            return []
        cases = spark.createDataFrame([(i, model_id, p) for i, p in enumerate(problems)], "id long, model_id string, problem string")
        got = {r["id"]: bool(r["is_robust"]) for r in predict(cases).select("id", "is_robust").collect()}
        return [got[i] for i in range(len(problems))]

    return are_robust
