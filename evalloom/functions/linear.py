"""Vector columns: standardising, linear heads, probe margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def standardise_stats(rows: DataFrame, vector: str, floor: float = 1e-6) -> DataFrame:
    """(pos, mean, std) of each coordinate: population deviation, at least ``floor``. Give it training rows only."""
    x = rows.select(F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("pos").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"))


def standardise(rows: DataFrame, vector: str, stats: DataFrame, out: str = "z") -> DataFrame:
    """Adds the z-scored vector. ``stats`` has a row a coordinate; they travel as one row of arrays."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_s"))
    z = F.zip_with(F.col(vector), F.col("_s"), lambda x, s: (x.cast("double") - s["mean"]) / s["std"])
    return rows.crossJoin(F.broadcast(packed)).withColumn(out, z).drop("_s")  # one row


def head_probability(vector: Column, weights: list[float], bias: float) -> Column:
    """A linear head: sigmoid of w.x + b. Robust where it is at least the head's threshold."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return 1 / (1 + F.exp(-(dot(vector, w) + F.lit(float(bias)))))


def mlp_probability(weights, hidden_bias, out_weights, out_bias):
    """A one-hidden-layer ReLU head as an Arrow-batched function of an array column."""
    import numpy as np
    import pandas as pd

    w, b, v = np.asarray(weights, float), np.asarray(hidden_bias, float), np.asarray(out_weights, float)

    def head(x):
        h = np.maximum(np.stack(x.to_numpy()) @ w.T + b, 0)
        p = 1 / (1 + np.exp(-(h @ v + out_bias)))
        if not np.isfinite(p).all():
            raise ValueError("the head gave a value that isn't finite")
        return pd.Series(p)

    head.__annotations__ = {"x": pd.Series, "return": pd.Series}  # names would be read as text here
    return F.pandas_udf(head, "double")


def probe_margin(vector: Column, weights: Column, bias: Column, threshold: Column) -> Column:
    return F.when(F.size(vector) == F.size(weights), dot(vector, weights) + bias - threshold).otherwise(F.raise_error(F.lit("probe and vector differ in length")))


def ensemble_margins(rows: DataFrame, key: str, layer: str, vector: str, probes: DataFrame) -> DataFrame:
    """(key, margin, is_robust): the mean of all probe margins of the row's layer; robust where >= 0.

    ``probes`` is (layer, probe, weights, bias, threshold). A row whose layer has no probe has a null margin.
    """
    p = probes.withColumnRenamed("layer", "_layer")
    m = rows.join(p, F.col(layer) == F.col("_layer"), "left")
    margin = F.when(F.col("weights").isNotNull(), probe_margin(F.col(vector), F.col("weights"), F.col("bias"), F.col("threshold")))
    got = m.groupBy(key).agg(F.avg(margin).alias("margin"))
    return got.withColumn("is_robust", F.coalesce(F.col("margin") >= 0, F.lit(False)))


def flattened(blocks: Column) -> Column:
    return F.flatten(blocks)
