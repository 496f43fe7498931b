"""Extremely randomised regression trees, grown level by level: two aggregates a level for all trees at once."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import DataQualityError, require

#: A tree of unbounded depth would be as large as its table; the open nodes of a level are on the driver.
DEEPEST = 16


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of i are 2i and 2i + 1. Inner nodes have (feature, cut), leaves a value."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row, at most ``depth`` steps below the root."""
        at = np.ones(len(x), np.int64)
        size = max([1, *self.splits]) + 1
        feature, cut = np.full(size, -1), np.zeros(size)
        for i, (f, c) in self.splits.items():
            feature[i], cut[i] = f, c
        for _ in range(depth):
            go = np.flatnonzero((at < size) & (feature[np.minimum(at, size - 1)] >= 0))
            if not len(go):
                break
            f = feature[at[go]]
            at[go] = 2 * at[go] + (x[go, f] > cut[at[go]])
        return at


def draw(seed: int, tree: int, node: int, low: list[float], high: list[float], k: int) -> dict[int, float]:
    """{feature: cut}: ``k`` features that vary in the node, each with a cut drawn evenly between its extremes. The same
    wherever and in whatever order nodes are drawn."""
    rng = random.Random(f"{seed}:{tree}:{node}")
    vary = [f for f in range(len(low)) if low[f] < high[f]]
    chosen = sorted(rng.sample(vary, min(k, len(vary))))
    cuts = {f: low[f] + (high[f] - low[f]) * rng.random() for f in chosen}
    return {f: c if c < high[f] else low[f] for f, c in cuts.items()}  # rounding may reach the top


def gain(n: float, s: float, n_left: float, s_left: float) -> float:
    """How much a cut lowers the sum of squares, from numbers and sums of targets."""
    n_right, s_right = n - n_left, s - s_left
    return s_left * s_left / n_left + s_right * s_right / n_right - s * s / n


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y


def _in_open(tree: Tree, x: np.ndarray, depth: int, places: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, place) of the rows that are in one of the tree's open nodes."""
    at = tree.nodes(x, depth)
    known = np.array(sorted(places), np.int64)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(known, at), len(known) - 1)
    mine = np.flatnonzero(known[k] == at)
    return mine, np.array([places[i] for i in known], np.int64)[k[mine]]


def _extremes(rows: DataFrame, trees, open_: list[tuple[int, int]], depth: int, width: int) -> DataFrame:
    """(place, n, s, q, low, high) of the open nodes: rows, sum and squares of targets, extremes of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [{n: i for i, (t, n) in enumerate(open_) if t == k} for k in range(len(trees.value))]
        m = len(open_)
        sums, low, high = np.zeros((m, 3)), np.full((m, width), np.inf), np.full((m, width), -np.inf)
        for b in batches:
            x, y = _rows(b)
            for tree, mine in zip(trees.value, places):
                r, p = _in_open(tree, x, depth, mine)
                for k, w in enumerate((np.ones(len(r)), y[r], y[r] * y[r])):
                    sums[:, k] += np.bincount(p, w, m)
                order = np.argsort(p, kind="stable")
                ids, at = np.unique(p[order], return_index=True)
                if len(ids):
                    low[ids] = np.minimum(low[ids], np.minimum.reduceat(x[r[order]], at, axis=0))
                    high[ids] = np.maximum(high[ids], np.maximum.reduceat(x[r[order]], at, axis=0))
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(sums[some, k]) for k in range(3)), pa.array(low[some].tolist(), pa.list_(pa.float64())), pa.array(high[some].tolist(), pa.list_(pa.float64()))], ["place", "n", "s", "q", "low", "high"])

    got = rows.mapInArrow(run, "place long, n double, s double, q double, low array<double>, high array<double>")
    return got.groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.array(*[F.min(F.col("low")[i]) for i in range(width)]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in range(width)]).alias("high"))


def _moments(rows: DataFrame, trees, open_: list[tuple[int, int]], cuts: list[dict[int, float]], depth: int, width: int) -> DataFrame:
    """(place, feature, n, s): rows and sums of targets at or below the drawn cuts."""
    grid = np.full((len(open_), width), -np.inf)
    for i, c in enumerate(cuts):
        for f, v in c.items():
            grid[i, f] = v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [{n: i for i, (t, n) in enumerate(open_) if t == k} for k in range(len(trees.value))]
        m = len(open_)
        n, s = np.zeros((m, width)), np.zeros((m, width))
        for b in batches:
            x, y = _rows(b)
            for tree, mine in zip(trees.value, places):
                r, p = _in_open(tree, x, depth, mine)
                for f in range(width):
                    left = x[r, f] <= grid[p, f]
                    n[:, f] += np.bincount(p[left], minlength=m)
                    s[:, f] += np.bincount(p[left], y[r[left]], m)
        i, f = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(f), pa.array(n[i, f]), pa.array(s[i, f])], ["place", "feature", "n", "s"])

    got = rows.mapInArrow(run, "place long, feature long, n double, s double")
    return got.groupBy("place", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def grow(rows: DataFrame, n_trees: int, depth: int, least: int, share: float | str, seed: int) -> list[Tree]:
    """Trees over ``rows(features array, target)``, each on all rows.

    A node is open until it is ``depth`` deep, has under 2 ``least`` rows, one target or no feature that varies. At each
    level one aggregate gives the open nodes' extremes, the driver draws cuts for a ``share`` of the features ("sqrt" for
    their number's root), and a second aggregate gives what lies at or below each cut; the greatest gain wins, the first feature on a tie,
    among cuts that leave ``least`` rows on both sides. Tasks hold sums of the open nodes, the driver the trees.
    """
    spark = rows.sparkSession
    width = rows.select(F.size("features")).first()
    if width is None:
        raise DataQualityError("no rows to grow trees on")
    width = width[0]
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    require(rows.where((F.size("features") != width) | bad | F.col("target").isNull() | F.isnan("target")).limit(1), "features or targets that aren't finite")
    mean = rows.agg(F.avg("target")).first()[0]
    rows = rows.select("features", (F.col("target") - mean).alias("target"))  # so that sums don't cancel out
    k = max(1, int(width**0.5) if share == "sqrt" else int(share * width))
    trees, open_ = [Tree() for _ in range(n_trees)], [(t, 1) for t in range(n_trees)]
    for level in range(depth + 1):
        if not open_:
            break
        shared = spark.sparkContext.broadcast(trees)
        found = {r["place"]: r for r in _extremes(rows, shared, open_, level, width).collect()}  # a row an open node
        going, cuts = [], []
        for i, (t, node) in enumerate(open_):
            r = found[i]
            drawn = {} if level == depth or r["n"] < 2 * least or r["q"] - r["s"] ** 2 / r["n"] <= 1e-12 * max(r["q"], 1e-300) else draw(seed, t, node, r["low"], r["high"], k)
            if drawn:
                going.append((t, node, r))
                cuts.append(drawn)
            else:
                trees[t].leaves[node] = mean + r["s"] / r["n"]
        if not going:
            break
        left: dict[tuple[int, int], tuple[float, float]] = {(m["place"], m["feature"]): (m["n"], m["s"]) for m in _moments(rows, shared, [g[:2] for g in going], cuts, level, width).collect()}
        open_ = []
        for i, ((t, node, r), drawn) in enumerate(zip(going, cuts)):
            best = None
            for f, c in drawn.items():
                n, s = left.get((i, f), (0.0, 0.0))
                if n >= least and r["n"] - n >= least:
                    g = gain(r["n"], r["s"], n, s)
                    if best is None or g > best[0] * (1 + 1e-12) + 1e-300:
                        best = (g, f, c)
            if best is None:
                trees[t].leaves[node] = mean + r["s"] / r["n"]
            else:
                trees[t].splits[node] = best[1:]
                open_ += [(t, 2 * node), (t, 2 * node + 1)]
    return trees


class _Shape(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees, 1 at least", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", f"levels of cuts, 0 to {DEEPEST}", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "rows of a leaf at least", TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "a share above 0 of the features, or sqrt", TypeConverters.toString)


class ExtraTreesRegressor(Estimator, _Shape, DefaultParamsReadable, DefaultParamsWritable):
    """Extremely randomised trees as a stage of a Spark pipeline; see ``grow``."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100, maxDepth=8, minLeaf=1, maxFeatures="1.0", seed=42):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=8, minLeaf=1, maxFeatures="1.0", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        get = self.getOrDefault
        n, depth, least, share = (get(x) for x in ("numTrees", "maxDepth", "minLeaf", "maxFeatures"))
        if n < 1 or not 0 <= depth <= DEEPEST or least < 1 or share != "sqrt" and not 0 < float(share) <= 1:
            raise ValueError(f"not allowed: {n} trees, depth {depth}, leaves of {least}, features {share}")
        rows = dataset.select(_array(dataset, get("featuresCol")).alias("features"), F.col(get("labelCol")).cast("double").alias("target"))
        trees = grow(rows, n, depth, least, share if share == "sqrt" else float(share), get("seed"))
        model = ExtraTreesModel(trees=json.dumps([{"splits": t.splits, "leaves": t.leaves} for t in trees], sort_keys=True))
        return model._set(featuresCol=get("featuresCol"), predictionCol=get("predictionCol"), labelCol=get("labelCol"))


class ExtraTreesModel(Model, _Shape, DefaultParamsReadable, DefaultParamsWritable):
    """Grown trees; a row's prediction is the mean of its leaves."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees="[]"):
        super().__init__()
        self._set(**self._input_kwargs)

    def grown(self) -> list[Tree]:
        read = json.loads(self.getOrDefault("trees"))
        return [Tree({int(i): (f, c) for i, (f, c) in t["splits"].items()}, {int(i): v for i, v in t["leaves"].items()}) for t in read]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        import pandas as pd

        grown = self.grown()
        shared = dataset.sparkSession.sparkContext.broadcast([(t, np.array(sorted(t.leaves)), np.array([t.leaves[i] for i in sorted(t.leaves)])) for t in grown])

        def predict(features):
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))
            total = np.zeros(len(x))
            for t, ids, values in shared.value:
                total += values[np.searchsorted(ids, t.nodes(x, DEEPEST))]
            return pd.Series(total / max(len(shared.value), 1))

        predict.__annotations__ = {"features": pd.Series, "return": pd.Series}  # names would be read as text here
        return dataset.withColumn(self.getOrDefault("predictionCol"), F.pandas_udf(predict, "double")(_array(dataset, self.getOrDefault("featuresCol"))))


def _array(df: DataFrame, column: str) -> Column:
    return vector_to_array(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")
